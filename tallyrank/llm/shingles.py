"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of anything but ASCII white space; A-Z count as a-z. A text's set holds its
distinct ``k``-word shingles; a text of fewer words has its whole word sequence as the only
one; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _R, np.uint64), np.full(size, _RINV, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def chunks(texts, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges of texts of about ``size`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    up, down = _power_tables(len(data) + 1)
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))  # begins and ends of words alternate
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(begin, ends)])


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, at = word_hashes(texts)
    n = len(hashes)
    if n >= k:
        rolled = hashes[: n - k + 1].copy()
        for j in range(1, k):
            rolled = rolled * _R + hashes[j : n - k + 1 + j]
        rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            x = b - a
            for h in hashes[a:b].tolist():
                x = (x * int(_R) + h) % 2**64
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SIGNATURE = 128
_XOR = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures, ``SIGNATURE`` 16-bit values a set (zeros for empty sets)."""
    out = np.zeros((len(sets), SIGNATURE), ">u2")
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        work = np.empty_like(flat)
        for j in range(SIGNATURE):
            np.bitwise_xor(flat, _XOR[j], out=work)
            np.multiply(work, _MUL[j], out=work)
            out[full, j] = mix(np.minimum.reduceat(work, starts)) >> np.uint64(48)
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; equal sets have equal ones."""
    a = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    b = np.array([mix(s ^ _C1).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)
