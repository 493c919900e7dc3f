"""SentencePiece ids, decoding, and distinct sampled segmentations.

Encoding and decoding follow the model's library. No piece of the model has a word mark or
a line feed after another character, so a text falls into chunks (word marks and the
letters after them) that are encoded independently.

Sampling is over the lattice of all segmentations of a text into pieces. A piece's weight
follows Zipf's law on its merge rank, raised to ``ALPHA``. Each distinct chunk's lattice is
summed once, forward; the text's distribution is the product over its chunks. ``k`` distinct
segmentations are drawn without replacement, in the order of Gumbel-perturbed
log-probabilities, by best-first search over regions of the lattice (A-star with exact bounds):

* a region is "as sample s before chunk n, none of the samples met so far at chunk n, free
  after"; its bound, the largest perturbed value within it, is a Gumbel of the region's mass,
  truncated by the region that it was cut from, so it is drawn without looking inside. In
  times t = exp(-value) the bounds are exponential arrivals, so the best region of a sample
  comes after an exponential time of the summed mass and is picked in proportion to mass;
* the region of the best bound is opened: its sample is drawn (backward through the
  lattices), has that bound as its perturbed value, and cuts the rest of the region into one
  region per chunk.

The best bound left after k samples is the threshold kappa: a segmentation of
log-probability f has the inclusion score 1 - exp(-exp(f - kappa)). All randomness is hashed
from the row key, the sample, the chunk's place and the step, so a row's samples don't depend
on its partition, batch or a retry. Masses are sums of positive terms, so no region is lost to
cancellation.

A worker keeps the lattices and ids of chunks that occur again, up to ``KEEP`` of them; other
chunks are dropped after their batch. What is kept changes no result.

Defined results: null is the empty text, which has one segmentation (no ids, inclusion 1);
texts with fewer than k segmentations give all of them; the mark U+2581 in a text is the
same as a space, as in the library; rows of equal key and text get equal samples, a null key
is a key of its own; an empty table gives an empty result; of the other columns those named
in ``keep`` come back, whatever their names but ids, decoded and samples, which the result has
itself; a very long text is one batch of its own, and time stays linear in a chunk's length too (chunks over
``LONG`` characters are walked one place after another).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import received, shipped
from .shingles import _power_tables, mix

ALPHA = 0.5
SAMPLES = 3
MARK = "▁"
#: Chunks whose lattices a worker keeps, and characters of them.
KEEP, KEEP_SIZE = 100_000, 1_000_000
#: UTF-8 bytes of texts handled together.
TOGETHER = 1_000_000
#: Places of a chunk that are summed, and steps that are drawn, for all chunks at once; what lies beyond goes one by one.
LONG = 48
_SPLIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
_R = np.uint64(0x9E3779B97F4A7C15)
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_WORD = (1 << 64) - 1


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashed words as numbers strictly between 0 and 1."""
    return ((mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _unit_of(x: int) -> float:
    """``_unit`` of one Python integer."""
    x &= _WORD
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    return ((x ^ x >> 31) >> 12) * 2.0**-52 + 2.0**-53


#: Bits of a hash that index the table which says whether it may be a piece (1) or the end of a longer one (2).
_FILTER_BITS = 20


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at ``begin``, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Coder:
    """Encoding and decoding with a SentencePiece model; ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        if n > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        names = [m.id_to_piece(i) for i in range(n)]
        self.plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if any("\n" in names[i] or MARK in names[i].lstrip(MARK) for i in self.plain):
            raise ValueError("a piece crosses words, so texts can't be split into chunks")
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        spelled = {i: names[i].replace(MARK, " ").encode() for i in self.plain} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        spelled = [spelled.get(i, b"") for i in range(n)]
        self.spelled_size = np.array([len(x) for x in spelled], np.int32)
        self.spelled_at = (np.cumsum(self.spelled_size) - self.spelled_size).astype(np.int32)
        self.spelled_data = np.frombuffer(b"".join(spelled), np.uint8)
        self.pieces = {names[i]: i for i in self.plain}
        self.rank = {i: -m.get_score(i) for i in self.plain}

    @staticmethod
    def split(text: str) -> list[str]:
        return _SPLIT(MARK + text.replace(" ", MARK)) if text else []

    def chunk_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk (with spaces for marks); the library is asked for all of a kind at once."""
        out: list = [None] * len(chunks)
        marked = [i for i, c in enumerate(chunks) if c[0] == " " and len(c) > 1]  # the library puts the first mark there itself
        for i, ids in zip(marked, self.model.encode([chunks[i][1:] for i in marked], num_threads=1) if marked else [], strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.model.encode(["\n" + chunks[i] for i in rest], num_threads=1) if rest else [], strict=True):
            out[i] = ids[2:]
        return out

    def encode(self, text: str) -> bytes:
        return np.array([i for ids in self.chunk_ids(self.split(text)) for i in ids], "<u2").tobytes()

    def decode(self, ids: bytes) -> str:
        data, ends = self.spell(np.frombuffer(ids, "<u2"), np.array([0, len(ids) // 2]))
        return data.tobytes().decode("utf-8", "replace")

    def spell(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of many texts' ids, text i from cut[i] to cut[i + 1], and where each text's bytes end."""
        size = self.spelled_size[ids]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        data = self.spelled_data[np.repeat((self.spelled_at[ids] - ends[:-1]).astype(np.int64), size) + np.arange(int(ends[-1]))]
        begin, end = ends[cut[:-1]], ends[cut[1:]]
        mark = begin[end > begin]
        mark = mark[data[mark] == 32]  # the mark before a text isn't part of it
        if len(mark):
            data = np.delete(data, mark)
        return data, end - np.searchsorted(mark, end)


class Lattices:
    """Lattices of chunks, summed forward, with tables for drawing backward; chunks are numbered.

    Nodes are the places between characters. All that is known of a node depends on the characters
    before it only, so chunks that are added together share the nodes of their common beginnings; a
    chunk over ``LONG`` characters has its own, one after another. Edges into a node stand together,
    longest piece first. The path of first edges, ``main``, is mostly the likeliest. ``begin_batch``
    adds the new chunks of a batch; those that may serve again stay, the others' room is used again
    by the next batch.
    """

    NODE = {"at": np.int64, "rest": np.float64, "other": np.float64}
    EDGE = {"tail": np.int64, "piece": np.int32, "log_q": np.float64, "q": np.float64, "upto": np.float64}
    CHUNK = {"first": np.int64, "last": np.int64, "main_log": np.float64, "main_rest": np.float64, "main_at": np.int64, "main_count": np.int64, "ids_at": np.int64, "ids_count": np.int64}
    FLAT = {"main_piece": np.int32, "ids": np.uint16}

    def __init__(self, sampler: Sampler):
        self.sampler = sampler
        for name, kind in (self.NODE | self.EDGE | self.CHUNK | self.FLAT).items():
            setattr(self, name, np.zeros(1024, kind))
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.utf8())
        self.kept = (0, 0, 0, 0, 0)  # nodes, edges, chunks, main pieces, ids

    def _put(self, names: dict, where: int, values: dict, spare: int = 0) -> int:
        for name in names:
            x, v = getattr(self, name), values[name]
            if where + len(v) + spare > len(x):
                setattr(self, name, x := np.concatenate([x[:where], np.zeros(len(v) + spare + len(x) // 2, x.dtype)]))
            x[where : where + len(v)] = v
        return where + len(v)

    def begin_batch(self, words: pa.Array, count: np.ndarray) -> np.ndarray:
        """The number of each of the distinct ``words`` (with spaces for marks), which occur ``count`` times in the batch."""
        if len(self.words) > KEEP or self.kept[0] > KEEP_SIZE:
            self.forget()
        known = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            some = words.take(pa.array(new))
            kind = 2 * (count[new] < 2) + (pc.utf8_length(some).to_numpy() > LONG)
            order = pc.sort_indices(some).to_numpy().astype(np.int64)  # equal beginnings side by side
            new = new[order[np.argsort(kind[order].astype(np.uint8), kind="stable")]]  # those to keep come first
            stay = int((count[new] > 1).sum())
            known[new] = self.kept[2] + np.arange(len(new))
            added = words.take(pa.array(new))
            self.kept = self._add(added, stay)
            self.words = pa.concat_arrays([self.words, added.slice(0, stay)])
        return known

    def _add(self, words: pa.Array, stay: int) -> tuple:
        """Put lattices behind those kept; returns what is kept if the first ``stay`` stay."""
        s, (n0, e0, c0, m0, i0) = self.sampler, self.kept
        raw = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        data = words.buffers()[2].to_pybytes()[: raw[-1]]
        stop = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.int8) >= -64).astype(np.int64))])[raw]  # counts first bytes of characters
        text, size, begin = data.decode("utf-8", "surrogatepass"), np.diff(stop), stop.tolist()
        ids = s.coder.chunk_ids([text[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)])
        ids_count = np.fromiter(map(len, ids), np.int64, len(ids))
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        code[code == 32] = ord(MARK)
        stop = stop[1:]
        chunk = np.repeat(np.arange(len(words)), size)
        step = np.arange(len(code)) - (stop - size)[chunk]
        # a chunk's own nodes are those behind the beginning that it shares with the chunk before it
        long = size > LONG
        alone = long.copy()
        alone[1:] |= long[:-1]
        alone[[0, stay % len(words)]] = True  # what stays shares nothing with what goes
        differ = alone[chunk] | (step >= np.append(0, size[:-1])[chunk])
        differ |= code != code[np.minimum(np.append(0, (stop - size)[:-1])[chunk] + step, len(code) - 1)]
        parts = np.flatnonzero(differ)
        parts = parts[np.append(True, chunk[parts[1:]] != chunk[parts[:-1]])]
        shared = step[parts]
        fresh = size - shared + long  # a long chunk has its own first node, the others share node 0
        last = np.cumsum(fresh)
        first = np.where(long, last - fresh + 1, 0)
        nodes = int(last[-1]) + 1
        at = np.flatnonzero(step >= shared[chunk])
        node = np.zeros(len(code), np.int64)
        node[at] = (last - size + 1)[chunk[at]] + step[at]
        local = np.zeros(nodes, np.int64)
        local[node[at]] = step[at] + 1
        # by place and chunk, the chunk's node there: its own, or the latest of the chunks before it
        short = at[~long[chunk[at]]]
        place = np.zeros((int(step[short].max()) + 2 if len(short) else 1, len(words)), np.int32)
        place[step[short] + 1, chunk[short]] = node[short]
        np.maximum.accumulate(place, axis=1, out=place)
        up, down = _power_tables(len(code) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(code + _A) * up[: len(code)])])
        found = []  # pieces by the place of their last character
        for n in range(1, s.longest + 1):
            if n > 1:
                at = at[step[at] >= n - 1]
            if not len(at):
                break
            begin = at - (n - 1)
            h = (total[at + 1] - total[begin]) * down[begin]
            kind = s.filter[(h >> np.uint64(64 - _FILTER_BITS)).view(np.int64)]
            maybe = np.flatnonzero(kind & 1)
            slot = s.find(h[maybe])
            hit = slot >= 0
            good, slot = maybe[hit], slot[hit]
            if n == 1:  # characters without a piece are spelled in bytes; of more than one byte, by pseudo ids from 1 << 16 on
                piece, weight = np.empty(len(at), np.int64), np.empty(len(at))
                spare = np.ones(len(at), bool)
                spare[good] = False
                piece[good], weight[good] = s.ids[slot], s.logs[slot]
                odd = code[at[spare]].astype(np.int64)
                piece[spare] = np.where(odd < 128, s.byte_id[odd & 127], odd + (1 << 16))
                weight[spare] = s.byte_log * (1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF))
                found.append((at, n, piece, weight))
            elif len(good):
                found.append((at[good], n, s.ids[slot], s.logs[slot]))
            at = at[kind >= 2]  # some piece goes on from here
        found.reverse()
        end = np.concatenate([f[0] for f in found])
        length = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        head = node[end]
        tail = head - length
        near = np.flatnonzero(~long[chunk[end]])
        tail[near] = place[step[end[near]] + 1 - length[near], chunk[end[near]]]
        piece, weight = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        order = np.argsort(head, kind="stable")  # merges one run a length
        tail, piece, head, weight = tail[order], piece[order], head[order], weight[order]
        fan = np.bincount(head, minlength=nodes)
        at = np.concatenate([[0], np.cumsum(fan)])
        alpha = np.zeros(nodes)
        near = np.flatnonzero(local <= LONG)
        near = near[np.argsort(local[near].astype(np.uint8), kind="stable")]
        cuts = np.cumsum(np.bincount(local[near]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            to = near[a:b]
            n = fan[to]
            ends = np.cumsum(n)
            edges = np.repeat(at[to] - (ends - n), n) + np.arange(ends[-1])
            value = alpha[tail[edges]] + weight[edges]
            most = np.maximum.reduceat(value, ends - n)
            alpha[to] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, n)), ends - n))
        for c in np.flatnonzero(long).tolist():
            lo, hi = int(first[c]), int(last[c])
            e, a = int(at[lo]), alpha[lo : hi + 1].tolist()
            tails, weights, fans = (tail[e : at[hi + 1]] - lo).tolist(), weight[e : at[hi + 1]].tolist(), fan[lo : hi + 1].tolist()
            e = sum(fans[: LONG + 1])
            for x in range(LONG + 1, len(a)):
                value = [a[t] + w for t, w in zip(tails[e : e + fans[x]], weights[e : e + fans[x]], strict=True)]
                most = max(value)
                a[x] = most + math.log(sum(math.exp(v - most) for v in value))
                e += fans[x]
            alpha[lo : hi + 1] = a
        log_q = alpha[tail] + weight - alpha[head]
        q = np.exp(log_q)
        # running sums of q within a node, the first edge left out
        upto, other = np.zeros(len(q)), np.zeros(nodes)
        inner, step = np.flatnonzero(fan > 1), 1
        while len(inner):
            edge = at[inner] + step
            other[inner] += q[edge]
            upto[edge] = other[inner]
            step += 1
            inner = inner[fan[inner] > step]
        # the main path of each chunk and, at each of its nodes, the probability of not following it to the start
        main_log, rest, main_count = np.zeros(len(words)), np.zeros(nodes), np.zeros(len(words), np.int64)
        here, trail, active = last.copy(), [], np.arange(len(words))
        while len(active) and len(trail) < LONG:
            edge = at[here[active]]
            trail.append((active, here[active], edge))
            main_log[active] += log_q[edge]
            main_count[active] += 1
            here[active] = tail[edge]
            active = active[here[active] != first[active]]
        beyond = {}
        for c in active.tolist():  # the rest of main paths of many steps
            lo, x = int(first[c]), int(here[c])
            e, starts = int(at[lo]), at[lo : x + 1].tolist()
            tails, logs, own, beside = tail[e : at[x + 1]].tolist(), log_q[e : at[x + 1]].tolist(), q[e : at[x + 1]].tolist(), other[lo : x + 1].tolist()
            path, sum_log = [], float(main_log[c])
            while x != lo:
                path.append((x, starts[x - lo]))
                sum_log += logs[starts[x - lo] - e]
                x = tails[starts[x - lo] - e]
            r = 0.0
            for x, k in reversed(path):
                r = beside[x - lo] + own[k - e] * r
                rest[x] = r
            main_log[c] = sum_log
            main_count[c] += len(path)
            beyond[c] = [k for _, k in reversed(path)]
        for who, node, edge in reversed(trail):
            rest[node] = other[node] + q[edge] * rest[tail[edge]]
        main_end = np.cumsum(main_count)
        main_piece = np.zeros(int(main_end[-1]), np.int32)
        for t, (who, _, edge) in enumerate(trail):
            main_piece[main_end[who] - 1 - t] = piece[edge]
        for c, edges in beyond.items():
            main_piece[main_end[c] - main_count[c] : main_end[c] - LONG] = piece[edges]
        ids_end = np.cumsum(ids_count)
        self._put(self.NODE, n0, {"at": at[:-1] + e0, "rest": rest, "other": other}, 1)
        self.at[n0 + nodes] = e0 + len(q)
        self._put(self.EDGE, e0, {"tail": tail + n0, "piece": piece, "log_q": log_q, "q": q, "upto": upto})
        self._put(self.CHUNK, c0, {
            "first": first + n0, "last": last + n0, "main_log": main_log, "main_rest": rest[last],
            "main_at": m0 + main_end - main_count, "main_count": main_count, "ids_at": i0 + ids_end - ids_count, "ids_count": ids_count,
        })
        self._put({"main_piece": 0}, m0, {"main_piece": main_piece})
        self._put({"ids": 0}, i0, {"ids": np.fromiter(chain.from_iterable(ids), np.uint16, int(ids_end[-1]))})
        if not stay:
            return self.kept
        top = int(last[stay - 1]) + 1
        return n0 + top, e0 + int(at[top]), c0 + stay, m0 + int(main_end[stay - 1]), i0 + int(ids_end[stay - 1])

    def draw(self, word: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], list[tuple[int, list[int]]]]:
        """A path for each of ``word``, from randomness hashed from ``base``.

        Returns which follow the main path; for the others (index, edge) step by step from
        the end; and, for paths of more than LONG steps, (index, further edges). Those that
        leave the main path first decide so as a whole; then each step draws given that the
        path so far may not become the main one.
        """
        main = _unit(base) >= self.main_rest[word]
        active = np.flatnonzero(~main)
        own = word[active]
        here, goal, base = self.last[own], self.first[own], base[active]
        bound, steps = np.ones(len(active), bool), []
        while len(active) and len(steps) < LONG:
            u = _unit(base + np.uint64(len(steps) + 1) * _C)
            edge = self.at[here]
            keep = self.q[edge]
            tied = np.flatnonzero(bound)
            if len(tied):
                keep[tied] *= self.rest[self.tail[edge[tied]]] / self.rest[here[tied]]
            off = np.flatnonzero(u >= keep)
            if len(off):
                spread = (u[off] - keep[off]) / (1 - keep[off]) * self.other[here[off]]
                most = self.at[here[off] + 1] - 1
                pick = np.minimum(edge[off] + 1, most)
                open_ = np.flatnonzero((self.upto[pick] <= spread) & (pick < most))
                while len(open_):
                    pick[open_] += 1
                    open_ = open_[(self.upto[pick[open_]] <= spread[open_]) & (pick[open_] < most[open_])]
                edge[off] = pick
                bound[off] = False
            steps.append((active, edge))
            here = self.tail[edge]
            on = np.flatnonzero(here != goal)
            active, here, goal, base, bound = active[on], here[on], goal[on], base[on], bound[on]
        return main, steps, [(i, self._walk(*x)) for i, *x in zip(active.tolist(), here.tolist(), goal.tolist(), base.tolist(), bound.tolist(), strict=True)]

    def _walk(self, here: int, goal: int, base: int, bound: bool) -> list[int]:
        """The steps of ``draw`` after the first LONG, for one path."""
        e, starts = int(self.at[goal]), self.at[goal : here + 2].tolist()
        tails, own, upto = (x[e : starts[-1]].tolist() for x in (self.tail, self.q, self.upto))
        rest, other = self.rest[goal : here + 1].tolist(), self.other[goal : here + 1].tolist()
        path, t = [], LONG
        while here != goal:
            t += 1
            u, x = _unit_of(base + t * int(_C)), here - goal
            edge = starts[x]
            keep = own[edge - e]
            if bound:
                keep *= rest[tails[edge - e] - goal] / rest[x]
            if u >= keep:
                spread, most = (u - keep) / (1 - keep) * other[x], starts[x + 1] - 1
                edge = min(edge + 1, most)
                while upto[edge - e] <= spread and edge < most:
                    edge += 1
                bound = False
            path.append(edge)
            here = tails[edge - e]
        return path

    def edges_of(self, word: int, pieces: list[int]) -> list[int]:
        """The edges, last first, of a chunk's path given by its pieces, first to last."""
        node, out = int(self.last[word]), []
        for p in reversed(pieces):
            a = int(self.at[node])
            edge = a + self.piece[a : int(self.at[node + 1])].tolist().index(p)
            out.append(edge)
            node = int(self.tail[edge])
        return out

    def _alone(self, node: int, edges: list[int]) -> list[float]:
        """For each step of one path from ``node`` on, the probability of leaving the path there or later; 0 at its end."""
        e = np.array(edges)
        heads = np.concatenate([[node], self.tail[e[:-1]]])
        first, q, other = self.at[heads], self.q[e], self.other[heads]
        miss = np.where(e == first, other, self.q[first] + np.maximum(other - q, 0.0))
        out = [0.0]
        for m, x in zip(miss[::-1].tolist(), q[::-1].tolist(), strict=True):
            out.append(m + x * out[-1])
        out.reverse()
        return out

    def outside(self, word: int, taken: list[list[int]]) -> dict:
        """Probabilities of going on to a path not taken: per step and group of ``taken`` paths alike so far.

        A group of one path is a list (see ``_alone``), a larger one (first edge, edge weights, groups by edge).
        """
        tree: dict = {}
        open_, todo = [(0, 0, int(self.last[word]), list(range(len(taken))))], []
        while open_:
            key = step, name, node, members = open_.pop()
            if len(members) == 1:
                tree[step, name] = step, self._alone(node, taken[name][step:]), taken[name]
                continue
            used: dict[int, list[int]] = {}
            for m in members:
                used.setdefault(taken[m][step], []).append(m)
            todo.append((key, used))
            open_ += [(step + 1, ms[0], int(self.tail[edge]), ms) for edge, ms in used.items() if len(taken[ms[0]]) > step + 1]
        for (step, name, node, _), used in reversed(todo):  # deeper groups first
            a, b = int(self.at[node]), int(self.at[node + 1])
            weight = self.q[a:b].tolist()
            for edge, ms in used.items():
                below = tree.get((step + 1, ms[0]))
                weight[edge - a] *= 0.0 if below is None else below[1][0] if isinstance(below[2], list) else sum(below[1])
            tree[step, name] = a, weight, {edge: ms[0] for edge, ms in used.items()}
        return tree

    def mass_outside(self, word: int, taken: list[list[int]]) -> float:
        _, weight, of = self.outside(word, taken)[0, 0]
        return weight[0] if isinstance(of, list) else sum(weight)

    def draw_other(self, word: int, taken: list[list[int]], base: int) -> list[int]:
        """A path of a chunk, last edge first, that is none of ``taken``."""
        node, goal, path, tree = int(self.last[word]), int(self.first[word]), [], self.outside(word, taken)
        group = tree[0, 0]
        while node != goal:
            step, a = len(path), int(self.at[node])
            if group is None:
                weight = self.q[a : int(self.at[node + 1])].tolist()
            elif isinstance(group[2], list):
                weight = self.q[a : int(self.at[node + 1])].tolist()
                weight[group[2][step] - a] *= group[1][step - group[0] + 1]
            else:
                weight = group[1]
            left, pick = _unit_of(base + (step + 1) * int(_A)) * sum(weight), -1
            for i, w in enumerate(weight):
                if w > 0:
                    pick, left = i, left - w
                    if left < 0:
                        break
            pick += a
            path.append(pick)
            node = int(self.tail[pick])
            if group is not None and isinstance(group[2], list):
                group = group if group[2][step] == pick else None
            elif group is not None:
                group = tree[step + 1, group[2][pick]] if pick in group[2] else None
        return path


class Sampler:
    def __init__(self, coder: Coder, alpha: float = ALPHA):
        self.coder = coder
        ids = np.array(coder.plain)
        rank = np.array([coder.rank[i] for i in coder.plain])
        self.floor = float(np.log(np.sum(1.0 / (rank + 3.0))))
        log = alpha * (-np.log(rank + 3.0) - self.floor)
        self.byte_log = float(log.min()) if len(log) else -10.0
        names = [coder.model.id_to_piece(int(i)) for i in ids]
        self.ids, self.logs, self.longest = ids, log, max(map(len, names))
        self.hashes = np.array([self._hash(x) for x in names], np.uint64)
        # two tables by different bits of the hash; a piece that lost its slot in the first has one in the second
        self.shifts = [(np.uint64(64 - _FILTER_BITS), np.uint64((1 << _FILTER_BITS) - 1)), (np.uint64(20), np.uint64((1 << _FILTER_BITS) - 1))]
        self.tables = [np.full(1 << _FILTER_BITS, -1, np.int32) for _ in self.shifts]
        left = np.arange(len(names))
        for (shift, mask), slots in zip(self.shifts, self.tables, strict=True):
            where = (self.hashes[left] >> shift & mask).astype(np.int64)
            slots[where] = left
            left = left[slots[where] != left]
        self.rest = np.sort(left)  # of pieces without a slot, commonly none
        self.filter = np.zeros(1 << _FILTER_BITS, np.uint8)
        for bit, known in ((1, set(names)), (2, {x[n:] for x in names for n in range(1, len(x))})):
            slots = np.array([self._hash(x) for x in known], np.uint64) >> np.uint64(64 - _FILTER_BITS)
            self.filter[slots] |= bit
        self.byte_id = np.array([coder.byte_ids[b] for b in range(128)])
        self.lattices = Lattices(self)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for (shift, mask), slots in zip(self.shifts, self.tables, strict=True):
            slot = slots[(h[open_] >> shift & mask).astype(np.int64)]
            good = (slot >= 0) & (self.hashes[slot] == h[open_])
            out[open_[good]] = slot[good]
            open_ = open_[~good]
        for i in self.rest:
            out[open_[h[open_] == self.hashes[i]]] = i
        return out

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        code = np.array([ord(c) for c in piece], np.uint64)
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(code) - 1, _R)]))
        return (mix(code + _A) * up).sum(dtype=np.uint64)

    def sample(self, texts: list[list[str]], seeds: np.ndarray, k: int) -> list[list[tuple[bytes, float, float]]]:
        """For each chunked text up to k (ids, log-probability, inclusion score), best perturbed value first."""
        flat = [w.replace(MARK, " ") for t in texts for w in t]
        words = sorted(set(flat))
        place = {w: i for i, w in enumerate(words)}
        kinds = np.array([place[w] for w in flat], np.int64)
        with np.errstate(over="ignore"):  # hashing wraps
            known = self.lattices.begin_batch(pa.array(words, pa.utf8()), np.bincount(kinds, minlength=len(words)))
            return self.sample_kinds(known[kinds], np.array([len(t) for t in texts]), seeds, k)

    def sample_kinds(self, kind: np.ndarray, length: np.ndarray, seeds: np.ndarray, k: int) -> list[list[tuple[bytes, float, float]]]:
        """``sample`` of texts given as numbers of their chunks, ``length[i]`` of them for text i."""
        out: list[list] = [[] if n else [(b"", 0.0, 1.0)] for n in length.tolist()]
        full = np.flatnonzero(length)
        if not len(full):
            return out
        stop = np.cumsum(length[full])
        begin = stop - length[full]
        place = np.arange(len(kind)) - np.repeat(begin, length[full])
        noise = np.repeat(seeds[full], length[full]) + place.astype(np.uint64) * _A
        states = [_Search(s, self) for s in seeds[full].tolist()]
        begin, stop = begin.tolist(), stop.tolist()
        for s in range(k):
            turns = [x.next_region() for x in states]
            alive = [j for j, turn in enumerate(turns) if turn]
            if not alive:
                break
            for j in alive:
                states[j].open(kind[begin[j] : stop[j]], turns[j])
            at = np.array([begin[j] + turns[j][2] + 1 for j in alive])
            size = np.array([stop[j] for j in alive]) - at
            sub = np.arange(len(kind)) if not s else _runs(at, size)
            self._draw(kind[sub], noise[sub] + np.uint64(s) * _B, [states[j] for j in alive], size)
        for x, i in zip(states, full.tolist(), strict=True):
            out[i] = x.results()
        return out

    def _draw(self, word: np.ndarray, base: np.ndarray, states: list[_Search], size: np.ndarray) -> None:
        """Draw the free chunks of a sample of each text and hand each text its part."""
        lat, n = self.lattices, len(word)
        main, steps, far = lat.draw(word, base)
        count, log_p = np.zeros(n, np.int64), np.zeros(n)
        on = np.flatnonzero(main)
        count[on], log_p[on] = lat.main_count[word[on]], lat.main_log[word[on]]
        for t, (who, edge) in enumerate(steps):
            count[who] = t + 1
            log_p[who] += lat.log_q[edge]
        for i, path in far:
            count[i] += len(path)
            log_p[i] += math.fsum(lat.log_q[path].tolist())
        rest = -np.expm1(log_p)
        rest[on] = lat.main_rest[word[on]]
        ends = np.cumsum(count)
        pieces = np.zeros(int(ends[-1]) if n else 0, np.int32)
        if len(on):
            many = count[on]
            pieces[_runs(ends[on] - many, many)] = lat.main_piece[_runs(lat.main_at[word[on]], many)]
        for t, (who, edge) in enumerate(steps):
            pieces[ends[who] - 1 - t] = lat.piece[edge]
        for i, path in far:
            pieces[ends[i] - count[i] : ends[i] - LONG] = lat.piece[path[::-1]]
        a = 0
        ends = np.concatenate([[0], ends])
        for x, m in zip(states, size.tolist(), strict=True):
            x.close(log_p[a : a + m], rest[a : a + m], ends[a : a + m + 1], pieces)
            a += m

    def spelled(self, pieces: np.ndarray) -> bytes:
        """Ids of pieces, with characters that have no piece spelled in bytes."""
        odd = np.flatnonzero(pieces >= 1 << 16)
        if len(odd):
            known = {c: [self.coder.byte_ids[b] for b in chr(c - (1 << 16)).encode("utf-8", "surrogatepass")] for c in set(pieces[odd].tolist())}
            flat = pieces.tolist()
            pieces = np.array([i for p in flat for i in (known[p] if p >= 1 << 16 else (p,))])
        return pieces.astype("<u2").tobytes()


class _Sample:
    """A drawn segmentation of a text: the region it came from and those it leaves."""

    __slots__ = ("place", "time", "before", "head", "prefix", "own", "taken", "sums", "rates", "ends", "drawn", "next", "pops")

    def before_at(self, n: int) -> float:
        """Log-probability of the chunks before chunk n."""
        i = n - self.place - 1
        return self.before if i < 0 else self.head + (float(self.sums[i - 1]) if i else 0.0)

    def pieces_to(self, n: int) -> np.ndarray:
        i = n - self.place - 1
        return self.prefix if i < 0 else np.concatenate([self.prefix, self.own, self.drawn[: self.ends[i]]])

    def pieces_at(self, n: int) -> list[int]:
        i = n - self.place - 1
        return self.drawn[self.ends[i] : self.ends[i + 1]].tolist()

    def wait(self, seed: int) -> None:
        """Draw when the best of the regions left arrives."""
        total = float(self.rates.sum())
        self.next = self.time - math.log(_unit_of(seed + self.pops * int(_C))) / total if total > 0 else math.inf
        self.pops += 1


class _Search:
    """The search over the segmentations of one text."""

    __slots__ = ("seed", "samples", "sampler")

    def __init__(self, seed: int, sampler: Sampler):
        self.seed, self.sampler, self.samples = seed, sampler, []

    def _seed(self, what: int, sample: int) -> int:
        return _unit_seed(self.seed ^ (what * 0x2545F4914F6CDD1D & _WORD), sample)

    def next_region(self) -> tuple[float, int, int] | None:
        """(time, sample it belongs to, chunk at which it parts from that) of the best region left."""
        if not self.samples:
            return -math.log(_unit_of(self._seed(1, 0))), -1, -1
        p, x = min(enumerate(self.samples), key=lambda i: i[1].next)
        if x.next == math.inf:
            return None
        sums = np.cumsum(x.rates)
        pick = int(np.searchsorted(sums, _unit_of(self._seed(2, p) + x.pops * int(_A)) * float(sums[-1]), side="right"))
        if pick == len(sums):
            pick = int(np.flatnonzero(x.rates)[-1])
        x.rates[pick], x.time = 0.0, x.next
        x.wait(self._seed(3, p))
        return x.time, p, pick + max(x.place, 0)

    def open(self, kind: np.ndarray, turn: tuple[float, int, int]) -> None:
        """Begin a sample: what it has of its parent, and its own path where it parts."""
        lat, new = self.sampler.lattices, _Sample()
        new.time, p, new.place = turn
        new.pops, new.taken = 0, []
        new.prefix = new.own = np.zeros(0, np.int32)
        new.before = new.head = 0.0
        new.rates = np.zeros(0)
        if p >= 0:
            parent, a = self.samples[p], new.place
            word = int(kind[a])
            taken = parent.taken if a == parent.place else [lat.edges_of(word, parent.pieces_at(a))]
            path = lat.draw_other(word, taken, self._seed(4, len(self.samples)))
            new.taken = [*taken, path]
            new.before, new.prefix = parent.before_at(a), parent.pieces_to(a)
            new.own = lat.piece[path[::-1]]
            new.head = new.before + math.fsum(lat.log_q[path].tolist())
            new.rates = np.array([math.exp(new.before) * lat.mass_outside(word, new.taken)])
        self.samples.append(new)

    def close(self, log_p: np.ndarray, rest: np.ndarray, ends: np.ndarray, pieces: np.ndarray) -> None:
        """Take the free chunks' draws: log-probabilities, masses of all else, and pieces."""
        x = self.samples[-1]
        x.sums = np.cumsum(log_p)
        x.drawn, x.ends = pieces[ends[0] : ends[-1]], ends - ends[0]
        before = np.empty(len(log_p))
        before[:1], before[1:] = x.head, x.head + x.sums[:-1]
        x.rates = np.concatenate([x.rates, np.exp(before) * rest])
        x.wait(self._seed(3, len(self.samples) - 1))

    def results(self) -> list[tuple[bytes, float, float]]:
        limit, out = min(x.next for x in self.samples), []
        for x in self.samples:
            log_p = x.head + (float(x.sums[-1]) if len(x.sums) else 0.0)
            late = log_p + math.log(limit) if limit < math.inf else math.inf
            out.append((self.sampler.spelled(x.pieces_to(x.place + 1 + len(x.sums))), log_p, -math.expm1(-math.exp(late)) if late < 700 else 1.0))
        return out


def _unit_seed(seed: int, n: int) -> int:
    """Another 64-bit word for number n below a seed."""
    x = (seed + (n + 1) * 0x9E3779B97F4A7C15) & _WORD
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WORD
    return x ^ x >> 31


_loaded: dict[tuple[str, float], tuple[Coder, Sampler]] = {}


def loaded(path: str, alpha: float = ALPHA) -> tuple[Coder, Sampler]:
    if (path, alpha) not in _loaded:
        coder = Coder(path)
        _loaded[path, alpha] = coder, Sampler(coder, alpha)
    return _loaded[path, alpha]


_NO_KEY = np.uint64(0x5851F42D4C957F2D)


def seeds_of(keys: pa.Array) -> np.ndarray:
    """A 64-bit seed for each 64-bit integer key, nulls included."""
    null = pc.is_null(keys).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        return np.where(null, _NO_KEY, mix(pc.fill_null(keys, 0).to_numpy().view(np.uint64) + _C))


ADDED = "ids binary, decoded string, samples array<struct<ids: binary, log_prob: double, inclusion: double>>"
_SAMPLE = pa.struct([("ids", pa.binary()), ("log_prob", pa.float64()), ("inclusion", pa.float64())])


def _bytes_array(kind: pa.DataType, data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _processed(coder: Coder, sampler: Sampler, data: np.ndarray, row: np.ndarray, seeds: np.ndarray, k: int) -> list[pa.Array]:
    """Columns ``ids``, ``decoded`` and ``samples`` of texts in UTF-8, text i from row[i] to row[i + 1], each begun by a space unless empty."""
    mark, feed = data == 32, data == 10
    start = feed.copy()
    start[1:] |= feed[:-1] | (mark[1:] & ~mark[:-1])
    start[row[:-1][np.diff(row) > 0]] = True
    begin = np.flatnonzero(start)
    chunk = _bytes_array(pa.utf8(), data, np.append(begin[1:], len(data))[: len(begin)]).dictionary_encode()
    kind = chunk.indices.to_numpy()
    with np.errstate(over="ignore"):  # hashing wraps
        known = sampler.lattices.begin_batch(chunk.dictionary, np.bincount(kind, minlength=len(chunk.dictionary)))
        kind = known[kind]
        cut = np.searchsorted(begin, row)
        found = sampler.sample_kinds(kind, np.diff(cut), seeds, k)
    lat = sampler.lattices
    count = lat.ids_count[kind]
    ids = lat.ids[_runs(lat.ids_at[kind], count)]
    ends = np.concatenate([[0], np.cumsum(count)])[cut]
    text, stop = coder.spell(ids, ends)
    flat = [x for s in found for x in s]
    each = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.binary()), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())], fields=list(_SAMPLE))
    samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), each)
    return [_bytes_array(pa.binary(), ids.astype("<u2").view(np.uint8), ends[1:] * 2), _bytes_array(pa.utf8(), text, stop), samples]


def encode_and_sample(df: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: ``key``) of ``df`` and per row ``ids``, ``decoded`` and ``samples``."""
    keep, file = [key] if keep is None else keep, shipped(df.sparkSession, model)
    plain = F.replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(MARK), F.lit(" "))
    begun = F.when(plain == "", plain).otherwise(F.concat(F.lit(" "), plain))
    rows = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{key}`").cast("long").alias("__key"), begun.alias("__text"))
    fields = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sampler = loaded(received(file), alpha)
        for batch in batches:
            texts = batch.column("__text").cast(pa.utf8())
            seeds = seeds_of(batch.column("__key"))
            row = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            a = 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(row, row[a] + TOGETHER)))
                b = min(b, len(texts))
                own = _processed(coder, sampler, data[row[a] : row[b]], row[a : b + 1] - row[a], seeds[a:b], k)
                kept = [batch.column(f"k{i}").slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *own], [*(f"k{i}" for i in range(len(keep))), "ids", "decoded", "samples"])
                a = b
            pa.default_memory_pool().release_unused()  # else a worker holds on to its peak

    done = rows.mapInArrow(run, f"{fields}, {ADDED}" if fields else ADDED)
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "ids", "decoded", "samples")


def report(df: DataFrame, model: str, k: int = SAMPLES) -> DataFrame:
    """Digests of the ids and of each sample, and whether decoding gives the text again."""
    rows = df.select("doc_id", F.col("text").alias("source_text"))
    done = encode_and_sample(rows, model, k, text="source_text", keep=["doc_id", "source_text"])
    same = F.col("decoded") == F.replace(F.coalesce("source_text", F.lit("")), F.lit(MARK), F.lit(" "))
    n = lambda x: (F.octet_length(x) / 2).cast("long")
    return done.select(
        "doc_id",
        n("ids").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        same.alias("round_trip"),
        F.transform("samples", lambda s: (F.octet_length(s["ids"]) / 2).cast("long")).alias("sample_tokens"),
        F.transform("samples", lambda s: F.crc32(s["ids"])).alias("sample_crc32"),
        F.transform("samples", lambda s: s["log_prob"]).alias("sample_log_prob"),
        F.transform("samples", lambda s: s["inclusion"]).alias("sample_inclusion"),
    )
