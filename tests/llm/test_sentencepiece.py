import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from tallyrank.llm import sentencepiece_sampling as sps

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return sps.loaded(PATH, sps.ALPHA)


def segmentations(coder, sampler, word):
    """All paths of one chunk with their unnormalised log weights, by plain recursion."""
    logs = {int(i): float(w) for i, w in zip(sampler.ids, sampler.logs, strict=True)}
    if not word:
        return [((), 0.0)]
    out = []
    for n in range(1, len(word) + 1):
        i = coder.pieces.get(word[:n])
        if i is not None:
            head, w = (i,), logs[i]
        elif n == 1:
            raw = word[0].encode()
            head, w = tuple(coder.byte_ids[b] for b in raw), sampler.byte_log * len(raw)
        else:
            continue
        out += [(head + t, w + v) for t, v in segmentations(coder, sampler, word[n:])]
    return out


def whole(coder, sampler, text):
    """ids -> probability over all segmentations of a text."""
    parts = [segmentations(coder, sampler, w) for w in coder.split(text)]
    weights = {sum((p for p, _ in c), ()): sum(w for _, w in c) for c in itertools.product(*parts)}
    z = math.log(sum(math.exp(w) for w in weights.values()))
    return {ids: math.exp(w - z) for ids, w in weights.items()}


def seeds(keys):
    return sps.seeds_of(pa.array(keys, pa.int64()))


def as_ids(data):
    return tuple(np.frombuffer(data, "<u2").tolist())


def test_encode_and_decode_equal_library(pair):
    coder, _ = pair
    rng = random.Random(4)
    pool = "ab cdé  \n\t\r.,-ñ漢\U0001f600▁xyz The "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", " ", "\n", "   ", "a" * 3000, "Hello  world\n\nagain "]
    for t in texts:
        ids = coder.encode(t)
        assert list(as_ids(ids)) == coder.model.encode(t), repr(t)
        assert coder.decode(ids) == coder.model.decode(coder.model.encode(t)) == t.replace("▁", " ")


def test_probabilities_and_distinctness(pair):
    coder, sampler = pair
    for text in ["the cats", "ab\nth", "漢a b", "in the"]:
        true = whole(coder, sampler, text)
        got = sampler.sample([coder.split(text)] * 50, seeds(range(50)), 5)
        for samples in got:
            ids = [as_ids(x) for x, _, _ in samples]
            assert len(set(ids)) == len(ids) == min(5, len(true))
            for i, (x, log_p, inclusion) in zip(ids, samples, strict=True):
                assert math.isclose(math.exp(log_p), true[i], rel_tol=1e-9)
                assert 0 < inclusion <= 1 and coder.decode(x) == text


def test_all_segmentations_come_out(pair):
    coder, sampler = pair
    true = whole(coder, sampler, "in a")
    (got,) = sampler.sample([coder.split("in a")], seeds([1]), 10_000)
    assert {as_ids(x) for x, _, _ in got} == set(true)
    assert all(q == 1.0 for _, _, q in got)


def test_first_two_follow_sampling_without_replacement(pair):
    coder, sampler = pair
    text, n = "of it", 6000
    true = whole(coder, sampler, text)
    got = sampler.sample([coder.split(text)] * n, seeds(range(n)), 2)
    first = Counter(as_ids(s[0][0]) for s in got)
    pairs = Counter((as_ids(s[0][0]), as_ids(s[1][0])) for s in got)
    for a, p in true.items():
        assert abs(first[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for b, q in true.items():
            if a != b:
                want = p * q / (1 - p)
                assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_inclusion_scores_are_unbiased(pair):
    coder, sampler = pair
    n, text = 4000, "the it"
    got = sampler.sample([coder.split(text)] * n, seeds(range(n)), 3)
    mean = np.mean([sum(math.exp(p) / q for _, p, q in s) for s in got])
    assert abs(mean - 1) < 0.03


def test_rows(spark):
    rows = [Row(doc_id=1, text="the cat sat", ids=7), Row(doc_id=None, text="x", ids=7), Row(doc_id=2, text=None, ids=None), Row(doc_id=3, text="", ids=1), Row(doc_id=1, text="the cat sat", ids=8), Row(doc_id=4, text="word " * 9000 + "z" * 4000, ids=1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = {str(r.doc_id): r for r in sps.report(df.repartition(3), PATH).collect()}
    again = {str(r.doc_id): r for r in sps.report(df.coalesce(1), PATH).collect()}
    assert got == again and all(r.round_trip for r in got.values())
    assert got["2"].sample_tokens == got["3"].sample_tokens == [0] and got["2"].sample_inclusion == [1.0]
    assert len(set(got["4"].sample_crc32)) == sps.SAMPLES
    assert sps.report(df.limit(0), PATH).count() == 0


def test_other_path_avoids_all_taken(pair):
    coder, sampler = pair
    lat = sampler.lattices
    word = " thing"
    number = int(lat.begin_batch(pa.array([word]), np.array([2]))[0])
    true = segmentations(coder, sampler, word.replace(" ", "▁"))
    z = math.log(sum(math.exp(w) for _, w in true))
    true = {ids: math.exp(w - z) for ids, w in true}
    paths = [lat.edges_of(number, list(ids)) for ids in true]
    rng = random.Random(1)
    for n in (1, 2, 3, 7, len(paths) - 1):
        taken = rng.sample(paths, n)
        left = [ids for ids, p in zip(true, paths, strict=True) if p not in taken]
        assert math.isclose(lat.mass_outside(number, taken), sum(true[i] for i in left), rel_tol=1e-9)
        got = Counter(tuple(lat.piece[lat.draw_other(number, taken, 7919 * i * i)][::-1].tolist()) for i in range(3000))
        assert set(got) <= set(left)
        for ids in left:
            p = true[ids] / sum(true[i] for i in left)
            assert abs(got[ids] / 3000 - p) < 5 * math.sqrt(p * (1 - p) / 3000) + 1e-3
    assert lat.mass_outside(number, paths) == 0


def test_long_unbroken_chunks(pair):
    coder, sampler = pair
    for text in ["ab" * 40_000, "x" * 30_000 + "ñ漢" * 50, "the" * 60]:
        began = time.perf_counter()
        (got,) = sampler.sample([coder.split(text)], seeds([3]), 3)
        assert time.perf_counter() - began < 10  # under a second where nothing else runs
        assert len({x for x, _, _ in got}) == 3 and all(coder.decode(x) == text for x, _, _ in got)
        logs = {int(i): float(w) for i, w in zip(sampler.ids, sampler.logs, strict=True)} | {i: sampler.byte_log for i in coder.byte_ids.values()}
        weight = [sum(logs[i] for i in as_ids(x)) for x, _, _ in got]
        assert all(math.isclose(weight[i] - weight[0], got[i][1] - got[0][1], rel_tol=1e-6, abs_tol=1e-6) for i in (1, 2))


def test_what_a_worker_keeps_changes_nothing(pair, monkeypatch):
    coder, sampler = pair
    texts = [coder.split(t) for t in ["the cat sat on the mat", "the dog\nran", "caterpillars crawl " * 20]]
    first = sampler.sample(texts, seeds([1, 2, None]), 3)
    monkeypatch.setattr(sps, "KEEP", 2)
    for _ in range(3):
        assert sampler.sample(texts, seeds([1, 2, None]), 3) == first
    alone = [sampler.sample([t], seeds([k]), 3)[0] for t, k in zip(texts, [1, 2, None], strict=True)]
    assert alone == first


def test_chunks_share_the_nodes_of_common_beginnings(pair):
    coder, _ = pair
    lat = sps.Sampler(coder).lattices
    words = [" them", " the", " then", " a", "\n", "漢a", "漢b", " theme", " th", " " + "tea" * 20, " " + "tea" * 20 + "s", "tea"]
    count = np.array([2, 1, 2, 1, 2, 1, 2, 1, 1, 2, 1, 1])
    with np.errstate(over="ignore"):
        number = lat.begin_batch(pa.array(words), count)
    # what stays: the first node, " the" with "m" and "n", the line feed, two more characters, and a long chunk of its own
    assert lat.kept[0] == 1 + 4 + 2 + 1 + 2 + (1 + 61)
    assert lat.kept[2] == 5 and sorted(number.tolist()) == list(range(len(words)))
    for w, k in zip(words, number.tolist(), strict=True):
        if len(w) > sps.LONG:
            assert lat.last[k] - lat.first[k] == len(w)
            continue
        for ids, weight in (true := segmentations(coder, lat.sampler, w.replace(" ", sps.MARK))):
            if all(i < 1 << 16 and i not in coder.byte_ids.values() for i in ids):
                z = math.log(sum(math.exp(v) for _, v in true))
                assert math.isclose(sum(lat.log_q[lat.edges_of(k, list(ids))]), weight - z, rel_tol=1e-9, abs_tol=1e-12)
    kept = [w for w, n in zip(words, count, strict=True) if n > 1]
    with np.errstate(over="ignore"):
        again = lat.begin_batch(pa.array([*kept, " thenx"]), np.ones(len(kept) + 1, int))
    assert again[:-1].tolist() == [int(number[words.index(w)]) for w in kept]
    whole_path = [a for a in segmentations(coder, lat.sampler, "▁thenx")]
    z = math.log(sum(math.exp(v) for _, v in whole_path))
    assert all(math.isclose(sum(lat.log_q[lat.edges_of(int(again[-1]), list(ids))]), v - z, rel_tol=1e-9) for ids, v in whole_path)
