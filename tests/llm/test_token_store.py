import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from tallyrank.llm import elias_fano, token_store
from tallyrank.llm.common import scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-3, 0, 7, 7, 1000], list(range(0, 100000, 37)), [0] * 600 + [2**40]])
def test_elias_fano_round_trip_and_select(values):
    ef = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.int64)))
    assert ef.decode().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 50)):
        assert ef.access(i) == values[i]
    for a in range(0, len(values), max(1, len(values) // 20)):
        for n in (1, 7, 300, len(values)):
            assert ef.access_many(np.arange(a, min(len(values), a + n))).tolist() == values[a : a + n]
    for x in {*values[:: max(1, len(values) // 30)], -10, 50, 2**41}:
        assert ef.first_at_least(x) == sum(v < x for v in values)


def test_elias_fano_is_near_minimal():
    values = np.sort(np.random.default_rng(1).integers(0, 10_000_000, 20_000))
    bits = 8 * len(elias_fano.encode(values)) / len(values)
    assert bits < 2.6 + np.log2(10_000_000 / 20_000)


def test_fast_words_equal_library():
    enc = token_store.WordEncoder(PATH)
    rng = random.Random(3)
    pool = "abcXYZ 019 \t\n.,;!?'\"#$%éÉßñÆø½²ªº-_<>|’Σ漢字́İ\x0b\xa0"
    texts = ["".join(rng.choice(pool[: rng.choice([20, 40, len(pool)])]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["we're they'll I'd it's 'tis 'real", "a<|endoftext|>b", "DON'T'S..'s", "", "x" * 5000]
    for t in texts:
        assert enc.encode(t) == enc.encode_whole(t), t
    raw = [t.encode() for t in texts]
    row = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    fresh = token_store.WordEncoder(PATH)
    for _ in range(2):
        ids, ends = fresh.encode_batch(np.frombuffer(b"".join(raw), np.uint8), row)
        assert [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [enc.encode_whole(t) for t in texts]


def test_letters_that_grow_in_lower_case():
    enc = token_store.WordEncoder(PATH)
    plain = [chr(i) for i in range(33, 0x250)]
    for t in ["aȺb", "Ⱦx 1", *(f"a{c}B{c}{c}1{c}" for c in plain), "".join(plain), " ".join(plain)]:
        assert enc.encode(t) == enc.encode_whole(t), t


def test_a_full_memory_keeps_what_is_frequent(monkeypatch):
    monkeypatch.setattr(token_store, "MEMO", 40)
    monkeypatch.setattr(token_store, "KEEP", 5)
    enc, rng = token_store.WordEncoder(PATH), random.Random(8)
    asked = []
    learn = enc._learn
    monkeypatch.setattr(enc, "_learn", lambda words: (asked.extend(words), learn(words)))
    for i in range(60):
        odd = ["".join(rng.choice("abcdeé") for _ in range(6)) for _ in range(9)]
        text = " ".join([*odd, f"the{'!' * (i % 7)}", "cat's", "漢字", "漢字", "bb", "bb"])
        assert enc.encode(text) == enc.encode_whole(text)
        assert len(enc.memo) == len(enc.word_ids) == len(enc.word_size) == len(enc.uses) <= 40 and len(enc.kept) == len(enc.kept_ids) <= 5 + 2
    assert asked.count("the") == asked.count("'s") == 1 and len(asked) > 400


def test_store_round_trip(spark, monkeypatch):
    docs = [Row(doc_id=i, text=t, extra=1, start=2) for i, t in [(3, "the cat"), (1, None), (None, "no id"), (2, ""), (3, "the cat"), (9, "word " * 3000)]]
    path = scratch(spark, "t")
    token_store.write_documents(spark.createDataFrame(docs), path, PATH, 1)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    enc, at = token_store.WordEncoder(PATH), 0
    order = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in order]
    for r, d in zip(got, order, strict=True):
        ids = enc.tokenizer.encode(d.text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    rows = spark.read.parquet(path).where("n_docs > 0").collect()
    assert sum(token_store.fetch(r, r.n_docs - 1)[-1] == 1 for r in rows) == len(rows)


def test_other_files_go_through_the_library(tmp_path):
    import json

    text = json.loads(token_store.WordEncoder(PATH).tokenizer.to_str())
    text["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\\p{L}+|\\p{N}+"}
    (tmp_path / "t.json").write_text(json.dumps(text))
    enc = token_store.WordEncoder(str(tmp_path / "t.json"))
    assert not enc.known and token_store.WordEncoder(PATH).known
    assert enc.encode("Room 1234!") == enc.encode_whole("Room 1234!") != token_store.WordEncoder(PATH).encode("Room 1234!")


def test_many_segments_and_partitions_equal_library(spark, monkeypatch):
    rng = random.Random(5)
    pool = ["The", "cats", "don't", "sit", "42", "...", "漢字", "naïve", "caterpillar", "\n", "x" * 30]
    docs = [(rng.choice([None, rng.randrange(400)]) if i % 9 == 0 else i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 500)
    monkeypatch.setattr(token_store, "SELECT", 5)
    path = scratch(spark, "t")
    token_store.write_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), path, PATH, 1)
    store = spark.read.parquet(path)
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert store.count() > 10 and [r.doc_id for r in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    enc, at = token_store.WordEncoder(PATH), 0
    want = {}
    for d, t in docs:
        ids = enc.tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want.setdefault(d, []).append(ids)
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want[r.doc_id]}
        at += r.n_tokens
    some = [5, 18, 77, 399, 1000, -3]
    fetched = token_store.documents_by_id(spark, path, some).collect()
    assert sorted((r.doc_id, r.ids) for r in fetched) == sorted((d, x) for d in some for x in want.get(d, []))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_store.report(df, PATH).count() == 0
