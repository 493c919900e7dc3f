import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrank.llm import decontaminate, quality_rules
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_rules_and_lines import brute as lines_brute

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sentence = lambda n: " ".join(word() for _ in range(n))
    items = [(i, sentence(12)) for i in range(3)]
    passage = "\n".join(sentence(6) for _ in range(12))
    docs = []
    for i in range(60):
        lines = [sentence(8) for _ in range(6)]
        if i % 5 == 0:
            lines[3:3] = passage.split("\n")
        if i % 7 == 0:
            lines.insert(2, items[i % 3][1])
        text = "\n".join(lines)
        if i % 9 == 8:
            text = docs[i - 1][1].replace("a", "b", 1)
        if i % 11 == 10:
            text = "short text"
        docs.append((i, text, "en", "s", len(text)))
    return docs, items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want, now = {d: t for d, t, *_ in docs}, df
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == df.columns, name
        got = {r.doc_id: r.text for r in out.collect()}
        if n == 0:
            want = {d: t for d, t in want.items() if len(t.split()) >= 20}
        elif n == 1:
            want = lines_brute(list(want.items()))
        elif n == 2:
            kept = near_brute(list(want.items()), k=5)
            want = {d: t for d, t in want.items() if kept[d][2]}
        else:
            hit = lambda t: any(decontaminate.normal(p) in decontaminate.normal(t) for _, p in items)
            want = {d: t for d, t in want.items() if not hit(t)}
        assert got == want, name
        out.write.parquet(str(tmp_path / f"s{n}"))
        now = spark.read.parquet(str(tmp_path / f"s{n}"))
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(last) == set(want)
    from tallyrank.llm.sentencepiece_sampling import loaded

    coder, _ = loaded(public_tokenizers.path("piece_bpe_32k.model"))
    for d, r in last.items():
        assert np.frombuffer(r.ids, "<u2").tolist() == coder.model.encode(want[d]) and len(r.samples) == 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rules_have_names():
    names = [r.name for r in quality_rules.default_rules()]
    assert len(set(names)) == len(names)


def test_odd_rows_in_every_stage(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    good, long = words(60), "\n".join(words(12) for _ in range(4000))
    rows = [(1, good), (1, good), (2, good.upper()), (None, words(40)), (None, words(40)), (3, None), (4, ""), (5, long), (6, words(30)), (6, words(30)), (7, "copy of the item: " + "the quick brown fox jumps over the lazy dog " * 3 + words(30))]
    odd = "spans hits ks k h w n kept label component cluster node region sig hash digest first base ids samples __key value text2 id".split()
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in odd:
        df = df.withColumn(c, F.lit(1))
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = df.repartition(3)
    counts = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))  # each on rows that earlier stages would have removed
        got = out.collect()
        counts.append(len(got))
        if n < 4:
            assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
        assert sum(r.doc_id is None for r in got) == 2, name
    # rules: no null, no empty text, and document 7 repeats itself; lines: all; near copies: document 2 goes; benchmark: document 7 goes; all are encoded
    assert counts == [8, 11, 10, 10, 11]
