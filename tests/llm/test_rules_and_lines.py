import random
import re

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyrank.llm import line_dedup, quality_rules
from tallyrank.llm.common import words_of


def figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "\x0b\x0c\r x", "é ß 漢字 \xa0 z", "x " * 9000, "# $ % & * | < >\n" * 30]
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 80))]
        out.append("".join(x + rng.choice([" ", "\n", "  "]) for x in words))
    return out


def test_base_figures_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if not t or len(t) < 5000]
    got = quality_rules.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        want = figures(rows[[d for d, _ in rows].index(r.doc_id)][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_long_text_and_order_independence(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first_rule", F.lit(1)).withColumn("w", F.lit(2))
    rules = quality_rules.default_rules()
    kept = [sorted(r.doc_id for r in df.where(quality_rules.verdict(F.col("text"), order).isNull()).collect()) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1] == sorted(r.doc_id for r in quality_rules.keep_good(df).collect())
    assert quality_rules.keep_good(df).columns == df.columns
    assert sorted(r.doc_id for r in quality_rules.report(df).where("kept").collect()) == kept[0]


def test_rules_are_ordered_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "w " * (5 if i % 2 else 50)) for i in range(200)], "doc_id long, text string")
    order = quality_rules.order_rules(df, quality_rules.default_rules())
    worth = [share / max(cost, 1e-6) for _, cost, share in order]
    assert worth == sorted(worth, reverse=True) and {r.name: s for r, _, s in order}["too_few_words"] > 0.2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.report(df).count() == 0 and quality_rules.keep_good(df).count() == 0 and line_dedup.report(df).count() == 0


def h64(data, seed=42):
    x = xxhash.xxh64_intdigest(data, seed=seed)
    return x - (1 << 64) if x >= 1 << 63 else x


def chunks(text):
    lines = text.split("\n")
    hashes = [h64(x.encode()) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        seed = 42
        for w in range(line_dedup.WINDOW - 1, -1, -1):
            if i - w >= 0:
                seed = h64(hashes[i - w].to_bytes(8, "little", signed=True), seed & (2**64 - 1))
        if i == len(lines) - 1 or seed % line_dedup.DIVISOR == 0:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def spans(text):
    """(first, lines) of the chunks of two or more lines and of the shortest runs over 50 words from and up to each line with words."""
    lines, out, at = text.split("\n"), set(), 0
    for c in chunks(text):
        out |= {(at, len(c))} if len(c) > 1 else set()
        at += len(c)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    for i in (i for i, n in enumerate(words) if n):
        ahead = next((j for j in range(i, len(lines)) if sum(words[i : j + 1]) > line_dedup.MIN_WORDS), None)
        back = next((j for j in range(i, -1, -1) if sum(words[j : i + 1]) > line_dedup.MIN_WORDS), None)
        out |= {(i, ahead - i + 1)} if ahead is not None else set()
        out |= {(back, i - back + 1)} if back is not None else set()
    return {(a, n, "\n".join(lines[a : a + n])) for a, n in out if any(words[a : a + n])}


def brute(docs):
    """The documents without the spans that stand further ahead."""
    first, cut = {}, {}
    rank = lambda d: (d is None, d or 0)
    for d, t in docs:
        for a, _, body in spans(t) if t is not None else ():
            first[body] = min(first.get(body, (rank(d), a)), (rank(d), a))
    for d, t in docs:
        if t is not None:
            gone = {x for a, n, body in spans(t) if not (first[body][0] == rank(d) and a < first[body][1] + n) for x in range(a, a + n)}
            cut[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return cut


def test_line_chunks_equal_brute_force(spark):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["sun", "moon", "star", "sky"]) + str(rng.randrange(40)) for _ in range(3))
    passages = [[line() for _ in range(8)] for _ in range(4)]
    docs = []
    for i in range(80):
        parts = [[line() for _ in range(rng.randint(0, 6))] for _ in range(2)]
        if rng.random() < 0.7:
            parts.insert(1, rng.choice(passages))
        docs.append((i, "\n".join(x for p in parts for x in p)))
    docs += [(100, "\n\n\n\n"), (101, "\n\n\n\n"), (102, ""), (103, None), (104, "only one line"), (105, "only one line")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("ks", F.lit(1)).withColumn("spans", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    assert {d: t for d, t in got.items() if t is not None} == brute(docs) and got[103] is None
    assert line_dedup.clean(df).columns == df.columns
    removed = {r.doc_id: r.n_lines_removed for r in line_dedup.report(df).collect()}
    assert sum(removed.values()) > 100 and removed[104] == 0


def test_shifted_passage_goes(spark):
    passage = "\n".join(f"line number {i} of the passage" for i in range(30))
    df = spark.createDataFrame([(1, passage), (2, "a new first line\n" + passage), (None, passage)], "doc_id long, text string")
    got = {r.doc_id: r.n_lines_removed for r in line_dedup.report(df).collect()}
    # chunks of one line are never removed, so a few lines of the passage stay
    assert got[1] == 0 and got[2] >= 20 and got[None] >= 20


def test_words_of_nulls(spark):
    assert spark.range(1).select(words_of(F.lit(None).cast("string")).alias("w")).collect()[0].w == []


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([Row(doc_id=1, text="a\nb\nc\nd"), Row(doc_id=1, text="a\nb\nc\nd")])
    assert [r.text for r in line_dedup.clean(df).collect()] == ["a\nb\nc\nd"] * 2


@pytest.mark.parametrize("n", [2, 3])
def test_rejects_repeated_words(spark, n):
    df = spark.createDataFrame([(1, "word " * 10 * n)], "doc_id long, text string")
    assert quality_rules.keep_good(df).count() == 0


def test_null_and_equal_ids(spark):
    text = "\n".join(f"line number {i} of the passage" for i in range(30))
    rows = [(None, text), (None, "other start\n" + text), (None, None), (7, "x\n" + text), (7, "y\n" + text), (7, "y\n" + text), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.report(df).collect()
    assert len(got) == len(rows)
    kept = [(r.doc_id, r.text) for r in got if r.n_lines_removed == 0 and r.text]
    # of document 7 one text keeps the passage (the repeated row is the same document); the null ids' lose it
    assert len({t for d, t in kept}) == 1 and {d for d, _ in kept} == {7}
    assert all(r.n_lines_removed == 30 for r in got if r.doc_id is None and r.text is not None)


def test_rules_on_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, good), (None, good), (None, "short"), (1, good), (1, good), (1, "short"), (2, None), (3, ""), (4, good + " x" * 200_000), (5, good + "".join(f" w{i}" for i in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("n_words", F.lit(1)).withColumn("first_rule", F.lit("x")).withColumn("kept", F.lit(0))
    got = quality_rules.report(df.repartition(3)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.kept) for r in got) == [((False, 1), False), ((False, 1), True), ((False, 1), True), ((False, 2), False), ((False, 3), False), ((False, 4), False), ((False, 5), True), ((True, 0), False), ((True, 0), True), ((True, 0), True)]
    assert {r.doc_id: r.n_words for r in got}[5] == 60_040
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 5]
