"""Passages of over 50 words that an earlier document holds go whole, whatever their number of lines."""

import random

import pytest

from tallyrank.llm import line_dedup


def brute(docs):
    """Per document the line numbers in a run of over 50 words that an earlier document holds (blank lines at its ends left out)."""
    gone = {}
    for n, (d, t) in enumerate(docs):
        lines, out = t.split("\n"), set()
        for _, other in docs[:n]:
            theirs = other.split("\n")
            for i in range(len(lines)):
                for j in range(len(theirs)):
                    k = 0
                    while i + k < len(lines) and j + k < len(theirs) and lines[i + k] == theirs[j + k]:
                        k += 1
                    run = list(range(i, i + k))
                    while run and not lines[run[0]].split():
                        run.pop(0)
                    while run and not lines[run[-1]].split():
                        run.pop()
                    if sum(len(lines[x].split()) for x in run) > 50:
                        out |= set(run)
        gone[d] = out
    return gone


def corpus(seed=4):
    rng = random.Random(seed)
    line = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(n))
    shapes = [[51], [60], [400], [25, 26], [30, 40], [17, 17, 17], [1, 60, 1], [20, 0, 0, 40], [13] * 4, [9] * 6, [5] * 12, [7, 50, 2, 2]]
    passages = [[line(n) for n in shape] for shape in shapes]
    docs = []
    for i in range(60):
        parts = [[line(rng.choice([0, 3, 10, 30])) for _ in range(rng.randint(0, 4))] for _ in range(3)]
        parts[1:1] = [passages[i % len(passages)]]
        parts[3:3] = [rng.choice(passages)] if i % 3 == 0 else []
        docs.append((i, "\n".join(x for p in parts for x in p)))
    return docs


def test_passages_over_50_words_go_whole(spark):
    docs = corpus()
    want = brute(docs)
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    words = {d: sum(len(x.split()) for k, x in enumerate(t.split("\n")) if k in want[d]) for d, t in docs}
    assert sum(words.values()) > 3000
    for d, t in docs:
        left = got[d].split("\n")
        # nothing of a passage is left and, unless a repeated chunk or a passage twice in the document holds it, nothing else goes
        assert not {x for k, x in enumerate(t.split("\n")) if k in want[d] and x.split()} & set(left), d
    seen = {x for t in got.values() for x in t.split("\n")}
    assert {x for _, t in docs for x in t.split("\n")} <= seen | {""}


@pytest.mark.parametrize("words", [50, 51])
def test_one_long_line(spark, words):
    long = " ".join(f"w{i}" for i in range(words))
    df = spark.createDataFrame([(1, "a\n" + long), (2, long + "\nb"), (3, long.upper()), (4, long.upper() + "\nc")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.clean(df).collect()}
    assert got[1] == "a\n" + long and got[3] == long.upper()
    assert (got[2], got[4]) == (("b", "c") if words > 50 else (long + "\nb", long.upper() + "\nc"))


def test_repeats_within_a_document_leave_one(spark):
    line = " ".join(f"w{i}" for i in range(20))
    text = "\n".join([line] * 10)
    df = spark.createDataFrame([(1, text), (1, "x\n" + text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text.count(line)) for r in line_dedup.clean(df).collect())
    assert sum(n for _, n in got) >= 3 and got[2] == (2, 0)
