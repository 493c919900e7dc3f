"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(``RATE`` * m) edits. Cut into k + 1
pieces, at least one piece of any such occurrence is intact. All pieces of the items form one
Aho-Corasick automaton, so a text is read once whatever the number of items; a piece hit
names the stretch in which its item would lie, and Myers' bit-parallel algorithm gives the
exact edit distance of the best match in that stretch (hits of one item that fall into
overlapping stretches are verified once). Nothing that has at most k edits is missed.

Texts and items are compared lower-cased with runs of white space as one space; offsets
refer to that form. An item too short for an edit is found only as whole words: a letter or
digit may not stand beside it.

The items are the stated query set: they are counted first, and each ``BLOCK_CHARS``
characters of them make one automaton, sent to the workers; more items mean more
passes over the documents, one after another, never a larger broadcast.

Defined results: null and empty texts and items match nothing; repeated documents or items
are matched each on its own (a row gives its own rows of matches), null ids are carried; empty
tables give an empty result; other columns are ignored, whatever their names; a very long text
is searched whole, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Share of an item's characters that may be inserted, deleted or replaced.
RATE = 0.05
#: Characters of items in one automaton.
BLOCK_CHARS = 1_000_000

MATCH = "doc_id long, item_id long, distance int, budget int, start int, end int, best boolean"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    return int(RATE * length + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any substring of text, and its first end.

    The columns of the dynamic programme are two bit vectors of vertical differences, here
    integers of m bits.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, at = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        at += 1 if hp & high else -1 if hm & high else 0
        if at < best:
            best, end = at, j
        hp, hm = hp << 1 & full, hm << 1 & full  # a match may begin anywhere, so nothing is carried in
        plus = hm | (full & ~(xv | hp))
        minus = hp & xv
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.items, where = [], {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text))
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, k))
        self.masks: dict[int, tuple[dict, dict]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, hits in where.items():
            self.automaton.add_word(piece, (len(piece), hits))
        self.automaton.make_automaton()

    def _masks(self, i: int) -> tuple[dict, dict]:
        if i not in self.masks:
            text = self.items[i][1]
            self.masks[i] = masks(text), masks(text[::-1])
        return self.masks[i]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match in each stretch where an item may lie."""
        if not self.items:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for last, (n, hits) in self.automaton.iter(text):
            for i, offset in hits:
                _, item, k = self.items[i]
                begin = last + 1 - n - offset
                a, b = max(0, begin - k), min(len(text), begin + len(item) + k)
                runs = stretches.setdefault(i, [])
                if runs and runs[-1][0] <= a <= runs[-1][0] + 2 * k + 1 and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                elif not runs or (a, b) != tuple(runs[-1]):
                    runs.append([a, b])
        out = []
        for i, runs in stretches.items():
            _, item, k = self.items[i]
            for a, b in sorted(map(tuple, runs)):
                found = self.verify(i, text, a, b)
                if found and not (out and out[-1][0] == i and found[1] < out[-1][3]):
                    out.append((i, *found))
        return out

    def verify(self, i: int, text: str, a: int, b: int) -> tuple[int, int, int] | None:
        _, item, k = self.items[i]
        exact = text.find(item, a, b)
        while not k and exact >= 0 and (text[exact - 1 : exact].isalnum() or text[exact + len(item) : exact + len(item) + 1].isalnum()):
            exact = text.find(item, exact + 1, b)
        if exact >= 0:
            return 0, exact, exact + len(item)
        if not k:
            return None
        there, back = self._masks(i)
        distance, end = myers(there, len(item), text[a:b])
        if distance > k:
            return None
        end += a
        begin = max(a, end - len(item) - k)
        _, length = myers(back, len(item), text[begin:end][::-1])  # the same match from its end
        return distance, end - length, end


def _blocks(items: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """Items in blocks of at most BLOCK_CHARS characters (or one item), each as a broadcast, and whether it is the only one.

    One of several is destroyed when the next is asked for, so its pass has to be stored by then.
    """
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        held = spark.sparkContext.broadcast([(r.id, normal(r.text)) for r in part.toLocalIterator()])
        yield held, n == 1
        if n > 1:
            held.destroy()


def find_matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end, best) of every stretch that matches within the budget.

    ``best`` marks the first of the least distance for each row and item.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def matching(held: Broadcast):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(held.value)
                found = []
                for doc, t in zip(batch["id"], batch["text"], strict=True):
                    matches = matcher.matches(normal(t))
                    best = {}
                    for m in matches:
                        best[m[0]] = min(best.get(m[0], m), m, key=lambda x: x[1:3])
                    for m in matches:
                        item_id, _, k = matcher.items[m[0]]
                        found.append((None if pd.isna(doc) else int(doc), item_id, m[1], k, *m[2:], best[m[0]] is m))
                out = pd.DataFrame(found, columns=[c.split()[0] for c in MATCH.split(", ")])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        return run

    found = []
    for held, alone in _blocks(items):
        part = rows.mapInPandas(matching(held), MATCH)
        found.append(part if alone else stored(part, "matches"))
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns. Rows of null id are matched by their own text."""

    def free(held: Broadcast):
        def run(batches):
            matcher = None
            for batch in batches:  # Arrow batches, so that no other column is converted
                matcher = matcher or Matcher(held.value)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not matcher.matches(normal(t)) for t in texts], pa.bool_()))

        return run

    now, schema = docs, docs.schema
    for held, alone in _blocks(items):
        now = now.mapInArrow(free(held), schema)
        now = now if alone else stored(now, "decontaminated")
    return now


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The best match of each row and item that match."""
    return find_matches(docs, items).where("best").drop("best")
