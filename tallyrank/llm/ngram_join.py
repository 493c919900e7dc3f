"""Exact Jaccard self-join on word n-grams, with skipping by set relations.

1. Shingles are ordered by a sketch of their counts over all documents (``BUCKETS`` counters,
   whatever the input), rare ones first. Any order gives the same links; this one keeps passages
   that many documents share out of the index.
2. Two sets of the similarity share a shingle among the first ``n - ceil(t n) + 1`` of each. These
   prefixes form the index: per shingle a list of sets with sizes and positions. Of lists of the same
   sets the first in the order stays. A pair need only be found in the list of its first common
   shingle, after which no more than what follows in either set can be shared; so an entry
   bounds the sizes of its partners, and entries without any in their list go, with lists of one.
3. Lists are compared by *blocks*: sorted by size and position, and a block is skipped where
   the sizes, or the positions of the shared shingle, leave no room for the overlap. In blocks that
   stay, counts of shingles by hash class bound the overlap. All these bounds lose no link; what
   passes is a tentative link, found by search over sets not yet reached, so a list of copies
   gives a row per set; lists of up to ``FEW`` sets are compared many at a time. Lists over ``minhash.REGION`` sets are dealt out in blocks with pivots, and
   what those leave uncompared is compared then.
4. Components of tentative links are clusters, to which each set goes once, whole. There an
   inverted index gives a set's *answers*, its overlaps with all others. The answers of a set that is
   similar to one already answered are derived from that one's: only the lists of shingles
   in which the two differ are read.
5. Components of links name the documents. All but 1., 2. and the index in 4. is shared with ``minhash``.

Defined results: those of ``minhash.near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import stored, whole_runs
from .shingles import chunks, fingerprints, shingle_sets

#: Counters of the sketch that orders shingles, a power of two.
BUCKETS = 1 << 18
#: Entries of a list that are skipped together.
BLOCK = 32
#: Lists of up to so many sets are compared together.
FEW = 8
#: Sets whose answers others may be derived from.
ANSWERS = 16
#: Sets over so many shingles have 256 counts by hash class instead of 64.
MANY = 1024


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _counted(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                total += np.bincount(_bucket(np.concatenate(shingle_sets(texts[a:b], k))), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "c": total[some]})

    return run


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by hash bucket over all documents: ``BUCKETS`` numbers, for the driver and each task."""
    counts = docs.select("text").mapInPandas(_counted(k), "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"].to_numpy(np.int64)] = counts["c"].to_numpy(np.int64)
    return out


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, as many as a set of the similarity must share one of."""
    n = len(s) - (percent * len(s) + 99) // 100 + 1
    return s[np.lexsort((s, counts[_bucket(s)]))[:n]]


def classes(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash class, modulo 256."""
    bits = 6 if len(s) <= MANY else 8
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def _indexed(k: int, percent: int, counts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = counts.value
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"]
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                f1, f2 = fingerprints(sets)
                first = [prefix(s, order, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                yield pd.DataFrame({"id": ids.iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "f1": f1, "f2": f2, "prefix": first, "classes": [classes(s) for s in sets]}).astype({"id": "Int64"})

    return run


def required(a, b, percent: int):
    """Least overlap of sets of these sizes at the similarity."""
    return -(-(percent * (a + b)) // (100 + percent))


class Classes:
    """A lower bound of the difference of two sets, from their counts by hash class."""

    def __init__(self, sizes: np.ndarray, blobs: list[bytes]):
        self.sizes = sizes
        self.large = np.cumsum(sizes > MANY) - 1
        fine = np.frombuffer(b"".join(x for x in blobs if len(x) == 256), np.uint8).reshape(-1, 256)
        self.fine, self.coarse = fine.view(np.int8), np.zeros((len(blobs), 64), np.uint8)
        for i, x in enumerate(blobs):
            own = np.frombuffer(x, np.uint8)
            self.coarse[i] = own if len(own) == 64 else own.reshape(64, 4).sum(axis=1, dtype=np.uint8)
        self.coarse = self.coarse.view(np.int8)

    @staticmethod
    def apart(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.abs((others - one).astype(np.int16)).sum(axis=1)

    def pairs(self, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs of sets a, b may have an overlap of ``need``."""
        room = self.sizes[a] + self.sizes[b] - 2 * need
        out = self.apart(self.coarse[a], self.coarse[b]) <= room
        big = np.flatnonzero(out & (self.sizes[a] > MANY) & (self.sizes[b] > MANY))
        for i in range(0, len(big), 4096):
            k = big[i : i + 4096]
            out[k] = self.apart(self.fine[self.large[a[k]]], self.fine[self.large[b[k]]]) <= room[k]
        return out

    def near(self, i: int, rest: np.ndarray, percent: int) -> np.ndarray:
        """Which of the sets ``rest`` may have the similarity with set i."""
        sizes, out = self.sizes, np.zeros(len(rest), bool)
        need = required(sizes[rest], sizes[i], percent)
        at = np.flatnonzero(need <= np.minimum(sizes[rest], sizes[i]))
        room = (sizes[rest] + sizes[i] - 2 * need)[at]
        at = at[self.apart(self.coarse[i], self.coarse[rest[at]]) <= room]
        if sizes[i] > MANY and len(at):
            big = sizes[rest[at]] > MANY
            wide = at[big]
            apart = self.apart(self.fine[self.large[i]], self.fine[self.large[rest[wide]]])
            at = np.concatenate([at[~big], wide[apart <= sizes[rest[wide]] + sizes[i] - 2 * need[wide]]])
        out[at] = True
        return out


class Lists:
    """An index list, sorted by size and position, of which blocks are skipped."""

    def __init__(self, g: pd.DataFrame, percent: int):
        g = g.sort_values(["n", "pos"], kind="stable")
        self.nodes, self.n, self.pos, self.percent = g["node"].to_numpy(), g["n"].to_numpy(), g["pos"].to_numpy(), percent
        self.by_class = Classes(self.n, g["classes"].tolist())
        starts = np.arange(0, len(g), BLOCK)
        self.least_n, self.most_n = self.n[starts], np.maximum.reduceat(self.n, starts)
        self.least_pos, self.most_pos = np.minimum.reduceat(self.pos, starts), np.maximum.reduceat(self.pos, starts)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Which of the entries ``rest`` may have the similarity with entry i."""
        n, pos = self.n[i], self.pos[i]
        # sets share at most their first common shingle and what follows in both
        room = np.minimum(n - pos, self.most_n - self.least_pos)
        open_ = (room >= required(self.least_n, n, self.percent)) & (required(self.most_n, n, self.percent) <= self.most_n) & (required(self.least_n, n, self.percent) <= n)
        out = np.zeros(len(rest), bool)
        at = np.flatnonzero(open_[rest // BLOCK])
        if len(at):
            them = rest[at]
            at = at[np.minimum(n - pos, self.n[them] - self.pos[them]) >= required(self.n[them], n, self.percent)]
            out[at] = self.by_class.near(i, rest[at], self.percent)
        return out


def few_linked(g: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a, b) that may have the similarity, of lists of up to ``FEW`` entries, all lists of a size at once."""
    n, pos = g["n"].to_numpy(), g["pos"].to_numpy()
    found = [np.zeros((2, 0), np.int64)]
    for size in range(2, FEW + 1):
        at = starts[sizes == size]
        for i in range(size):
            found += [np.stack([at + i, at + j]) for j in range(i + 1, size)]
    a, b = np.concatenate(found, axis=1)
    need = required(n[a], n[b], percent)
    open_ = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need
    a, b, need = a[open_], b[open_], need[open_]
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    by_class = Classes(n[used], g["classes"].iloc[used].tolist())
    x, y = place[: len(a)], place[len(a) :]
    keep = np.concatenate([by_class.pairs(x[i : i + 65536], y[i : i + 65536], need[i : i + 65536]) for i in range(0, max(len(a), 1), 65536)])
    return a[keep], b[keep]


def _listed(percent: int):
    """Spanning tentative links of this partition's lists, as (node, smallest node linked here)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union = minhash.Union()
        for g, starts, sizes in whole_runs(batches, ["region", "block"]):
            nodes = g["node"].to_numpy()
            for x, y in zip(*few_linked(g, starts, sizes, percent), strict=True):
                union.link(int(nodes[x]), int(nodes[y]))
            for start, size in zip(starts[sizes > FEW], sizes[sizes > FEW], strict=True):
                entries = Lists(g.iloc[start : start + size], percent)
                root = minhash.spanning(size, entries.near)
                for i in np.flatnonzero(root != np.arange(size)):
                    union.link(int(entries.nodes[i]), int(entries.nodes[root[i]]))
        yield pd.DataFrame([(x, union.find(x)) for x in list(union.up)], columns=["a", "b"]).astype("int64")

    return run


def _between(percent: int):
    """Tentative links (a, b) between components: each set of ``side`` 0 against all of ``side`` 1 of its part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        union = minhash.Union()
        for g in minhash.groups(batches, ["group", "i", "j"]):
            n, left = g["n"].to_numpy(), (g["n"] - g["pos"]).to_numpy()
            by_class = Classes(n, g["classes"].tolist())
            label, side = g["component"].to_numpy(), g["side"].to_numpy()
            other = np.flatnonzero(side == 1)
            for x in np.flatnonzero(side == 0).tolist():
                rest = other[label[other] != label[x]]
                rest = rest[np.minimum(left[x], left[rest]) >= required(n[x], n[rest], percent)]
                for y in np.unique(label[rest[by_class.near(x, rest, percent)]]).tolist():
                    union.link(int(label[x]), y)
        yield pd.DataFrame([(x, union.find(x)) for x in list(union.up)], columns=["a", "b"]).astype("int64")

    return run


class Answers(minhash._Sets):
    """Full sets of a group with an inverted index; a set's overlaps with all others are derived from a similar set's."""

    def fill(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(int(self.flat.max()) + 1, bool)
        self.list_at = np.concatenate([[0], np.cumsum(np.bincount(self.flat))])
        self.entries = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[np.argsort(self.flat, kind="stable")]
        self.known: list[tuple[int, np.ndarray]] = []
        self.read = 0

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the shingles each set has."""
        out, step = np.zeros(len(self.sizes), np.int64), max(1, (1 << 22) // len(self.sizes))
        for a in range(0, len(tokens), step):
            part = tokens[a : a + step]
            lengths = self.list_at[part + 1] - self.list_at[part]
            ends = np.cumsum(lengths)
            where = np.repeat(self.list_at[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            out += np.bincount(self.entries[where], minlength=len(self.sizes))
            self.read += int(ends[-1])
        return out

    def without(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.mark[b] = True
        left = a[~self.mark[a]]
        self.mark[b] = False
        return left

    def answers(self, i: int) -> np.ndarray:
        mine = self.flat[self.at[i] : self.at[i + 1]]
        base, theirs = max(self.known, key=lambda x: x[1][i] * 2 - self.sizes[x[0]], default=(None, None))
        if base is not None and self.sizes[base] - 2 * theirs[i] < 0:  # the two differ in less than the set's own size
            other = self.flat[self.at[base] : self.at[base + 1]]
            found = theirs + self.count(self.without(mine, other)) - self.count(self.without(other, mine))
        else:
            found = self.count(mine)
        self.known = [*self.known[1 - ANSWERS :], (i, found)]
        return found

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        if not len(rest):
            return np.zeros(0, bool)
        both = self.answers(i)[rest]
        return 100 * both >= self.percent * (self.sizes[i] + self.sizes[rest] - both)


def similar(df: DataFrame, k: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_shingles, component_id, kept (and copies: rows with an equal set)."""
    docs = minhash.documents_of(df, text, key)
    counts = df.sparkSession.sparkContext.broadcast(sketch(docs, k))
    signed = stored(docs.mapInPandas(_indexed(k, percent, counts), "id long, n long, f1 long, f2 long, prefix array<long>, classes binary"), "indexed")
    nodes = minhash.nodes_of(signed, "prefix", "classes")
    index = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "region"))
    # the least and the greatest size of a set that shares enough with an entry if their first common shingle is here
    least, most = -F.floor(-F.col("n") * percent / 100), F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    index = index.withColumn("least", least).withColumn("most", most)
    same = [F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")]
    lists = index.groupBy("region").agg(F.count("*").alias("size"), *same, F.sum("pos").alias("place"), F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.max("most").alias("reach"))
    lists = lists.where("size > 1 and n_least <= reach")
    # of lists of the same sets the first common shingle's has the least positions
    lists = lists.groupBy("size", "h1", "h2").agg(F.min_by(F.struct("region", "n_least", "n_most", "reach"), "place").alias("z")).select("z.*", "size")
    lists = stored(lists, "index-lists")
    members = index.join(lists.hint("shuffle_hash"), "region").where("most >= n_least and least <= n_most and n <= reach")
    members = stored(members.select("node", "pos", "region", "size"), "index")
    large = members.where(F.col("size") > minhash.REGION)
    large = None if large.isEmpty() else large.select("node", "region", "pos", F.lit(0).cast("long").alias("n"))
    clusters = minhash.linked_in_regions(members, large, nodes.select("node", "n", "classes"), _listed(percent), _between(percent), "pos")
    return minhash.labelled(signed, nodes, minhash.confirmed_components(docs, nodes, clusters, k, percent, Answers), key)


def report(df: DataFrame) -> DataFrame:
    return similar(df).select("doc_id", "n_shingles", "component_id")
