"""Near-duplicate documents: an LSH forest proposes, full shingle sets confirm.

1. Each text becomes its shingle set's size, fingerprint and MinHash signature (128 values of
   16 bits). Texts with equal sets are one node, named by their smallest doc_id.
2. The forest is ``TREES`` orders of the nodes, each sorted by eight signature values of its
   own. Nodes with a common prefix of ``MIN_DEPTH`` values are neighbours. A region that holds
   more than ``REGION`` nodes is cut deeper, by the next value, as far as needed (adaptive
   depth); what stays too large at full depth is dealt out in blocks, each with the same few
   ``PIVOTS`` of the region beside it. The cut only saves work (see 5).
3. Within a region nodes are linked tentatively where their signatures agree in 60 % or more.
   A search that compares each node reached only with nodes not yet reached gives a spanning
   forest: one row per node, never all pairs.
4. Components of these tentative links are clusters. Each node's text goes to its cluster
   once, and there full sets decide every link (again by search over nodes not yet reached),
   so a link between two documents of a cluster can't be missed; sets are passed over only
   where their sizes, or the counts of their shingles by hash class, leave no room for the
   similarity. Clusters over ``REGION`` documents are dealt out in blocks with pivots too.
5. Blocks and deeper cuts leave pairs uncompared. So the nodes of a group that was cut which
   are not in its largest component are compared with all of the group, in blocks; pairs
   within that component need no link. The components are then those of all pairs. In a group
   of near copies almost all nodes are in one component, so this is little work; in a group of
   n texts without one it is n * n / REGION rows.
6. Components of confirmed links give component_id, and copies take that of their node.

Defined results: a null text is empty; empty texts are linked with nothing; rows sharing a
doc_id and text are one document; of rows sharing a doc_id with other text each has the links
of its text, pooled where that doc_id is the smallest of both texts' copies; a null doc_id has
no links, a null component and is kept; an empty table gives an empty result; other columns are
ignored, whatever their names; a very long text has one set of all its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import unused
from .common import stored
from .components import connected
from .shingles import SIGNATURE, chunks, fingerprints, shingle_sets, signatures

TREES, DEPTH, MIN_DEPTH = 16, 8, 4
#: Nodes of a group that one task compares with each other, and nodes of a larger group that all its blocks share.
REGION, PIVOTS = 128, 16
#: Least share of equal signature values for a tentative link at a similarity of 0.8: five to six deviations below it.
AGREE = 0.6
#: Identifiers that are sent to all executors to leave other texts out before they are shuffled; with more, all texts are.
SENT = 1 << 20
#: Shingles of a cluster that one task compares with as many others.
BLOCK_SHINGLES = 1_000_000


def _signed(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"]
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], k)
                f1, f2 = fingerprints(sets)
                yield pd.DataFrame(
                    {"id": ids.iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "f1": f1, "f2": f2, "sig": [s.tobytes() for s in signatures(sets)]}
                ).astype({"id": "Int64"})
            pa.default_memory_pool().release_unused()  # else a worker holds on to its peak

    return run


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] if p in up else p
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys of sorted input, whole even across batches."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if batch.empty:
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            key = tuple(values[a])
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[a:b])
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def spanning(n: int, near) -> np.ndarray:
    """Root of each of n items; ``near(i, rest)`` says which of the items ``rest`` are linked with i."""
    root, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        root[first], queue = first, [first]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            queue.extend(rest[hit].tolist())
            root[rest[hit]] = first
            rest = rest[~hit]
    return root


def _tentative(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning tentative links of this partition's regions, as (node, smallest node linked here)."""
    union, least = Union(), int(np.ceil(AGREE * SIGNATURE))
    for g in groups(batches, ["region", "block"]):
        nodes = g["node"].to_numpy()
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(nodes), SIGNATURE)
        root = spanning(len(nodes), lambda i, rest: (sig[rest] == sig[i]).sum(axis=1) >= least)  # noqa: B023
        for i in np.flatnonzero(root != np.arange(len(nodes))):
            union.link(int(nodes[i]), int(nodes[root[i]]))
    found = [(x, union.find(x)) for x in list(union.up)]
    yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")


class _Sets:
    """Full shingle sets of a group of documents, compared by size, then hash classes, then shingles."""

    def __init__(self, g: pd.DataFrame, k: int, percent: int):
        texts = g["text"].tolist()
        sets = [s for a, b in chunks(texts) for s in shingle_sets(texts[a:b], k)]
        f1, f2 = fingerprints(sets)
        own = np.flatnonzero((f1 == g["f1"].to_numpy()) & (f2 == g["f2"].to_numpy()))  # other rows of this doc_id are other nodes
        seen = pd.DataFrame({"node": g["node"].to_numpy()[own], "f1": f1[own], "f2": f2[own], "side": g["side"].to_numpy()[own] if "side" in g else 0})
        self.pick = own[~seen.duplicated().to_numpy()]
        self.fill([sets[i] for i in self.pick], percent)

    def fill(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        row = np.repeat(np.arange(len(sets)), self.sizes)
        self.classes = np.bincount(row * 256 + (flat >> np.uint64(56)).astype(np.int64), minlength=256 * len(sets)).reshape(-1, 256)
        self.flat = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(int(self.flat.max()) + 1, np.int64)

    def near(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Which of the sets ``rest`` have at least the similarity with set i."""
        sizes, percent = self.sizes, self.percent
        enough = lambda both, other: 100 * both >= percent * (sizes[i] + other - both)
        out = np.zeros(len(rest), bool)
        maybe = np.flatnonzero(enough(np.minimum(sizes[rest], sizes[i]), sizes[rest]))
        maybe = maybe[enough(np.minimum(self.classes[rest[maybe]], self.classes[i]).sum(axis=1), sizes[rest[maybe]])]
        if len(maybe):
            mine = self.flat[self.at[i] : self.at[i + 1]]
            self.mark[mine] = 1
            lengths = sizes[rest[maybe]]
            ends = np.cumsum(lengths)
            where = np.repeat(self.at[rest[maybe]] - (ends - lengths), lengths) + np.arange(ends[-1])
            both = np.add.reduceat(self.mark[self.flat[where]], ends - lengths)
            self.mark[mine] = 0
            out[maybe] = enough(both, lengths)
        return out


def _confirmed(k: int, percent: int, kind: type[_Sets]):
    """Spanning links of each block of a cluster, as (node, smallest node linked here, blocks)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(batches, ["cluster", "block"]):
            sets = kind(g, k, percent)
            nodes, union = g["node"].to_numpy()[sets.pick], Union()
            for i, r in enumerate(spanning(len(nodes), sets.near).tolist()):
                union.link(int(nodes[i]), int(nodes[r]))
            names = np.unique(nodes)
            yield pd.DataFrame({"node": names, "to": [union.find(x) for x in names.tolist()], "blocks": int(g["blocks"].iloc[0])})

    return run


def _confirmed_between(k: int, percent: int, kind: type[_Sets]):
    """Links (a, b) between components of a cluster: each node of ``side`` 0 against all of ``side`` 1 of its part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = set()
        for g in groups(batches, ["group", "i", "j"]):
            sets = kind(g, k, percent)
            label, side = g["component"].to_numpy()[sets.pick], g["side"].to_numpy()[sets.pick]
            other = np.flatnonzero(side == 1)
            for x in np.flatnonzero(side == 0).tolist():
                rest = other[label[other] != label[x]]
                found.update((int(label[x]), y) for y in np.unique(label[rest[sets.near(x, rest)]]).tolist())
        yield pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return run


def dealt(rows: DataFrame, blocks: str, size: str, node: str) -> DataFrame:
    """Rows with their ``block``; of more than one block each also holds the pivots."""
    mine = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    pivot = (F.col(blocks) > 1) & (F.pmod(F.xxhash64(node, F.lit(1)), F.col(size)) < PIVOTS)
    return rows.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)).otherwise(F.array(mine))))


def _regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(node, region, size): for each tree the region of each node that has neighbours there; (node, region) of regions that were cut."""
    trees = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    rest = trees.select("node", "tree", F.substring("sig", F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("path"))
    out = large = None
    for depth in range(MIN_DEPTH, DEPTH + 1):
        cut = rest.withColumn("region", F.xxhash64("tree", F.lit(depth), F.expr(f"substring(path, 1, {2 * depth})")))
        sizes = stored(cut.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"), "regions")
        cut = cut.join(sizes.hint("shuffle_hash"), "region")
        last = depth == DEPTH or sizes.where(F.col("size") > REGION).isEmpty()
        done = (cut if last else cut.where(F.col("size") <= REGION)).select("node", "region", "size")
        out = done if out is None else out.union(done)
        if last:
            return out, large
        rest = stored(cut.where(F.col("size") > REGION).select("node", "tree", "path", "region"), "deeper")
        large = rest.select("node", "region") if large is None else large
        rest = rest.drop("region")
    return out, large


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tentative links (a, b) between components: each node of ``side`` 0 against all of ``side`` 1 of its part."""
    least, found = int(np.ceil(AGREE * SIGNATURE)), set()
    for g in groups(batches, ["group", "i", "j"]):
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(len(g), SIGNATURE)
        label, side = g["component"].to_numpy(), g["side"].to_numpy()
        mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        theirs = sig[other]
        for i in mine:
            hit = np.unique(label[other[(theirs == sig[i]).sum(axis=1) >= least]])
            found.update((int(label[i]), int(x)) for x in hit if x != label[i])
    yield pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")


def left_to_compare(at: DataFrame, *more: str) -> DataFrame | None:
    """(group, node, component, side, i, j, more): the nodes of each group outside its largest component (side 0) beside all of it (side 1).

    ``at`` has (group, node, component, n) and the columns ``more``. In parts (i, j) of about ``REGION`` nodes or
    ``BLOCK_SHINGLES`` shingles (n) a side. None where no group has such nodes.
    """
    counts = at.groupBy("group", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = counts.groupBy("group").agg(F.max(F.struct("c", "component", "s")).alias("m"), F.sum("c").alias("size"), F.sum("s").alias("all"))
    blocks = lambda n, s: F.least(F.greatest(F.ceil(n / REGION), F.ceil(s / BLOCK_SHINGLES), F.lit(1)), F.greatest(n, F.lit(1))).cast("int")
    most = most.where(F.col("m.c") < F.col("size"))
    most = most.select("group", F.col("m.component").alias("main"), blocks(F.col("size") - F.col("m.c"), F.col("all") - F.col("m.s")).alias("ni"), blocks(F.col("size"), F.col("all")).alias("nj"))
    most = stored(most, "cut-groups")
    if most.isEmpty():
        return None
    at = at.join(most.hint("shuffle_hash"), "group")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = at.where("component != main").select("group", "node", "component", F.lit(0).alias("side"), number("ni").alias("i"), every("nj").alias("j"), *more)
    whole = at.select("group", "node", "component", F.lit(1).alias("side"), every("ni").alias("i"), number("nj").alias("j"), *more)
    return rest.union(whole)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with components linked by ``links`` (a, b) joined."""
    merged = connected(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    # a component's smallest node may be in no link yet
    known = labels.union(merged.select("component", "component")).distinct()
    return stored(known.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "rejoined")


def parted(dealt: DataFrame, rows: DataFrame, run) -> DataFrame:
    """The links that ``run`` finds in the parts of ``dealt``, with each node's ``rows``."""
    parts = dealt.join(rows, "node").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return stored(parts.mapInPandas(run, "a long, b long"), "links-between")


def linked_in_regions(members: DataFrame, large: DataFrame | None, payload: DataFrame, within, between, *more: str) -> DataFrame:
    """(node, component) of tentative links: ``within`` finds those of the blocks of each region, ``between`` those that cuts left uncompared.

    ``members`` has (node, region, size), ``large`` (node, region, n) of the regions that are cut, both also the columns
    ``more``; ``payload`` is what the comparison needs per node.
    """
    blocks = F.ceil(F.col("size") / REGION)
    regions = dealt(stored(members, "members").withColumn("blocks", blocks), "blocks", "size", "node").drop("size", "blocks")
    beside = regions.join(payload, "node").repartition("region", "block").sortWithinPartitions("region", "block")
    clusters = connected(beside.mapInPandas(within, "a long, b long"))
    if large is not None:
        at = large.join(clusters, "node", "left").select(F.col("region").alias("group"), "node", F.coalesce("component", "node").alias("component"), "n", *more)
        parts = left_to_compare(stored(at, "cut-regions"), *more)
        if parts is not None:
            clusters = merged(clusters, parted(parts, payload, between))
    return clusters


def confirmed_components(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, k: int, percent: int, kind: type[_Sets]) -> DataFrame:
    """(node, component) by full sets of the nodes of each cluster; ``docs`` (id, text), ``nodes`` (node, n, f1, f2)."""
    members = clusters.join(nodes.select("node", "n", "f1", "f2"), "node").select("node", "f1", "f2", "n", F.col("component").alias("cluster"))
    members = stored(members, "clustered")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    # every block also holds the pivots, so a cluster of few documents stays in one, whatever their length
    blocks = F.greatest(F.least(F.greatest(F.ceil(F.col("c") / REGION), F.ceil(F.col("s") / BLOCK_SHINGLES)), F.floor(F.col("c") / max(2 * PIVOTS, 1))), F.lit(1)).cast("long")
    sizes = stored(sizes.select("cluster", "c", blocks.alias("blocks")), "cluster-sizes")
    members = members.join(sizes, "cluster")
    named = docs.withColumnRenamed("id", "node")
    if members.count() <= SENT:
        named = named.join(F.broadcast(members.select("node").distinct()), "node", "left_semi")
    grouped = named.join(dealt(members, "blocks", "c", "node").select("cluster", "blocks", "block", "node", "f1", "f2").hint("shuffle_hash"), "node")
    grouped = grouped.repartition("cluster", "block").sortWithinPartitions("cluster", "block")
    links = stored(grouped.mapInPandas(_confirmed(k, percent, kind), "node long, to long, blocks long"), "links")

    split = links.where("blocks > 1")
    labels = links.where("blocks = 1").select("node", F.col("to").alias("component"))
    if not split.isEmpty():
        joined = connected(split.select(F.col("node").alias("a"), F.col("to").alias("b")))
        at = members.where("blocks > 1").join(joined, "node", "left")
        at = stored(at.select(F.col("cluster").alias("group"), "node", F.coalesce("component", "node").alias("component"), "n").distinct(), "cut-clusters")
        parts = left_to_compare(at)
        if parts is not None:
            texts = named.join(members.where("blocks > 1").select("node", "f1", "f2").hint("shuffle_hash"), "node")
            joined = merged(at.select("node", "component").distinct(), parted(parts, texts, _confirmed_between(k, percent, kind)))
        labels = labels.union(joined)
    return labels.where("node != component")


def nodes_of(signed: DataFrame, *payload: str) -> DataFrame:
    """Stored (node, n, f1, f2, copies, payload): a row per distinct set, named by its smallest id."""
    alike = signed.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("f1", "f2")
    return stored(alike.agg(F.min("id").alias("node"), F.max("n").alias("n"), F.count("*").alias("copies"), *(F.any_value(c).alias(c) for c in payload)), "nodes")


def labelled(signed: DataFrame, nodes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Per row of ``signed``: ``key``, n_shingles, component_id, kept, copies."""
    known = nodes.join(labels, "node", "left").select("f1", "f2", "copies", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("moved"))
    known = stored(known.where("copies > 1 or moved").drop("moved"), "known")
    out = signed.select("id", "n", "f1", "f2").join(known.hint("shuffle_hash"), ["f1", "f2"], "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.when(linked, F.coalesce("copies", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def documents_of(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def near_duplicates(df: DataFrame, k: int = 4, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_shingles, component_id, kept (and copies: rows with an equal set)."""
    docs = documents_of(df, text, key)
    signed = stored(docs.mapInPandas(_signed(k), "id long, n long, f1 long, f2 long, sig binary"), "signed")
    nodes = nodes_of(signed, "sig")
    members, large = _regions(nodes)
    large = large.withColumn("n", F.lit(0).cast("long")) if large is not None else None
    clusters = linked_in_regions(members, large, nodes.select("node", "sig"), _tentative, _between)
    return labelled(signed, nodes, confirmed_components(docs, nodes, clusters, k, percent, _Sets), key)


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose document represents its group."""
    (name,) = unused(df, "gone")
    gone = near_duplicates(df, k, percent, text, key).where(~F.col("kept")).select(F.col(key).alias(name)).distinct()
    return df.join(gone.hint("shuffle_hash"), F.col(f"`{key}`") == F.col(name), "left_anti")
