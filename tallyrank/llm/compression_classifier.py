"""Quality scores from compression: which of two dictionaries makes a text smaller?

Two zstandard dictionaries are built from labelled text, one from good and one from bad
documents. A text is compressed in blocks of ``BLOCK_BYTES`` with each (blocks, as the
coder would soon learn a long text by itself and forget the dictionary); the difference of the
sizes over the length, shrunk for short texts, is mapped to a probability by logistic
calibration on labelled documents that no dictionary has seen. How far the length outweighs
the shrinkage is the calibration's second input, so that a short text, which says little
either way, falls back on the share of good labels. The third is how far the text shrinks
beyond ``DENSE`` of its length, as prose never does and repetition does. Classes weigh as in
all labels.

The fit uses at most ``SAMPLE_ROWS`` labelled documents a class and ``SAMPLE_BYTES`` of their
text, half for the dictionaries and half for calibration. They are chosen in the order of
a hash of their text, so a run can be repeated; ids serve to hold out documents only.

Defined results: a null text is empty, and an empty text's score is that of a difference of
0; labels that are null, not 0 or 1, or contradictory for a doc_id are left out; without
both classes every score is 0.5; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored, whatever their names; a very long text is scored whole,
block by block, and joins the fit only where it leaves room for others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 1024
DICT_BYTES = 65536
LEVEL = 3
SAMPLE_ROWS = 1500
SAMPLE_BYTES = 24 << 20
#: Longer labelled texts join the sample only where room is left, so that one of them can't use it up.
SAMPLE_TEXT = 1 << 20
#: Bytes added to a text's length, so that a few bytes of difference say little about a short text.
SHRINK = 100
DENSE = 0.3
THRESHOLD = 0.3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def coders(self):
        def coder(data):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)

        return coder(self.good), coder(self.bad)

    def scores(self, texts) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), 0.5)
        good, bad = self.coders()
        x = np.array([evidence(t, good, bad) for t in texts], float).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def evidence(text: str | None, good, bad) -> tuple[float, float, float, float]:
    """Inputs of the calibration: normalised size difference, weight of the length, excess density, 1."""
    data = (text or "").encode("utf-8", "surrogatepass")
    parts, n = blocks(data), len(data) + SHRINK
    as_good, as_bad = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
    return (as_bad - as_good) / n, len(data) / n, max(0.0, DENSE * len(data) - as_good) / n, 1.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; inputs are scaled to unit deviation."""
    sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a, w = x / sd, np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (y - p)) - ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w / sd


def fit(texts: list[str], labels: list[int], good_share: float | None = None) -> Model:
    """A model from labelled texts: of each class every other text makes the dictionary.

    ``good_share``: share of good documents in the population (as in the sample, if not given).
    """
    side = {0: [], 1: []}
    for t, y in zip(texts, labels, strict=True):
        side[y].append(t or "")
    if not side[0] or not side[1]:
        return Model(b"", b"", np.zeros(4))

    def dictionary(part):
        pieces = [p for t in part for p in blocks(t.encode("utf-8", "surrogatepass"))]
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, max(512, sum(map(len, pieces)) // 4)), pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to learn from: the text itself serves
            return (b"".join(pieces) or b" " * 8).ljust(8)[-DICT_BYTES:]

    model = Model(dictionary(side[1][::2]), dictionary(side[0][::2]), np.zeros(4))
    good, bad = model.coders()
    rest = [(t, y) for y in side for t in (side[y][1::2] or side[y])]
    x, y = np.array([evidence(t, good, bad) for t, _ in rest]), np.array([y for _, y in rest], float)
    share = len(side[1]) / (len(side[0]) + len(side[1])) if good_share is None else good_share
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.weights = logistic(x, y, weight)
    return model


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """(__id, q) of the labels that may be learnt from, one row a document."""
    clean = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("q")).where(F.col("__id").isNotNull() & F.col("q").isin(0, 1))
    return clean.where(~held_out("__id")).groupBy("__id").agg(F.min("q").alias("q"), F.max("q").alias("q1")).where("q = q1").drop("q1")


def training_sample(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """At most SAMPLE_ROWS documents a class and SAMPLE_BYTES of text that may be learnt from.

    Labels are thinned by a hash first, so the documents' texts meet a small broadcast table
    of bounded size and are never shuffled.
    """
    clean = usable_labels(labels)
    ranked = None
    for q in (0, 1):
        part = clean.where(F.col("q") == q).select("__id", "q").orderBy(F.xxhash64("__id", F.lit(17)), "__id").limit(SAMPLE_ROWS)
        ranked = part if ranked is None else ranked.union(part)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(ranked), F.col("doc_id") == F.col("__id"))
    texts = texts.select("q", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kept = Window.partitionBy("q").orderBy(F.octet_length("text") > SAMPLE_TEXT, "h", "text").rowsBetween(Window.unboundedPreceding, 0)  # SAMPLE_ROWS rows, copies aside
    texts = texts.withColumn("size", F.sum(F.octet_length("text")).over(kept)).where(F.col("size") <= SAMPLE_BYTES // 2)
    return texts.select("q", "h", "text").toPandas().sort_values(["q", "h", "text"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_sample(docs, labels)
    return fit(sample["text"].tolist(), sample["q"].tolist(), usable_labels(labels).agg(F.avg("q")).first()[0])


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score) of each row."""
    held = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch["id"].astype("Int64"), "score": held.value.scores(batch["text"].tolist())})

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(run, f"`{key}` long, score double")


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
