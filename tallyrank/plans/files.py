"""Queries that write archives of the given tables and read them back: the formats that feature data comes in."""

from __future__ import annotations

import io
import tarfile
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.order import numbered
from ..functions.scratch import scratch, stored
from ..sources import readers
from .tables import r, rounded, table

QUERIES: dict = {}
#: Rows of a file.
ROWS = 2000


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = (lambda spark, d: rounded(f(spark, d)), sql)
        return f

    return keep


def _file(name: str, build):
    """A row of a file: its name and ``build`` (rows in order of pos)."""
    return lambda pdf: pd.DataFrame({"name": [name.format(pdf["file"].iloc[0], len(pdf))], "content": [build(pdf.sort_values("pos"))]})


def _written(rows, name: str, build) -> str:
    """Path of archives of ``rows`` (file, pos, ...), a file a group of at most ``ROWS``."""
    path = scratch(rows.sparkSession, "archives")
    readers.write_files(rows.groupBy("file").applyInPandas(_file(name, build), "name string, content binary"), path)
    return path


def parts(spark, d):
    """(file, pos, x, y, label): parts by brand in files of ``ROWS``."""
    p = numbered(table(spark, d, "part").select(F.col("p_brand").alias("g"), "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").cast("double").alias("y"), (F.col("p_size") > 40).cast("int").alias("label")), ["g"], ["p_partkey"])
    file = F.concat_ws("-", F.translate("g", "#", "_"), F.floor(F.col("pos") / ROWS).cast("string"))
    return p.select(file.alias("file"), (F.col("pos") % ROWS).alias("pos"), "x", "y", "label")


PARTS = f"""p AS (SELECT replace(p_brand, '#', '_') AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y, (p_size > 40)::INT AS label FROM part),
f AS (SELECT g || '-' || (k // {ROWS}) AS file, k % {ROWS} AS pos, x, y, label FROM p)"""
TABLE = f"WITH {PARTS} SELECT file AS dataset, pos AS row_id, {r('x')}, {r('y')}, label FROM f"


def _wide(df):
    return df.select("dataset", "row_id", F.get("features", F.lit(0)).alias("x"), F.get("features", F.lit(1)).alias("y"), "label")


def _npz(pdf) -> bytes:
    out = io.BytesIO()
    np.savez(out, X=pdf[["x", "y"]].to_numpy(), y=pdf["label"].to_numpy())
    return out.getvalue()


def _split_npz(pdf) -> bytes:
    out, x, y, cut = io.BytesIO(), pdf[["x", "y"]].to_numpy(), pdf["label"].to_numpy(), len(pdf) // 2
    np.savez_compressed(out, train=x[:cut], train_labels=y[:cut], test=x[cut:], test_labels=y[cut:])
    return out.getvalue()


query("read_npz", TABLE)(lambda spark, d: _wide(readers.read_npz(spark, _written(parts(spark, d), "{0}.npz", _npz))))
query("read_npz_split", TABLE)(lambda spark, d: _wide(readers.read_npz(spark, _written(parts(spark, d), "{0}.npz", _split_npz))))


def _arff(pdf) -> str:
    head = "@relation r\n@attribute x real\n@attribute id integer\n@attribute y numeric\n@attribute outlier {'yes','no'}\n@data\n"
    return head + "".join(f"{x!r},{i},{y!r},'{'yes' if label else 'no'}'\n" for i, x, y, label in zip(pdf["pos"], pdf["x"].tolist(), pdf["y"].tolist(), pdf["label"], strict=True))


def _tar(pdf) -> bytes:
    """Two variants of a set, of which the one without duplicates is to be read."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, rows in (("set_norm_05.arff", pdf.head(1)), ("set_withoutdupl_norm_05.arff", pdf)):
            data = _arff(rows).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


query("read_arff", TABLE)(lambda spark, d: _wide(readers.read_arff(spark, _written(parts(spark, d), "{0}.tar.gz", _tar))))


def events(spark, d):
    """(file, pos, value, other, label): events by type in files of ``ROWS``; the rows from 100 to 120 of a file are labelled."""
    e = numbered(table(spark, d, "events").select(F.col("event_type").alias("g"), "ts", "event_id", F.col("value").cast("double").alias("value"), F.col("user_id").cast("double").alias("other")), ["g"], ["ts", "event_id"])
    pos = (F.col("pos") % ROWS).alias("pos")
    e = e.select(F.concat_ws("-", "g", F.floor(F.col("pos") / ROWS).cast("string")).alias("file"), pos, "value", "other")
    return stored(e.withColumn("label", F.col("pos").between(100, 120).cast("int")), "event-files")


EVENTS = f"""e AS (SELECT event_type AS g, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, value, user_id::DOUBLE AS other FROM events),
f AS (SELECT g || '-' || (k // {ROWS}) AS file, k % {ROWS} AS pos, value, other, (k % {ROWS} BETWEEN 100 AND 120)::INT AS label FROM e)"""


def _zip(member: str, text) -> object:
    def build(pdf) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(member.format(pdf["file"].iloc[0]), text(pdf))
            z.writestr("__MACOSX/" + member.format("x"), "nothing")
        return out.getvalue()

    return build


_csv = lambda names: lambda pdf: pdf.rename(columns={"label": names[-1]})[["value", *names]].to_csv(index=False)
query("read_series_csv", f"WITH {EVENTS} SELECT file AS series, pos, {r('value')}, label FROM f")(lambda spark, d: readers.read_series_csv(spark, _written(events(spark, d), "{0}.zip", _zip("u/{0}.csv", _csv(["Label"])))))
query("read_span_txt", f"WITH {EVENTS} SELECT '001_' || file || '_50_100_120' AS series, pos, {r('value')}, label FROM f")(
    lambda spark, d: readers.read_span_txt(spark, _written(events(spark, d), "{0}.zip", _zip("u/001_{0}_50_100_120.txt", lambda pdf: "\n".join(map(repr, pdf["value"].tolist())))))
)
query("read_channels_csv", f"WITH {EVENTS} SELECT file AS series, 0 AS channel, pos, {r('value')}, label FROM f UNION ALL SELECT file, 1, pos, {r('other', 'value')}, label FROM f")(
    lambda spark, d: readers.read_channels_csv(spark, _written(events(spark, d), "{0}.zip", _zip("{0}.csv", _csv(["other", "is_anomaly"]))))
)


@query("score_sink", f"WITH {PARTS} SELECT file AS dataset, CASE WHEN pos % 2 = 0 THEN 'val' ELSE 'test' END AS part, 'x' AS detector, pos AS id, {r('x', 'score')} FROM f UNION ALL SELECT file, CASE WHEN pos % 2 = 0 THEN 'val' ELSE 'test' END, 'y', pos, {r('y', 'score')} FROM f")
def _(spark, d):
    path = scratch(spark, "score-sink")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("detector"), F.col(c).alias("score")) for c in "xy"))).alias("z")
    rows = parts(spark, d).select(F.col("file").alias("dataset"), F.when(F.col("pos") % 2 == 0, "val").otherwise("test").alias("part"), F.col("pos").alias("id"), each)
    readers.write_scores(rows.select("dataset", "part", "z.detector", "id", "z.score"), path)
    return readers.read_parts(spark, path).select("dataset", "part", "detector", "id", "score")
