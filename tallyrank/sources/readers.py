"""Readers for the file formats that feature data comes in; all give rows, none reads on the driver.

Files in formats Spark has no reader for are loaded whole by ``binaryFile`` (any file system)
and parsed in Arrow batches, one file at a time. The long schema is (dataset, row_id, features,
label); series are (series, pos, value, label).
"""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "dataset string, row_id long, features array<double>, label int"
SERIES = "series string, pos long, value double, label int"
CHANNELS = "series string, channel int, pos long, value double, label int"
#: Rows handed to Arrow at once.
ROWS = 20_000


def _stem(path: str) -> str:
    return re.sub(r"\.[A-Za-z0-9]+$", "", path.rsplit("/", 1)[-1])


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of the files of that pattern, and of those that ``write_files`` has named so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"/name=([^/]+)/[^/]+$", 1)
    files = files.withColumn("path", F.when(name != "", F.url_decode(name)).otherwise(F.col("path")))
    endings = glob.removeprefix("*.").strip("{}").split(",")
    return files.where(F.col("path").rlike("\\.(" + "|".join(e.replace(".", "\\.") for e in endings) + ")$")).select("path", "content")


def write_files(df: DataFrame, path: str) -> None:
    """Each row of ``df`` (name, content binary) as a file, in a folder that has its name.

    Spark's text writer stores the bytes as they are, and a zero byte after them, which
    zip, npz and gzip readers pass over.
    """
    df.select("name", F.col("content").cast("string").alias("value")).write.partitionBy("name").option("lineSep", "\0").option("compression", "none").text(path)


def _each(parse: Callable[[str, bytes], Iterator[pd.DataFrame]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield from parse(path, content)

    return run


def _matrix(name: str, x: np.ndarray, y: np.ndarray, first: int = 0) -> Iterator[pd.DataFrame]:
    x = np.asarray(x, float)
    x = np.where(np.isfinite(x), x, 0.0)  # non-finite features count as 0
    for a in range(0, len(x), ROWS):
        part = x[a : a + ROWS]
        yield pd.DataFrame({"dataset": name, "row_id": np.arange(first + a, first + a + len(part)), "features": part.tolist(), "label": np.asarray(y[a : a + ROWS]).astype("int32").ravel()})


def _npz(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        if "X" in z:
            yield from _matrix(_stem(path), z["X"], z["y"])
        else:  # split form: train, then test
            yield from _matrix(_stem(path), z["train"], z["train_labels"])
            yield from _matrix(_stem(path), z["test"], z["test_labels"], len(z["train"]))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``*.npz`` with X and y, or train, train_labels, test and test_labels."""
    return _files(spark, path, "*.npz").mapInPandas(_each(_npz), TABLE)


def sized(df: DataFrame, low: int = 200, high: int = 50_000) -> DataFrame:
    """Datasets of an acceptable number of rows."""
    n = df.groupBy("dataset").agg(F.count("*").alias("__n")).where(F.col("__n").between(low, high))
    return df.join(n.drop("__n"), "dataset", "left_semi")


def parse_arff(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numeric attributes but ``id``, and the nominal attribute ``outlier`` as 0/1."""
    names, rows, data = [], [], False
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if data:
            rows.append([v.strip().strip("'\"") for v in line.split(",")])
        elif line.lower().startswith("@attribute"):
            m = re.match(r"@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", line, re.IGNORECASE)
            names.append((m[1].strip("'\"").lower(), m[2].strip().lower()))
        elif line.lower().startswith("@data"):
            data = True
    keep = [i for i, (n, kind) in enumerate(names) if n not in ("id", "outlier") and kind.split()[0] in ("numeric", "real", "integer")]
    out = [n for n, _ in names].index("outlier")
    x = np.array([[float(r[i]) if r[i] != "?" else np.nan for i in keep] for r in rows]).reshape(len(rows), len(keep))
    return x, np.array([int(r[out].lower() == "yes") for r in rows])


def arff_order(name: str) -> tuple:
    """Which variant of a dataset to take: without duplicates, normalised, no replicate, lowest percentage."""
    pct = re.search(r"_([0-9]{2})(?:_|\.|$)", name)
    return "withoutdupl" in name.lower(), "norm" in name.lower(), not re.search(r"_v[0-9]{2}", name), -(int(pct[1]) if pct else 100)


def _arff(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    if path.endswith((".tar.gz", ".tgz", ".tar")):
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            members = [m for m in tar.getmembers() if m.name.endswith(".arff")]
            if members:
                best = max(members, key=lambda m: (arff_order(m.name), m.name))
                yield from _matrix(_stem(path).removesuffix(".tar"), *parse_arff(tar.extractfile(best).read().decode("utf-8", "replace")))
    else:
        text = gzip.decompress(content) if path.endswith(".gz") else content
        yield from _matrix(_stem(path), *parse_arff(text.decode("utf-8", "replace")))


def read_arff(spark: SparkSession, path: str, glob: str = "*.{arff,tar.gz,tgz}") -> DataFrame:
    return _files(spark, path, glob).mapInPandas(_each(_arff), TABLE)


def _members(path: str, content: bytes, ending: str) -> Iterator[tuple[str, bytes]]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if n.endswith(ending) and "__MACOSX" not in n):
                yield name, z.read(name)
    elif path.endswith(ending):
        yield path, content


def _series_csv(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    for name, raw in _members(path, content, ".csv"):
        t = pd.read_csv(io.BytesIO(raw))
        yield pd.DataFrame({"series": _stem(name), "pos": np.arange(len(t)), "value": t.iloc[:, 0].astype(float), "label": t["Label"].astype("int32")})


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files, plain or in zip archives: the first column is the value, ``Label`` the label."""
    return _files(spark, path, "*.{csv,zip}").mapInPandas(_each(_series_csv), SERIES)


def _span_txt(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    for name, raw in _members(path, content, ".txt"):
        m = re.search(r"_(\d+)_(\d+)_(\d+)\.txt$", name)
        if m:
            x = np.array(raw.split(), float)
            pos = np.arange(len(x))
            yield pd.DataFrame({"series": _stem(name), "pos": pos, "value": x, "label": ((pos >= int(m[2])) & (pos <= int(m[3]))).astype("int32")})


def read_span_txt(spark: SparkSession, path: str) -> DataFrame:
    """TXT files, plain or in zip archives: a number a token; the name ends in train end, anomaly start and end."""
    return _files(spark, path, "*.{txt,zip}").mapInPandas(_each(_span_txt), SERIES)


def _channels(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    for name, raw in _members(path, content, ".csv"):
        t = pd.read_csv(io.BytesIO(raw))
        label = next(c for c in t.columns if c.strip().lower() in ("label", "is_anomaly", "anomaly"))
        for i, c in enumerate(c for c in t.columns if c != label):
            yield pd.DataFrame({"series": _stem(name), "channel": i, "pos": np.arange(len(t)), "value": t[c].astype(float), "label": t[label].astype("int32")}).astype({"channel": "int32"})


def read_channels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Multivariate CSV files in long form; the label column is found by its name."""
    return _files(spark, path, "*.{csv,zip}").mapInPandas(_each(_channels), CHANNELS)


def read_parts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All part files of a folder as one table."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_parts(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet in folders by ``by``; folders that the data don't touch stay (a resumed run replaces its own)."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A score sink: (dataset, part, detector, id, score) in folders by dataset and part; parts that the data don't name stay."""
    write_parts(require(scores, {"dataset", "part", "detector", "id", "score"}).select("dataset", "part", "detector", "id", "score"), path, ["dataset", "part"])


def read_score_matrix(spark: SparkSession, path: str, dataset: str, part: str, detectors: list[str]) -> DataFrame:
    """One row an id, with a column a detector."""
    rows = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("part") == part))
    return rows.groupBy("id").pivot("detector", detectors).agg(F.first("score"))
