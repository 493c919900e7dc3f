import gzip
import io
import tarfile
import zipfile

import numpy as np
import pytest

from tallyrank.sources import readers, synthetic
from tallyrank.streaming.windows import rolled_up


def test_npz_both_forms(spark, tmp_path):
    np.savez(tmp_path / "1_a.npz", X=np.array([[1.0, np.nan], [np.inf, 2.0]]), y=[0, 1])
    np.savez(tmp_path / "b.npz", train=np.ones((2, 3)), train_labels=[0, 0], test=np.zeros((1, 3)), test_labels=[1])
    got = sorted(map(tuple, readers.read_npz(spark, str(tmp_path)).collect()))
    assert got == [("1_a", 0, [1.0, 0.0], 0), ("1_a", 1, [0.0, 2.0], 1), ("b", 0, [1.0] * 3, 0), ("b", 1, [1.0] * 3, 0), ("b", 2, [0.0] * 3, 1)]
    assert readers.sized(readers.read_npz(spark, str(tmp_path)), 3, 9).select("dataset").distinct().count() == 1


ARFF = "@relation x\n@attribute att1 real\n@attribute id real\n@attribute 'outlier' {'yes','no'}\n@data\n1.5,1,'no'\n2.5,2,'yes'\n"


def test_arff_plain_and_archive(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "t").mkdir()
    (tmp_path / "p/x.arff").write_text(ARFF)
    with tarfile.open(tmp_path / "t/set.tar.gz", "w:gz") as tar:
        for name, text in (("a/Set_norm_05_v01.arff", ARFF.replace("1.5", "9")), ("a/Set_withoutdupl_norm_05.arff", ARFF)):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    for folder, name in (("p", "x"), ("t", "set")):
        got = sorted(map(tuple, readers.read_arff(spark, str(tmp_path / folder)).collect()))
        assert got == [(name, 0, [1.5], 0), (name, 1, [2.5], 1)]
    assert readers.parse_arff(gzip.decompress(gzip.compress(ARFF.encode())).decode())[1].tolist() == [0, 1]


def test_series_in_archives(spark, tmp_path):
    for d in "cst":
        (tmp_path / d).mkdir()
    with zipfile.ZipFile(tmp_path / "c/a.zip", "w") as z:
        z.writestr("u/s1.csv", "value,Label\n1,0\n2,1\n")
    assert sorted(map(tuple, readers.read_series_csv(spark, str(tmp_path / "c")).collect())) == [("s1", 0, 1.0, 0), ("s1", 1, 2.0, 1)]
    with zipfile.ZipFile(tmp_path / "t/a.zip", "w") as z:
        z.writestr("003_x_2_3_4.txt", "0 1 2\n3 4 5")
    assert [r["label"] for r in readers.read_span_txt(spark, str(tmp_path / "t")).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 0]
    (tmp_path / "s/m.csv").write_text("a,Is_Anomaly,b\n1,0,2\n3,1,4\n")
    assert sorted(map(tuple, readers.read_channels_csv(spark, str(tmp_path / "s")).collect())) == [("m", 0, 0, 1.0, 0), ("m", 0, 1, 3.0, 1), ("m", 1, 0, 2.0, 0), ("m", 1, 1, 4.0, 1)]


def test_parts_resume_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, m string")
    readers.write_parts(df, str(tmp_path / "p"), ["m"])
    readers.write_parts(spark.createDataFrame([(3, "b")], "v int, m string"), str(tmp_path / "p"), ["m"])
    assert sorted(r["v"] for r in readers.read_parts(spark, str(tmp_path / "p")).collect()) == [1, 3]
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require(df, {"v", "z"})
    readers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


@pytest.mark.parametrize("kind", ["blobs", "moons", "ring", "wide", "dense_off_centre"])
def test_synthetic_tabular(spark, kind):
    a, b = (synthetic.tabular(spark, kind).repartition(n).orderBy("row_id").collect() for n in (2, 5))
    assert a == b and len(a) == 1560 and sum(r["label"] for r in a) == 60 and np.isfinite([r["features"] for r in a]).all()


@pytest.mark.parametrize("kind", synthetic.INJECTIONS)
def test_synthetic_series(spark, kind):
    rows = synthetic.series(spark, kind).collect()
    n = sum(r["label"] for r in rows)
    assert len(rows) == 10_000 and n == {"none": 0, "spike": 10}.get(kind, 1200)


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.range(500).selectExpr("timestamp_seconds(id * 3) as ts", "concat('t', id % 2) as event_type", "cast(id % 11 as double) as value")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = rolled_up(stream).writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["event_type"], r["start"], r["n"], round(r["mean"], 9)) for r in df.collect())
    assert key(spark.table("rolled")) == key(rolled_up(batch))


def test_score_sink_keeps_other_parts(spark, tmp_path):
    path, schema = str(tmp_path / "scores"), "dataset string, part string, detector string, id long, score double"
    readers.write_scores(spark.createDataFrame([("d", "val", k, i, i + 0.5) for k in "ab" for i in range(3)] + [("d", "test", "a", 0, 9.0)], schema), path)
    readers.write_scores(spark.createDataFrame([("d", "val", "a", 7, 1.0), ("d", "val", "b", 7, 2.0)], schema), path)
    assert [tuple(r) for r in readers.read_score_matrix(spark, path, "d", "val", ["a", "b"]).collect()] == [(7, 1.0, 2.0)]
    assert [tuple(r) for r in readers.read_score_matrix(spark, path, "d", "test", ["a", "b"]).collect()] == [(0, 9.0, None)]
