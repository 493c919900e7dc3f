import base64
import gzip
import hashlib
import io
import math
import random
import zlib
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyrank.llm import compression_classifier as cc
from tallyrank.llm import warc
from tallyrank.llm.common import scratch


def labelled(n=600, seed=3):
    rng = random.Random(seed)
    good = ["the", "river", "flows", "over", "stones", "and", "we", "walk", "along", "its", "bank", "in", "summer"]
    docs, labels = [], []
    for i in range(n):
        ok = rng.random() < 0.7
        words = [rng.choice(good) if ok else rng.choice(good).upper() + "!!" for _ in range(rng.randint(5, 150))]
        docs.append((i, " ".join(words)))
        labels.append((i, int(ok), 0))
    return docs, labels


def test_held_out_accuracy_and_repeatability(spark):
    docs, labels = labelled()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cc.report(d.repartition(3), y).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 60 and sum(r.predicted == labels[r.doc_id][1] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    again = {r.doc_id: r.score for r in cc.report(d.repartition(7), y).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_scores_equal_brute_force(spark):
    docs, labels = labelled(200)
    docs += [(1000, None), (1001, ""), (1002, "the river " * 5000), (None, "BANK!!")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = cc.learn(d, y)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x), level=3, write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    got = {r.doc_id: r.score for r in cc.report(d, y).collect()}
    for doc, text in docs:
        data = (text or "").encode()
        good, bad = (sum(len(c.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)) for c in packers)
        n = len(data) + 100
        x = [(bad - good) / n, len(data) / n, max(0.0, 0.3 * len(data) - good) / n, 1.0]
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True)))), rel=1e-9)


def test_one_long_text_does_not_use_up_the_sample(spark, monkeypatch):
    monkeypatch.setattr(cc, "SAMPLE_BYTES", 200_000)
    monkeypatch.setattr(cc, "SAMPLE_TEXT", 10_000)
    docs, labels = labelled(200)
    docs = [(i, t * 10_000 if i % 50 == 1 else t) for i, t in docs]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert set(cc.training_sample(d, y)["q"]) == {0, 1} and len(cc.training_sample(d, y)) > 100


def test_held_out_labels_are_not_used(spark):
    docs, labels = labelled(300)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = y.withColumn("quality", F.when(cc.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in cc.report(d, x).collect()} for x in (y, flipped))
    assert a == b


def test_odd_labels_and_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (1, "again")], "doc_id long, text string").withColumn("score", F.lit(7))
    none = spark.createDataFrame([(1, None, 0), (2, 5, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in cc.report(d, none).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert cc.report(d, both).count() == 4 and cc.report(d.limit(0), both).count() == 0


def pages(spark):
    rows = [(1, "http://a", "<p>é漢</p>"), (5, "http://b", "<p>é漢</p>"), (3, "http://c\r\nX: y", "<p>é漢</p>"), (2, None, None), (4, "http://d", ""), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "n", "only"), (7, "z", "only"), (8, "big", "x" * 300_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_archives_round_trip(spark):
    rows, df = pages(spark)
    got = {r.page_id: r for r in warc.report(df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        r = got[page]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page == max(same) else ("revisit", max(same)))


def test_small_payloads_are_stored_and_captures_nest(spark):
    _, df = pages(spark)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, path, min_bytes=10)
    captures = warc.transactions(warc.read_archives(spark, path)).collect()
    by = {c.page_id: c for c in captures}
    assert by[2].response.record_type == by[4].response.record_type == by[None].response.record_type == "response"
    assert bytes(by[8].response.payload) == b"x" * 300_000 and by[8].response.intact
    for c in captures:
        assert bytes(c.request.block).startswith(b"GET ") and c.metadata.payload_bytes is not None


def test_parser_reads_member_after_member():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for data in (record * 3, gzip.compress(record) + gzip.compress(record * 2)):
        stream = io.BufferedReader(warc._Inflate(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
        assert [b for _, b in warc.parse(stream)] == [b"ab\r\nc"] * 3


def test_archives_conform(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    rows, df = pages(spark)
    path = scratch(spark, "warc-test")
    warc.write_archives(df.union(df.where("page_id = 1")), path)
    files = sorted(Path(path).glob("part-*"))
    ids, refers, n = [], [], 0
    for f in files:
        data, records = f.read_bytes(), []
        while data:  # each record is a member of its own
            inflate = zlib.decompressobj(31)
            records.append(inflate.decompress(data) + inflate.flush())
            assert inflate.eof
            data = inflate.unused_data
        parsed = [next(warc.parse(io.BytesIO(r))) for r in records]
        assert parsed[0][0]["warc-type"] == "warcinfo" and sum(h["warc-type"] == "warcinfo" for h, _ in parsed) == 1 and len(parsed) <= 10
        for (h, block), raw in zip(parsed, records, strict=True):
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and not any(k.startswith("x-") for k in h)
            ids.append(h["warc-record-id"])
            refers += [h["warc-refers-to"]] if "warc-refers-to" in h else []
            if h["warc-type"] in ("response", "revisit"):
                n += 1
                assert block.startswith(b"HTTP/1.1 200 OK\r\n") and h["content-type"] == "application/http; msgtype=response"
    assert n == len(rows) + 1 and len(set(ids)) == len(ids) and refers and set(refers) <= set(ids)


def test_public_forms_are_joined(spark, tmp_path):
    """A response that names its request, several concurrent-to headers, and a chunked body whose digest isn't that of its bytes."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    record = lambda kind, at, more, block: warc._record(kind, at, more, block)
    data = record("request", "<q>", [], b"GET / HTTP/1.1\r\n\r\n") + record("metadata", "<m>", [], b"payload-bytes: 5\r\n")
    data += record("response", "<r>", [("WARC-Concurrent-To", "<q>"), ("WARC-Concurrent-To", "<m>"), ("WARC-Payload-Digest", "sha1:TRUE"), ("Content-Type", "application/http; msgtype=response")], http)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", "<alone>", [("Content-Type", "text/html")], b"plain")))
    got = {c.response.record_id: c for c in warc.transactions(warc.read_archives(spark, str(tmp_path))).collect()}
    assert got["<r>"].request.record_id == "<q>" and got["<r>"].metadata.payload_bytes == 5
    assert got["<r>"].response.payload_digest == "TRUE" and got["<r>"].response.intact is None
    assert got["<alone>"].request is None and bytes(got["<alone>"].response.payload) == b"plain" and got["<alone>"].response.intact


def test_records_over_16_mb(spark):
    big = "ab" * (9 << 20)
    df = spark.createDataFrame([(1, "u", big), (2, "v", "small")], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.payload_bytes for r in warc.report(df).collect()}
    assert got == {1: 18 << 20, 2: 5}


def test_empty(spark):
    assert warc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_captures_are_joined_within_files_and_across(spark, tmp_path):
    """The reader's join and the join of all records give the same, payloads among it, also where a capture's records lie in two files."""
    _, df = pages(spark)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, path)
    record = lambda kind, at, more, block: warc._record(kind, at, more, block)
    http = [("Content-Type", "application/http; msgtype=response")]
    (tmp_path / "a.warc").write_bytes(record("response", "<r>", http, b"HTTP/1.1 200 OK\r\n\r\nbody") + record("request", "<q>", [("WARC-Concurrent-To", "<r>")], b"GET /"))
    (tmp_path / "b.warc").write_bytes(record("metadata", "<m>", [("WARC-Concurrent-To", "<r>")], b"page-id: 77\r\npayload-bytes: 4\r\n") + record("response", "<alone>", http, b"HTTP/1.1 200 OK\r\n\r\n"))
    for place in (path, str(tmp_path)):
        plain = lambda rows: sorted((str(r.page_id), str(r.request), str(r.response), str(r.metadata)) for r in rows)
        got, want = warc.read_transactions(spark, place), warc.transactions(warc.read_archives(spark, place))
        assert plain(got.collect()) == plain(want.select(*got.columns).collect()) and got.count() > 0
    assert {r.response.record_id: bytes(r.response.payload) for r in warc.read_transactions(spark, str(tmp_path)).collect()} == {"<r>": b"body", "<alone>": b""}
