"""Token ids on disk: one concatenated array in document order, boundaries in Elias-Fano.

Documents are encoded where they lie, once, and dealt by document id into parts between approximate
quantiles of the ids, so part after part holds the next stretch of the array; where many rows share
an id, they spread over all parts that the id bounds. Each part is cut into segments of about ``SEGMENT_IDS`` ids (a document is
never cut). A segment is one row of a Parquet table: the ids as little-endian 16-bit (or
32-bit, by vocabulary) integers, its document starts and its document ids as Elias-Fano
blocks (``elias_fano``). A reader finds a document's ids with two select calls, for many
documents at once or by document id; no table of all boundaries is built. A document's place in
the whole array is that plus the sizes of earlier segments, which ``read_documents`` sums from
the segments' sizes alone. Files are written by Spark's committer, so a lost task is redone.

Defined results: null text is empty (its array holds the end id only); null doc_ids come
first and read back as null; rows with equal ids are adjacent documents in unspecified
order, adjacent in the array; an empty table gives an empty store; other columns are ignored, whatever their names; a very
long text is one segment of its own.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import received, scratch, shipped
from .shingles import _GAP, mix

SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 16
SEGMENT = "part int, seq int, n_docs long, n_null long, n_ids long, width int, ids binary, starts binary, doc_ids binary"

#: Words whose ids a worker remembers; when there are more, the half that occurs most stays.
MEMO = 200_000
#: Chunks between white space, met twice in a batch, whose ids a worker remembers; when there are more, it starts anew.
KEEP = 100_000
#: UTF-8 bytes of texts encoded together, and words given to the library at once.
TOGETHER, WORDS = 2_000_000, 500
#: The file's rule for words, which is also this module's; another rule goes through the library whole.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


class WordEncoder:
    """Encodes with a tokenizers file.

    If the file's normalizer and pre-tokenizer are those that this class knows (NFC, white space,
    lower case; letters, single digits, other signs), nothing that they do reaches over white space, so
    texts are cut there and each distinct chunk of a batch is encoded once: one of plain Latin characters
    by its words, whose ids are remembered, any other by the library. Words are given to the library in
    lower case between spaces, so its copy for them needs no normalizer and only white space to cut at. Texts
    go to the library whole under any other file. All ways give the library's ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.known = self._knows(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        if self.known:
            self.by_word = Tokenizer.from_file(path)
            self.by_word.normalizer = None
            self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, int] = {}  # a word's place in word_ids
        self.word_ids, self.word_size, self.uses = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.kept, self.kept_ids = pa.array([], pa.utf8()), pa.array([], pa.binary())
        plain = [chr(i) for i in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
        plain = [c for c in plain if c.lower() in plain]  # a few grow, or leave this range, in lower case
        kind = lambda k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k)
        letters, numbers = kind("L"), kind("N")
        self.odd = re.compile("[^" + "".join(map(re.escape, plain)) + "]|<\\|")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall

    @staticmethod
    def _knows(file: dict) -> bool:
        try:
            steps = [(n["type"], n.get("pattern"), n.get("content")) for n in file["normalizer"]["normalizers"]]
            split, spelling = file["pre_tokenizer"]["pretokenizers"]
            return (
                steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
                and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": SPLIT}, "Removed", True)
                and (spelling["type"], spelling["add_prefix_space"], spelling["use_regex"]) == ("ByteLevel", False, False)
                and file["model"]["end_of_word_suffix"] == WORD_END and not file["model"]["dropout"] and file["truncation"] is None and file["padding"] is None
            )
        except (KeyError, TypeError, ValueError):
            return False

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_batch(data, np.array([0, len(data)]))[0].tobytes()

    def encode_batch(self, data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts in UTF-8, text i from row[i] to row[i + 1]: its ids end at ends[i]."""
        if not self.known:
            each = [self.encode_whole(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(each), self.dtype), np.cumsum([len(x) // self.width for x in each], dtype=np.int64)
        solid = ~_GAP[data]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        begun = row[:-1][np.diff(row) > 0]
        start[begun] = solid[begun]
        begin = np.flatnonzero(start)
        upto = np.cumsum(solid)
        place = np.append(upto[begin] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
        chunk = pa.Array.from_buffers(pa.utf8(), len(begin), [None, pa.py_buffer(place), pa.py_buffer(data[solid])]).dictionary_encode()
        kind = chunk.indices.to_numpy()
        known, coded = self._ids_of(chunk.dictionary, np.bincount(kind, minlength=len(chunk.dictionary)))
        ends, ids = _parts(coded.take(pa.array(known[kind])))
        return ids.view(self.dtype), ends[np.searchsorted(begin, row[1:])] // self.width

    def _ids_of(self, chunks: pa.Array, count: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(place, ids): where the ids of each chunk, which occurs ``count`` times in the batch, stand in an array."""
        if len(self.kept) > KEEP:
            self.kept, self.kept_ids = self.kept[:0], self.kept_ids[:0]
        known = pc.fill_null(pc.index_in(chunks, value_set=self.kept), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(known < 0)
        if not len(new):
            return known, self.kept_ids
        known[new] = len(self.kept) + np.arange(len(new))
        added = chunks.take(pa.array(new))
        coded = self._encode_chunks(added)
        ids = pa.concat_arrays([self.kept_ids, coded])
        stay = pa.array(np.flatnonzero(count[new] > 1))
        self.kept = pa.concat_arrays([self.kept, added.take(stay)])
        self.kept_ids = pa.concat_arrays([self.kept_ids, coded.take(stay)])
        return known, ids

    def _encode_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, as bytes."""
        upto = np.cumsum(pc.utf8_length(chunks).to_numpy() + 1, dtype=np.int64)  # with a space behind each chunk
        text = _joined(chunks)
        odd = np.unique(np.searchsorted(upto, [m.start() for m in self.odd.finditer(text)], "right"))
        if len(odd):
            whole = pa.array(list(map(self.encode_whole, chunks.take(pa.array(odd)).to_pylist())), pa.binary())
            plain = np.delete(np.arange(len(chunks)), odd)
            chunks = chunks.take(pa.array(plain))
            upto = np.cumsum(pc.utf8_length(chunks).to_numpy() + 1, dtype=np.int64)
            text = _joined(chunks)
        words = self.words(text.lower())
        number = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[i] for i in new)))
            number[new] = [self.memo[words[i]] for i in new]
        self.uses += np.bincount(number, minlength=len(self.uses))
        ends, ids = _parts(self.word_ids.take(pa.array(number)))
        # a chunk's words fill it, so it ends where as many characters of words do
        cut = np.searchsorted(np.cumsum(self.word_size[number]), upto - np.arange(1, len(upto) + 1), "right")
        coded = pa.Array.from_buffers(pa.binary(), len(chunks), [None, pa.py_buffer(np.append(0, ends[cut]).astype(np.int32)), pa.py_buffer(ids)])
        if len(self.memo) > MEMO:
            self._forget()
        if not len(odd):
            return coded
        place = np.empty(len(odd) + len(plain), np.int64)
        place[np.concatenate([plain, odd])] = np.arange(len(place))
        return pa.concat_arrays([coded, whole]).take(pa.array(place))

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: MEMO // 2])
        stay = stay[self.uses[stay] > 1]
        words = list(self.memo)
        self.memo = {words[i]: n for n, i in enumerate(stay.tolist())}
        self.word_ids, self.word_size = self.word_ids.take(pa.array(stay)), self.word_size[stay]
        self.uses = self.uses[stay] // 2  # what was frequent long ago goes, too

    def _learn(self, words: list[str]) -> None:
        coded = [self.word_ids]
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            ids = np.array(self.by_word.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(cut) == len(some) + 1:
                coded.append(pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(ids.astype(self.dtype))]))
            else:  # a word that the file splits further
                coded.append(pa.array(list(map(self.encode_whole, some)), pa.binary()))
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        self.word_ids = pa.concat_arrays(coded)
        self.word_size = np.append(self.word_size, np.fromiter(map(len, words), np.int64, len(words)))
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))


def _joined(chunks: pa.Array) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), " ")[0].as_py()


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bytes): from where to where the values of a binary array without nulls lie, with 0 first."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = values.buffers()[2]
    return (ends - ends[0]).astype(np.int64), np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its memory of words outlives a batch."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encoded(tokenizer: str, end_id: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(received(tokenizer))
        for batch in batches:
            texts, keys = batch.column("text").cast(pa.utf8()), batch.column("id")
            row = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            key, null = pc.fill_null(keys, 0).to_numpy(), pc.is_null(keys).to_numpy(zero_copy_only=False)
            a = 0
            while a < len(texts):
                b = min(len(texts), max(a + 1, int(np.searchsorted(row, row[a] + TOGETHER))))
                ids, ends = enc.encode_batch(data[row[a] : row[b]], row[a : b + 1] - row[a])
                ids = np.insert(ids, ends, end_id)
                ends = (ends + np.arange(1, b - a + 1)) * enc.width
                coded = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(ids)])
                low, high = np.searchsorted(bounds, key[a:b], "left"), np.searchsorted(bounds, key[a:b], "right")
                spread = mix((ends + row[a:b]).astype(np.uint64)) % (high - low + 1).astype(np.uint64)  # rows of an id that is several bounds
                part = np.where(null[a:b], -1, low + spread.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), keys.slice(a, b - a), coded, pa.array(np.full(b - a, enc.width), pa.int32())], ["part", "id", "ids", "width"])
                a = b
            pa.default_memory_pool().release_unused()  # else a worker holds on to its peak

    return run


def _segments(most_ids: int, most_docs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = None, 0
        ids, lengths, docs, total, n_null, width = [], [], [], 0, 0, 2

        def segment():
            starts = np.concatenate([[0], np.cumsum(lengths)])
            row = (part, seq, len(lengths), n_null, int(starts[-1]), width, b"".join(ids), elias_fano.encode(starts), elias_fano.encode(np.array(docs, np.int64)))
            return pd.DataFrame([row], columns=[c.split()[0] for c in SEGMENT.split(", ")])

        for batch in batches:
            null = batch["id"].isna().to_numpy()
            for own, coded, w, doc, missing in zip(batch["part"].tolist(), batch["ids"], batch["width"].tolist(), batch["id"], null, strict=True):
                if lengths and (own != part or total >= most_ids or len(lengths) >= most_docs):
                    yield segment()
                    ids, lengths, docs, total, n_null, seq = [], [], [], 0, 0, seq + 1
                if own != part:
                    part, seq = own, 0
                width = w
                ids.append(coded)
                lengths.append(len(coded) // width)
                total += lengths[-1]
                if missing:
                    n_null += 1
                else:
                    docs.append(int(doc))
        if lengths:
            yield segment()

    return run


def write_documents(df: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> None:
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("id", F.array(*(F.lit(i / n) for i in range(1, n))), 10 * n).alias("q")).first()["q"] if n > 1 else None  # a number a partition
    coded = rows.mapInArrow(_encoded(shipped(spark, tokenizer), end_id, np.array(bounds or [], np.int64)), "part int, id long, ids binary, width int")
    ordered = coded.repartitionById(n, F.greatest(F.col("part"), F.lit(0))).sortWithinPartitions("part", F.col("id").asc_nulls_first())  # null ids and the first part share a partition
    ordered.mapInPandas(_segments(SEGMENT_IDS, SEGMENT_DOCS), SEGMENT).write.parquet(path)


#: Documents of a segment whose offsets are selected together.
SELECT = 4096


def _documents(at_once: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                starts, docs = elias_fano.EliasFano(s.starts), elias_fano.EliasFano(s.doc_ids)
                ids = np.frombuffer(s.ids, f"<u{s.width}")
                for i in range(0, s.n_docs, at_once):
                    j = min(i + at_once, s.n_docs)
                    at = starts.access_many(np.arange(i, j + 1))
                    data = memoryview(ids[at[0] : at[-1]].astype("<u4").tobytes())
                    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                    own = docs.access_many(np.arange(max(i, s.n_null), j) - s.n_null) if j > s.n_null else np.zeros(0, np.int64)
                    doc_id = pd.array([None] * (j - i - len(own)) + own.tolist(), "Int64")
                    yield pd.DataFrame({"doc_id": doc_id, "part": s.part, "seq": s.seq, "at": at[:-1], "n_tokens": np.diff(at), "ids_crc32": np.array(crc, np.int64)})

    return run


def documents_by_id(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(doc_id, ids): the documents with these ids (a stated query set, sent to the tasks), found in each segment by binary search and select."""
    sought = spark.sparkContext.broadcast(sorted(set(wanted)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.to_dict("records"):
                docs, found = elias_fano.EliasFano(s["doc_ids"]), []
                if len(docs):
                    low, high = docs.access(0), docs.access(len(docs) - 1)
                    for d in sought.value[bisect_left(sought.value, low) : bisect_right(sought.value, high)]:
                        i = docs.first_at_least(d)
                        while i < len(docs) and docs.access(i) == d:  # rows of equal ids are neighbours
                            found.append((d, fetch(s, s["n_null"] + i).astype(np.int64).tolist()))
                            i += 1
                yield pd.DataFrame(found, columns=["doc_id", "ids"])

    return spark.read.schema(SEGMENT).parquet(path).mapInPandas(run, "doc_id long, ids array<long>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start in the whole array, n_tokens and the checksum of its ids."""
    store = spark.read.schema(SEGMENT).parquet(path)
    docs = store.mapInPandas(_documents(SELECT), "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    sizes = store.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per partition of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("seg_at")).join(parts, "part")
    bases = bases.select("part", "seq", (F.col("seg_at") + F.col("part_at")).alias("base"))
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(segment, i: int) -> np.ndarray:
    """Ids of the i-th document of a segment row, by two select calls."""
    starts = elias_fano.EliasFano(segment["starts"])
    a, b = starts.access(i), starts.access(i + 1)
    return np.frombuffer(segment["ids"], f"<u{segment['width']}", b - a, a * segment["width"])


def report(df: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    path = scratch(df.sparkSession, "token-store")
    write_documents(df, path, tokenizer, end_id)
    return read_documents(df.sparkSession, path)
