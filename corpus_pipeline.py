"""From raw documents to sampled token ids: five stages over the corpus operators.

Each stage takes all rows its predecessor kept. Stages but the last return the columns of
``documents``; the last returns, per document, its ids and its sampled segmentations.

In every stage: an empty table gives an empty one; further columns, whatever their names, pass
through all but the last; very long texts are worked on whole. What nulls, empty texts, ties and
repeated rows give is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import decontaminate, line_dedup, minhash, quality_rules, sentencepiece_sampling
from tallyrank.llm.common import scratch, table
from tallyrank.llm.queries import tokenizer_file


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule accepts.

    Null and empty texts have too few words and go; a null id doesn't matter; repeated rows are
    judged alike, so all or none of them stay.
    """
    return quality_rules.keep_good(docs)


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks and the passages over 50 words that an earlier document holds; n_chars follows the text.

    A null text stays null, an empty one empty; rows of equal id and text are one document, so
    repeated rows lose the same; a null id ranks last, rows of equal id and other text by a hash.
    A text may become empty; its row stays.
    """
    done = line_dedup.clean(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the smallest id.

    Texts without words (null, empty) are linked with nothing and stay; rows of a null id stay; rows
    that share a doc_id stay or go together.
    """
    return minhash.keep_one(docs, k=5, percent=80)


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget.

    Null and empty texts and items match nothing; each row is judged by its own text, so ids,
    null or repeated, don't matter.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def apply_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (16-bit little-endian) and samples of each document.

    A null or empty text has no ids and one sample without ids; rows of equal id and text get equal
    samples; a null id is a key of its own.
    """
    done = sentencepiece_sampling.encode_and_sample(docs, tokenizer_file("piece_bpe_32k.model"))
    return done.select("doc_id", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), "ids", "samples")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", apply_line_dedup),
    ("MinHash near-dedup", apply_near_dedup),
    ("benchmark decontamination", apply_decontamination),
    ("SentencePiece encoding", apply_encoding),
]

#: SQL has no edit-distance search and no piece lattice; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
