"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Between stages the rows are written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, mixing, quality_classifier, queries, secrets, setsketch
from veilframe.llm.names import unused
from veilframe.session import table, through_parquet

QUALITY = 0.3  # documents that score less go


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels that op8 learns from.

    Null and empty texts are scored as well; without any label all score 0.5 and stay; repeated rows fare alike; ties at
    QUALITY stay; an empty table stays empty; further columns stay, whatever their names."""
    labels = table(spark, sf_dir, "labels").filter(queries.remainder("doc_id", 5) != 0)
    weights = quality_classifier.train(docs, labels.select("doc_id", F.col("quality").alias("y")))
    (score,) = unused(docs, "_score")
    return quality_classifier.scored(docs, weights, score).filter(F.col(score) >= QUALITY).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id.

    Null texts and texts without a word are linked with nothing and stay, as do rows without doc_id; rows that share the
    kept doc_id stay together; long texts are compared whole; further columns stay, whatever their names."""
    gone = setsketch.groups(docs.select("doc_id", "text")).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark.

    Null and empty texts stay as they are; texts of any length are scanned whole; overlapping secrets give one mark;
    repeated rows fare alike; further columns stay, whatever their names."""
    return secrets.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken.

    Null and empty texts have no words and go with their block; a null source is a source; ties are settled by hash, then
    doc_id; repeated rows are rows of their own; an empty table gives an empty mix; further columns stay, whatever their names."""
    shard, order = unused(docs, "_shard", "_order")
    return mixing.mixed(docs, shard=shard, order=order).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests of them and of what they decode to.

    Null and empty texts have no ids; texts of any length are encoded whole; repeated rows have equal ids; an empty table
    gives none; further columns do not matter."""
    import public_tokenizers as p

    return bpe.tokenized(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the merges; tests/llm/test_pipeline.py compares run() with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = through_parquet(docs)
    return docs
