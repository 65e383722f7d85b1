"""The queries of this subpackage: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.oracle import ORACLE as ORACLE
from veilframe.session import table


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = langid.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import lattice

    return lattice.groups(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import quality_rules

    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import suffix_dedup

    return suffix_dedup.cut(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import setsketch

    return setsketch.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import quality_classifier as q

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    w = q.train(docs, labels.filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("y")))
    out = q.scored(docs.select("doc_id", "text"), w)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    from veilframe.llm import bpe

    return bpe.tokenized(table(spark, sf_dir, "documents"), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, ids=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import mixing

    return mixing.planned_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import whitening

    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm import collocations

    return collocations.mined(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    from veilframe.llm import packing

    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), p.path("byte_bpe_50k.json"), end=2)


QUERIES = {f.__name__: f for f in (op1_pii, op2_language_id, op3_embedding_dedup, op4_quality_rules, op5_suffix_dedup, op6_secrets, op7_near_dedup, op8_quality_classifier, op9_byte_bpe, op10_mixing, op11_whitening, op12_collocations, op13_packing)}
