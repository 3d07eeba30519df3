"""Corpus pipeline: language ID, line dedup, near-dedup, mixing and BPE over ``documents``.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, lines, mixing, neardup
from quarry.llm.common import staged, table

#: A document is kept if its language is known with at least this score.
MIN_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; without any learned language, all."""
    model = langid.train(langid.learnable(docs))
    if not model.langs:
        return docs
    return langid.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; n_chars follows."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; those without a word all stay."""
    return neardup.keep_first(docs, neardup.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs, staged(mixing.mix(docs, F.array("source")), "mix"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document of the mix."""
    import public_tokenizers

    out = bpe.digests(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: Language ID, seeded selection and tokenization are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
