"""A corpus pipeline over the table of documents: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import exact_dedup, lang_id, near_dedup, packing, substring_dedup
from stratum.llm.common import discard, fresh, read, staged, temporary
from stratum.llm.queries import tokenizer


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns languages from the labelled documents; those that the model rejects go."""
    model = lang_id.fit(docs)
    found = fresh(docs, "language")
    return docs.withColumn(found, lang_id.predict(model, F.col("text"))).filter(~F.col(found)["rejected"]).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, and of those that the session's digest index lacks."""
    return exact_dedup.kept_rows(docs, *exact_dedup.index_of(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates."""
    return near_dedup.kept_rows(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has, and counts the characters anew."""
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: Language ID, likelihoods and packing are not for SQL; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's result is written and read again, and its other tables and the result before it are deleted."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary() as kept:
            docs = kept(staged(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
