"""A pipeline over `documents`: each stage's result is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm import lang_id, mixing, secrets
from shardwright.llm.decontaminate import decontaminated
from shardwright.llm.ngram_join import ngram_join
from shardwright.llm.shared import fold, forget, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without a letter or like no learned language go. The models learn from
    the same three quarters of the labelled documents as in op1."""
    model = lang_id.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    own = [f"`{c}`" for c in docs.columns]
    return lang_id.predict(docs, model, *own, prefix="_judged_").where("not _judged_rejected").select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five words, Jaccard 0.8 or more)."""
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("mark")))
    keep = ngram_join(keyed, id_col="_key").where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("_key"))
    return keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets in their texts replaced."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, in order of virtual finish time."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: Language identification is no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}-{name}")
            if before is not None:
                forget(before)  # a stage's input isn't read again once its result is written
            before = docs
    return docs
