"""Structured Streaming over incoming pages: each new file is parsed and linted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardwright.config import LintConfig
from shardwright.functions.text import file_path
from shardwright.operators.lint import findings, shards


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """(rel, collection, text) of new .md files under path/<collection>/."""
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    parts = F.split(file_path(F.col("_metadata.file_path")), "/")
    rel = F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))
    return files.select(rel.alias("rel"), F.element_at(parts, -2).alias("collection"), F.col("value").alias("text"))


def lint_stream(spark: SparkSession, path: str, out: str, checkpoint: str, cfg: LintConfig = LintConfig()) -> StreamingQuery:
    """Findings of what is there and hasn't been seen, appended as Parquet; per-file rules need no state."""
    found = findings(shards(incoming(spark, path)), cfg)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type under a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
