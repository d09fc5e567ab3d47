"""Readers of exported text: transcripts, traps, evaluation results, git logs, path lists. All go through Spark's file
sources; an absent or broken export raises, it never reads as empty (but for stored results, which start empty)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardwright.functions.text import file_path
from shardwright.operators.digest import mentions
from shardwright.operators.evalstats import RESULTS
from shardwright.sources.vault import read_checkout

TRAPS = "id string, project string, type string, workspace string, prompt string, criterion string, shard string"


def transcript_lines(spark: SparkSession, root: str, match: str | None = None, head: int = 200_000) -> DataFrame:
    """(path, line_no, value) of the .jsonl files under root; with a match, of those that mention it near their start."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    files = files.select(file_path(F.col("_metadata.file_path")).alias("path"), "value")
    if match:
        files = files.where(mentions(F.col("value"), match, head))
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return rows.where(F.trim("value") != "")


def traps(spark: SparkSession, path: str) -> DataFrame:
    """Traps in file order; a line that isn't JSON is an error."""
    rows = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    return rows.select("ord", F.from_json("value", TRAPS, {"mode": "FAILFAST"}).alias("t")).select("ord", "t.*")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stored evaluation results; where there is no such path yet, an empty table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], RESULTS)
    return spark.read.schema(RESULTS).json(path)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def checkpoint_results(items: DataFrame, path: str, checkpoint: str, run: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Results of a stream of items, kept batch by batch: each batch goes through run and into a folder of its own number.
    A batch that was written but not committed when the driver died is written again into the same folder, so every item
    has its results once."""

    def keep(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").json(f"{path}/batch={number:08d}")

    return items.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON lines, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def kept_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What checkpoint_results() has kept so far, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch int").json(path)


def repo_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) below a checkout, relative to it, hidden names included: names only, contents aren't read."""
    return read_checkout(spark, root, contents=False).select("path")


def tracked_files(spark: SparkSession, root: str, listing: str | None = None) -> DataFrame:
    """(path, content) for a leak scan: every file of a working copy, or those that a listing (an export of
    `git ls-files`) names."""
    files = read_checkout(spark, root)
    return files.join(spark.read.text(listing).select(F.col("value").alias("path")).distinct(), "path", "left_semi") if listing else files


def patches(spark: SparkSession, path: str) -> DataFrame:
    """(sha, line) of an export of `git log -p` or of a diff, whose sha is empty. A commit is a record of its own, so
    that its lines need no running state."""
    rows = spark.read.option("lineSep", "\ncommit ").text(path)
    head = r"^(?:commit )?([0-9a-f]{7,64})(?:[ \n]|\z)"
    rows = rows.select(F.regexp_extract("value", head, 1).alias("sha"), F.split(F.regexp_replace("value", "\n\\z", ""), "\n").alias("lines"))
    return rows.select("sha", F.explode(F.when(F.col("sha") == "", F.col("lines")).otherwise(F.slice("lines", 2, F.size("lines")))).alias("line"))


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) for each change of a file, from an export of `git log --pretty=format: --name-only`."""
    return spark.read.text(path).where("value <> ''").select(F.col("value").alias("path"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, message) from JSON lines of a log export."""
    return spark.read.schema("sha string, message string").option("mode", "FAILFAST").json(path)


def tags_of(rows: DataFrame, line: str = "value") -> DataFrame:
    """Tag names from lines of `<sha> refs/tags/<name>`; a peeled tag is the tag itself."""
    return rows.select(F.regexp_extract(line, r"refs/tags/(\S+?)(?:\^\{\})?$", 1).alias("tag")).where("tag <> ''").distinct()


def tags(spark: SparkSession, path: str) -> DataFrame:
    return tags_of(spark.read.text(path))
