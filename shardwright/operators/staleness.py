"""Time-sensitive records: which to verify again, which can't be aged, and which cite sources that are gone."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.config import StaleConfig
from shardwright.functions.frontmatter import as_date
from shardwright.functions.text import basename
from shardwright.scratch import written


def today(cfg: StaleConfig = StaleConfig()) -> datetime.date:
    """The set day, if it is shaped like a date (one that no calendar has is an error), else the real one."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", cfg.today or ""):
        return datetime.date.fromisoformat(cfg.today)
    return datetime.date.today()


def volatile(records: DataFrame) -> DataFrame:
    return records.where(F.contains("volatility", F.lit("decays")))


def queue(records: DataFrame, cfg: StaleConfig = StaleConfig()) -> DataFrame:
    """Volatile records older than the threshold, the oldest first: age_days, rel, updated, title."""
    df = volatile(records).withColumn("day", as_date(F.col("updated"))).where("day is not null")
    df = df.withColumn("age_days", F.datediff(F.lit(today(cfg)), "day").cast("long")).where(F.col("age_days") > cfg.days)
    title = F.btrim(F.coalesce(F.nullif("title", F.lit("")), F.col("name")), F.lit('"'))
    return df.select("age_days", "rel", "updated", title.alias("title")).orderBy(F.desc("age_days"), F.desc("rel"), F.desc("updated"), F.desc("title"))


def undated(records: DataFrame) -> DataFrame:
    """Volatile records without a day that exists."""
    return volatile(records).where(as_date(F.col("updated")).isNull()).select("rel", "updated")


# Fixed pattern: what counts as a cited source path.
def anchor_pattern(cfg: StaleConfig = StaleConfig()) -> str:
    return r"`([A-Za-z0-9_./\-]+\.(?:" + "|".join(cfg.extensions) + r"))(?::\d+)?`"


def anchors(records: DataFrame, cfg: StaleConfig = StaleConfig(), text: str = "body") -> DataFrame:
    """(rel, cited, base, ord): each source path that a record cites, once, numbered by where it is first cited."""
    df = records.select("rel", F.posexplode(F.array_distinct(F.regexp_extract_all(text, F.lit(anchor_pattern(cfg)), F.lit(1)))).alias("ord", "cited"))
    return df.groupBy("rel", "cited").agg(F.min("ord").alias("ord")).select("rel", "cited", basename(F.col("cited")).alias("base"), "ord")


def code_index(paths: DataFrame, cfg: StaleConfig = StaleConfig()) -> DataFrame:
    """(path, base) of files outside the pruned folders."""
    inner = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda x: x.isin(*cfg.pruned)) if cfg.pruned else F.lit(False)
    return paths.where(~F.coalesce(inner, F.lit(False))).select("path", basename(F.col("path")).alias("base"))


def missing_anchors(cited: DataFrame, index: DataFrame) -> DataFrame:
    """Citations that no indexed path ends with (not even within a segment), of the same base name, each record's in the
    order of their ord, if cited has one. With an empty index nothing is checked and nothing is missing."""
    some = index.limit(1).select(F.lit(1).alias("k"))
    found = ending_with(cited.select("cited").distinct(), index.select("path"))
    gone = cited.join(found, "cited", "left_anti")
    own = ["rel", "cited", *(["ord"] if "ord" in cited.columns else [])]
    return gone.select(*own, F.lit(1).alias("k")).join(some, "k", "left_semi").select(*own).orderBy("rel", own[-1])


#: Ends a reversed path; no path holds it.
_END = "\0"


def ending_with(cited: DataFrame, paths: DataFrame) -> DataFrame:
    """(cited) of those that some path ends with, the base name being whole.

    Written backwards, the paths that end with a citation are neighbours: they follow it in order. So both are sorted
    together over ranges, and each citation looks at the next path only: in its own range, else the first one of the
    ranges after it. A base name that half of all paths share is spread over ranges like any other text."""
    back = F.reverse("cited")
    whole = F.when(F.contains("cited", F.lit("/")), F.array(back)).otherwise(F.array(F.concat(back, F.lit("/")), F.concat(back, F.lit(_END))))
    probes = cited.where("cited is not null").distinct().select("cited", F.explode(whole).alias("key"), F.lit(None).cast("string").alias("path"))
    own = F.concat(F.reverse("path"), F.lit(_END))
    keys = paths.where("path is not null").select(own.alias("key")).distinct().select(F.lit(None).cast("string").alias("cited"), "key", F.col("key").alias("path"))
    ranges = written(probes.unionByName(keys).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    # a row for each range
    firsts = ranges.groupBy("part").agg(F.min("path").alias("first"))
    later = firsts.select("part", F.min("first").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    before = Window.partitionBy("part").orderBy(F.desc("key"), F.col("path").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    following = ranges.withColumn("next", F.last("path", True).over(before)).where("cited is not null").join(later, "part")
    return following.where(F.coalesce("next", "later").startswith(F.col("key"))).select("cited").distinct()


def ages(day: Column, cfg: StaleConfig) -> Column:
    return F.datediff(F.lit(today(cfg)), day).cast("long")
