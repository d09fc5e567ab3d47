"""Transcripts to messages, sessions and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.config import DigestConfig
from shardwright.functions.text import clean_message, content_text, first_rule
from shardwright.scratch import written

ROLES = ("user", "assistant")


def mentions(text: Column, match: str, head: int = 200_000) -> Column:
    """Whether the first `head` characters hold the match, case ignored. A later mention doesn't count."""
    return F.contains(F.lower(F.left(text, F.lit(head))), F.lit(match.lower()))


def messages(df: DataFrame, text: str = "text", cfg: DigestConfig = DigestConfig()) -> DataFrame:
    """User and assistant rows with their text cleaned, those of too few characters left out."""
    return df.where(F.col("role").isin(*ROLES)).withColumn(text, clean_message(F.col(text), cfg.cap)).where(F.length(text) >= cfg.least)


def transcript_records(lines: DataFrame) -> DataFrame:
    """(path, line_no, v): lines (path, line_no, value) that are JSON."""
    return lines.withColumn("v", F.try_parse_json("value")).where("v is not null")


def broken_files(records: DataFrame) -> DataFrame:
    """Paths with a line that is JSON but no object: they fail as a whole."""
    return records.groupBy("path").agg(F.bool_or(~F.schema_of_variant("v").startswith("OBJECT")).alias("bad")).where("bad").select("path")


def sessions(lines: DataFrame, source: str, cfg: DigestConfig = DigestConfig()) -> tuple[DataFrame, DataFrame]:
    """Messages (path, line_no, role, text) and metadata (path, cwd, session_id, date) of transcripts of one of two
    kinds: `codex`, whose last session_meta record counts, or `claude`, whose first non-empty values do."""
    records = transcript_records(lines)
    records = records.join(broken_files(records), "path", "left_anti")
    get = lambda p: F.try_variant_get("v", p, "string")
    day = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(10))
    if source == "codex":
        meta = records.where(get("$.type") == "session_meta").groupBy("path").agg(*(F.max_by(c, "line_no").alias(n) for n, c in (("cwd", F.coalesce(get("$.payload.cwd"), F.lit(""))), ("session_id", F.coalesce(get("$.payload.id"), F.lit(""))), ("date", day(get("$.payload.timestamp"))))))
        own = records.where((get("$.type") == "response_item") & (get("$.payload.type") == "message")).withColumn("role", get("$.payload.role"))
        content = F.expr("try_variant_get(v, '$.payload.content', 'variant')")
    else:
        full = lambda c: F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("line_no")))
        meta = records.groupBy("path").agg(full(get("$.cwd")).alias("cwd"), full(get("$.sessionId")).alias("session_id"), full(day(get("$.timestamp"))).alias("date"))
        own = records.where(get("$.type").isin(*ROLES)).withColumn("role", F.coalesce(get("$.message.role"), get("$.type")))
        content = F.expr("try_variant_get(v, '$.message.content', 'variant')")
    own = own.withColumn("content", content).select("path", "line_no", "role", content_text(F.col("content")).alias("text"))
    meta = meta.select("path", *(F.coalesce(c, F.lit("")).alias(c) for c in ("cwd", "session_id", "date")))
    return messages(own, cfg=cfg), meta


def bucket(cwd: Column, cfg: DigestConfig) -> Column:
    rest = F.when(F.contains(F.lower(F.coalesce(cwd, F.lit(""))), F.lit(cfg.match.lower())), "main").otherwise("other")
    return first_rule(cwd, cfg.buckets, rest)


def digests(msgs: DataFrame, meta: DataFrame, source: str, cfg: DigestConfig = DigestConfig()) -> DataFrame:
    """One row per session with a message: bucket, source, date, short_id, cwd, path, text, n_bytes, file."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"], F.lit("\n\n"))), "")
    df = msgs.groupBy("path").agg(body.alias("body")).join(meta, "path", "left").na.fill("", ["cwd", "session_id", "date"])
    short = F.left(F.md5("path"), F.lit(10))
    head = F.concat(F.lit("# session "), short, F.lit(f" | {source} | "), F.col("date"), F.lit(" | cwd="), F.col("cwd"), F.lit("\nsource: "), F.col("path"), F.lit("\n\n"))
    df = df.select(bucket(F.col("cwd"), cfg).alias("bucket"), F.lit(source).alias("source"), "date", short.alias("short_id"), "cwd", "path", F.concat(head, "body").alias("text"))
    name = F.concat(F.coalesce(F.nullif("date", F.lit("")), F.lit("nodate")), F.lit("-"), "source", F.lit("-"), "short_id", F.lit(".md"))
    return df.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("file", name)


def write_digests(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("bucket").parquet(path)


def bucket_stats(df: DataFrame, size: str = "n_bytes", order: str = "path") -> DataFrame:
    """Sessions and whole kilobytes of each bucket, the largest first, ties in order of appearance."""
    out = df.groupBy("bucket").agg(F.count("*").alias("sessions"), F.sum(size).alias("bytes"), F.min(order).alias("first_seen"))
    return out.withColumn("kb", F.expr("bytes div 1024")).orderBy(F.desc("bytes"), "first_seen")


def chunks(df: DataFrame, limit: int = 350_000, size: str = "n_bytes", order: str = "path", by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Digests in groups of about `limit` bytes, within each bucket, in order.

    The running sum goes over ranges of (bucket, order): each range sums up its own rows, and what the ranges before it
    hold of the bucket is added. A bucket of any size is spread over ranges; null buckets are one bucket."""
    ranges = written(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and bucket in it
    sums = ranges.groupBy(*by, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_part").alias("_at"), F.struct(*by).alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    own = ranges.withColumn("_by", F.struct(*by)).withColumn("_own", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    both = own.join(offsets, (F.col("_part") == F.col("_at")) & F.col("_by").eqNullSafe(F.col("_of")))
    return both.select(*(f"`{c}`" for c in df.columns), F.floor((F.col("_own") + F.col("_before")) / limit).alias("chunk"))


def recent(df: DataFrame, since: str, share: float = 0.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Digests since a date with a share of the older ones, chosen by a hash, and the frame of what was skipped."""
    old = F.coalesce(F.col("date") < since, F.lit(True))
    drawn = F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    return df.where(~old | drawn), df.where(old & ~drawn)


def analysis_runs(msgs: DataFrame, preambles: tuple[str, ...]) -> DataFrame:
    """Paths whose first message opens with one of the preambles: transcripts of the analysis itself."""
    first = msgs.groupBy("path").agg(F.min_by("text", "line_no").alias("t"))
    hit = F.lit(False)
    for p in preambles:
        hit = hit | F.col("t").startswith(p)
    return first.where(hit).select("path")
