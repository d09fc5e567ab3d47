"""Git exports, logs, views and session starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.functions.frontmatter import line_value
from shardwright.operators.nav import active

CLASSES: list[tuple[str, str]] = [("gotcha", r"(?i)\b(fix|bug|revert|workaround)"), ("decision", r"(?i)\b(decision|choose|switch)|instead of"), ("candidate", r"(?i)\b(incident|refactor)")]
#: Views by name, type that they show, columns. operators.views reads them from a file.
VIEWS: list[tuple[str, str, list[str]]] = [
    ("Gotchas", "gotcha", ["name", "area", "volatility", "updated"]),
    ("Decisions", "decision", ["name", "area", "status", "updated"]),
    ("Security", "security", ["name", "status", "volatility", "updated"]),
    ("Tasks", "task", ["name", "area", "status", "updated"]),
    ("Repos", "repo", ["name", "area", "updated"]),
]


def hot_files(changes: DataFrame, path: str = "path", most: int = 30) -> DataFrame:
    """The most changed files, ties by path."""
    return changes.groupBy(path).agg(F.count("*").alias("n")).orderBy(F.desc("n"), path).limit(most)


def commit_class(subject: Column) -> Column:
    """The first class whose words a commit subject has; null for none."""
    out = F.lit(None).cast("string")
    for name, p in reversed(CLASSES):
        out = F.when(subject.rlike(p), name).otherwise(out)
    return out


def log_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """`## [date] kind | summary` headings."""
    p = r"^## \[(\d{4}-\d{2}-\d{2})\] ([^|]*?) \| (.*)$"
    keep = [c for c in lines.columns if c != line]
    return lines.where(F.col(line).rlike(p)).select(*keep, *(F.regexp_extract(line, p, i).alias(n) for i, n in ((1, "date"), (2, "kind"), (3, "summary"))))


def latest(entries: DataFrame, n: int = 10, order: str = "ord") -> DataFrame:
    return entries.orderBy(F.desc(order)).limit(n)


def view(records: DataFrame, name: str) -> DataFrame:
    kind, columns = next((k, c) for v, k, c in VIEWS if v == name)
    return records.where(F.col("type") == kind).select(*columns)


def session_start(files: DataFrame) -> DataFrame:
    """(section, name, title) of gotchas that aren't closed, then of active tasks. files: (collection, rel, text)."""
    df = files.select("collection", "rel", *(line_value(F.col("text"), k).alias(k) for k in ("name", "title", "status")))
    shown = ((F.col("collection") == "gotchas") & active(F.col("status"))) | ((F.col("collection") == "tasks") & (F.col("status") == "active"))
    return df.where(shown).select(F.col("collection").alias("section"), "name", F.replace("title", F.lit('"'), F.lit("")).alias("title"), "rel").orderBy("section", "rel")


def staged_pages(staged: DataFrame, vault: str = "_knowledge", path: str = "path") -> DataFrame:
    return staged.where(F.col(path).rlike(f"^{vault}/.*\\.md$"))


def code_nudge(staged: DataFrame, prefixes: list[str], vault: str = "_knowledge") -> DataFrame:
    """The first prefix (a pattern) that a staged path matches, if no page is staged. One row, or none."""
    df = staged.agg(F.count_if(F.col("path").rlike(f"^{vault}/")).alias("pages"), *(F.count_if(F.col("path").rlike(f"^{p}")).alias(f"p{i}") for i, p in enumerate(prefixes)))
    hit = F.coalesce(*(F.when(F.col(f"p{i}") > 0, F.lit(p)) for i, p in enumerate(prefixes)))
    return df.where("pages = 0").select(hit.alias("prefix")).where("prefix is not null")


def merged_items(items: DataFrame, records: DataFrame, key: str = "title") -> DataFrame:
    """Extracted items that no record has yet, once each, by source priority: git, then docs, then transcripts."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("git", "docs", "transcripts"))), F.col("origin")), F.lit(0)), F.lit(99))
    df = items.join(records.select(key).distinct(), key, "left_anti").withColumn("priority", rank)
    first = F.row_number().over(Window.partitionBy("type", key).orderBy("priority", "body"))
    return df.withColumn("_n", first).where("_n = 1").drop("_n")


def size_test(records: DataFrame, pages: int = 200, tokens: int = 100_000, core: int = 30) -> DataFrame:
    """Counts against the design ceiling; tokens are an estimate of four characters each."""
    df = records.agg(F.count("*").alias("pages"), F.floor(F.sum(F.length("text")) / 4).alias("tokens_estimate"), F.count_if(F.col("core")).alias("core_items"))
    return df.withColumn("over", (F.col("pages") > pages) | (F.col("tokens_estimate") > tokens) | (F.col("core_items") > core))
