"""Navigation views over records: grouped and split pages, counts, always-loaded pages, and whether what is on disk still
says the same and may be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.config import CorpusConfig
from shardwright.functions.text import content_key, strip

DECAYS = "decays-with-code"


def display_title(title: Column, name: Column) -> Column:
    return F.btrim(strip(F.coalesce(F.nullif(title, F.lit("")), name)), F.lit('"'))


def live_title(live: Column, title: Column, name: Column) -> Column:
    return F.btrim(strip(F.coalesce(F.nullif(live, F.lit("")), F.nullif(title, F.lit("")), name)), F.lit('"'))


def entry_line() -> Column:
    return F.concat(F.lit("- [["), "name", F.lit("]] — "), display_title(F.col("title"), F.col("name")), F.when(F.col("volatility") == DECAYS, " ⚠️").otherwise(""))


def is_open_finding() -> Column:
    """Open and about the code: both, as a closed finding and a standing rule are neither."""
    return F.coalesce((F.col("status") == "active") & (F.col("volatility") == DECAYS), F.lit(False))


def is_open_task() -> Column:
    return F.coalesce(F.col("status") == "active", F.lit(False))


def is_live(by: str) -> Column:
    return F.coalesce((F.col("volatility") == DECAYS) if by == "volatility" else (F.col("status") == "active"), F.lit(False))


def active(status: Column) -> Column:
    """Not closed; a missing status is not closed."""
    return ~F.coalesce(status, F.lit("")).isin("superseded", "resolved")


def grouped(records: DataFrame, areas: tuple[str, ...], area: str = "area", name: str = "name", order: str = "ord") -> DataFrame:
    """(area, n, names, place): groups in the given order, others after them as they first appear. A missing area is
    `other`."""
    df = records.groupBy(F.coalesce(F.nullif(F.col(area), F.lit("")), F.lit("other")).alias("area")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(order, name))).alias("x"), F.min(order).alias("first"))
    known = F.array_position(F.array(*map(F.lit, areas)), F.col("area"))
    df = df.select("area", "n", F.transform("x", lambda x: x[name]).alias("names"), (known == 0).alias("late"), known.alias("known"), "first")
    # a row for each area
    place = F.row_number().over(Window.orderBy("late", "known", "first"))
    return df.withColumn("place", place.cast("long")).select("area", "n", "names", "place")


def split_counts(records: DataFrame, by: str = "status") -> DataFrame:
    return records.agg(F.count_if(is_live(by)).alias("live"), F.count_if(~is_live(by)).alias("rest"))


def collection_counts(records: DataFrame, collection: str = "collection") -> DataFrame:
    """Records by collection, and the total under a null collection."""
    return records.rollup(collection).agg(F.count("*").alias("n"))


def live_rows(records: DataFrame) -> DataFrame:
    """Open findings of `security` and open tasks of `tasks`: section, name, line."""
    title = live_title(F.col("live_summary"), F.col("title"), F.col("name"))
    line = F.concat(F.lit("- [["), "name", F.lit("]] — "), title)
    sec = records.where((F.col("collection") == "security") & is_open_finding()).select(F.lit("live-security").alias("section"), "name", line.alias("line"), "ord")
    work = records.where((F.col("collection") == "tasks") & is_open_task()).select(F.lit("open-work").alias("section"), "name", line.alias("line"), "ord")
    return sec.unionByName(work)


def compare(rendered: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): `new`, `stale`, `current` or `extra` by full outer comparison of pages (path, body), dates left out."""
    a = rendered.select("path", content_key(F.col("body")).alias("a"))
    b = current.select("path", content_key(F.col("body")).alias("b"))
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "extra").when(F.col("a") == F.col("b"), "current").otherwise("stale")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def is_owned(body: Column, cfg: CorpusConfig = CorpusConfig()) -> Column:
    """A page that we generated: our comment opens one of its first lines. One that mentions it elsewhere isn't ours."""
    pattern = r"^\s*<!--\s*" + cfg.marker.replace(".", r"\.") + r"\b"
    return F.coalesce(F.exists(F.slice(F.split(body, "\n"), 1, cfg.marker_window), lambda x: x.rlike(pattern)), F.lit(False))


def writable(rendered: DataFrame, current: DataFrame, cfg: CorpusConfig = CorpusConfig()) -> tuple[DataFrame, DataFrame]:
    """Pages that may be written, and the paths of those that somebody else's file keeps from it."""
    foreign = current.where(~is_owned(F.col("body"), cfg)).select("path")
    return rendered.join(foreign, "path", "left_anti"), rendered.join(foreign, "path", "left_semi").select("path")


def orphans(current: DataFrame, platforms: DataFrame, enabled: tuple[str, ...], cfg: CorpusConfig = CorpusConfig()) -> DataFrame:
    """Generated files of platforms that are off by now. platforms: (platform, path)."""
    ours = current.where(is_owned(F.col("body"), cfg)).select("path")
    off = platforms.where(~F.col("platform").isin(*enabled)) if enabled else platforms
    return off.join(ours, "path", "left_semi").select("platform", "path")


def platform_pages(body: DataFrame, platforms: DataFrame) -> DataFrame:
    """One body (a single row) for every platform (platform, path, heading): an equi-join on a constant."""
    one = body.limit(1).select("body", F.lit(1).alias("k"))
    return platforms.withColumn("k", F.lit(1)).join(one, "k").select("platform", "path", F.concat("heading", F.lit("\n"), "body").alias("body"))


def memory_dir(root: Column) -> Column:
    return F.translate(root, "/.", "--")


def display_path(path: Column, root: str, home: str) -> Column:
    """Relative to root, else from ~, else as it is."""
    inside = path.startswith(root.rstrip("/") + "/")
    return F.when(inside, F.substr(path, F.lit(len(root.rstrip("/")) + 2))).when(path.startswith(home), F.concat(F.lit("~"), F.substr(path, F.lit(len(home) + 1)))).otherwise(path)


def phantom_references(pages: DataFrame, existing: DataFrame, script: str = "shardwright", variables: dict[str, str] | None = None) -> DataFrame:
    """Backticked references to the tool or an index page whose last word is no existing path. pages: (path, body)."""
    pattern = r"`([^`]*(?:" + script.replace(".", r"\.") + r"|INDEX\.md)[^`]*)`"
    df = pages.select("path", F.explode(F.regexp_extract_all("body", F.lit(pattern), F.lit(1))).alias("ref"))
    target = F.element_at(F.split(strip(F.col("ref")), r"\s+"), -1)
    for k, v in (variables or {}).items():
        target = F.replace(target, F.lit(k), F.lit(v))
    return df.withColumn("target", target).join(existing.select(F.col("path").alias("target")), "target", "left_anti").select("path", "ref", "target")


def spliced(text: Column, name: str, content: Column) -> Column:
    """The text with what stands between a marker pair replaced, by place: content is never read as a pattern."""
    begin, end = f"<!-- BEGIN:sync:{name} -->", f"<!-- END:sync:{name} -->"
    at = F.instr(text, begin)
    rest = text.substr(at + len(begin), F.length(text))
    stop = F.instr(rest, end)
    new = F.concat(F.left(text, at - 1), F.lit(begin + "\n"), content, F.lit("\n" + end), rest.substr(stop + len(end), F.length(text)))
    return F.when((at > 0) & (stop > 0), new).otherwise(text)
