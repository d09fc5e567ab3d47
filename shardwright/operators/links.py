"""Link graph: wikilinks, markdown links and URLs of pages, what they point to, and what is broken."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions.text import basename, normal_path, strip, strip_code

# Fixed patterns: what counts as a link.
WIKI = r"\[\[([^\]\n]+)\]\]"
MD_LINK = r"(?<!\!)\[[^\]]*\]\(([^)]+)\)"
URL = r"(https?://[^\s)\]<>\"']+)"
# Names of generated pages, which resolve even where the page is absent.
GENERATED = ("INDEX", "gotchas", "decisions", "security", "tasks", "repos", "reference")
#: Answers to HEAD that say nothing about the page.
FINE = (403, 405, 429)


def wiki_target(raw: Column) -> Column:
    """The bare record name that a wikilink means."""
    t = F.split_part(F.split_part(raw, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1))
    t = strip(F.regexp_replace(strip(t), r"\\+\z", ""))
    return F.regexp_replace(basename(t), r"\.md\z", "")


def links(files: DataFrame) -> DataFrame:
    """(rel, kind, raw, target, ord) of all links of files (rel, text); links within code or comments are none."""
    df = files.select("rel", strip_code(F.coalesce("text", F.lit(""))).alias("t"))
    some = lambda kind, pattern: df.select("rel", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all("t", F.lit(pattern), F.lit(1))).alias("ord", "raw"))
    wiki = some("wiki", WIKI).withColumn("target", wiki_target(F.col("raw"))).where("target <> ''")
    md = some("md", MD_LINK).withColumn("raw", strip(F.col("raw")))
    for p in ("http://", "https://", "#", "mailto:"):
        md = md.where(~F.col("raw").startswith(p))
    folder = F.regexp_replace("rel", r"[^/]*\z", "")
    path = F.split_part("raw", F.lit("#"), F.lit(1))
    md = md.withColumn("path", path).where("path <> ''").withColumn("target", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(normal_path(F.concat(folder, "path")))).drop("path")
    url = some("url", URL).withColumn("raw", F.expr("trim(trailing '.,;' from raw)")).withColumn("target", F.col("raw"))
    return wiki.unionByName(md).unionByName(url).select("rel", "kind", "raw", "target", F.col("ord").cast("long").alias("ord"))


def known_names(files: DataFrame, generated: tuple[str, ...] = GENERATED) -> DataFrame:
    names = files.select(F.regexp_replace(basename(F.col("rel")), r"\.md\z", "").alias("target"))
    return names.unionByName(files.sparkSession.createDataFrame([(x,) for x in generated], "target string")).distinct()


def broken_wiki(found: DataFrame, names: DataFrame) -> DataFrame:
    """Wikilinks whose target is no name, repeats kept."""
    return found.where("kind = 'wiki'").join(names.select("target"), "target", "left_anti").select("rel", "target", "ord")


def broken_paths(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Markdown links whose target is no file or folder. paths: (path) of all files; folders follow from them."""
    up = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, 1, i), "/"))
    every = paths.select(F.explode(parents).alias("target")).where("target <> ''").unionByName(paths.sparkSession.createDataFrame([(".",)], "target string")).distinct()
    return found.where("kind = 'md'").join(every, "target", "left_anti").select("rel", F.col("raw").alias("target"), "ord")


def backlinks(found: DataFrame) -> DataFrame:
    return found.where("kind = 'wiki'").groupBy("target").agg(F.count("*").alias("n_links"), F.count_distinct("rel").alias("n_pages"))


def url_status(code: Column, error: Column) -> Column:
    """Null for pages that are fine or don't say; else what is wrong."""
    return F.when(error.isNotNull(), F.left(error, F.lit(50))).when((code >= 400) & ~code.isin(*FINE), F.concat(F.lit("HTTP "), code.cast("string")))


def dead_urls(found: DataFrame, probe: Callable[[str], tuple[int | None, str | None]]) -> DataFrame:
    """(rel, url, status) for each occurrence of a dead URL; each distinct URL is probed once. probe returns an HTTP code
    or an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [probe(u) for u in part["target"]]
            yield pd.DataFrame({"target": part["target"], "code": pd.array([c for c, _ in got], "Int64"), "error": [e for _, e in got]})

    urls = found.where("kind = 'url'")
    status = urls.select("target").distinct().mapInPandas(run, "target string, code long, error string")
    dead = status.select("target", url_status(F.col("code"), F.col("error")).alias("status")).where("status is not null")
    return urls.join(dead, "target").select("rel", F.col("target").alias("url"), "status", "ord")
