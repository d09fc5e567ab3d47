"""Full-text search over pages: an inverted index as a table, ranked retrieval by BM25, links as votes.

The index has a row for each term of each page, so a common term is many rows, never one long list. A search takes the
rows of its queries' terms and deals them out by page once; the queries go to them. All that a query gains from a page is
then added up where the page is, and the best k of each task are kept before the last shuffle: what queries and pages have
in common, which grows with the product of both, is on no disk.

Defined cases: a null text is a page without terms; terms are runs of letters and digits, in lower case; a term that a
query holds twice counts twice; queries without a known term find nothing; ties go to the smaller id."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.scratch import forget, written

TERM = r"[\p{L}\p{N}]+"
#: Saturation of repeated terms, and how much a page's length counts.
K1, B = 1.2, 0.75
#: Terms of queries that go to all executors at a time, and rows that a task adds up on average.
BROADCAST, ADDED = 1 << 19, 1 << 22


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(pages: DataFrame, id_col: str = "rel", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(term, page, tf, length): how often a page holds a term, and the number of its terms. only: (term), the terms that
    are asked for, where not all are."""
    df = pages.select(F.col(id_col).alias("page"), terms(F.col(text_col)).alias("t"))
    df = df.select("page", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    if only is not None:
        df = df.join(only, "term", "left_semi")
    return df.groupBy("term", "page", "length").agg(F.count("*").alias("tf")).select("term", "page", "tf", "length")


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The index by term: files of a range of terms each, sorted, so that a lookup reads the files that may hold them."""
    index.repartitionByRange(buckets, "term").sortWithinPartitions("term", "page").write.mode("overwrite").parquet(path)


def size_of(pages: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """Number of pages and their mean number of terms."""
    row = pages.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.col(text_col)))).alias("mean")).first()
    return row["n"], row["mean"] or 0.0


def _asked(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, times)."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.explode(terms(F.col(text_col))).alias("term"))
    return asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def ranked(index: DataFrame, queries: DataFrame, n_pages: int, mean: float, k: int = 10, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, rank, page, score): the k best pages of each query. queries: (query_id, query).

    Queries beyond BROADCAST terms go round by round, each over the same rows of the index."""
    asked = _asked(queries, id_col, text_col)
    known = index.join(asked.select("term").distinct(), "term", "left_semi")
    in_pages = known.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (n_pages - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("times")
    asked = written(asked.join(in_pages, "term").select("query_id", "term", weight.alias("weight"), "df"), "asked")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("added")).first()
    rounds, tasks = max(-(-size["n"] // BROADCAST), 1), max(-(-size["added"] // ADDED), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_page = known.select("term", "page", "tf", "length").repartition(tasks, "page")
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page"))

    def found(n: int) -> DataFrame:
        some = asked.select("query_id", "term", "weight").where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == n)
        sums = by_page.join(F.broadcast(some), "term").groupBy("query_id", "page").agg(F.round(F.sum(part), 6).alias("score"))
        return sums.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "page", "score")

    return functools.reduce(DataFrame.unionByName, map(found, range(rounds)))


def search(pages: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "rel", text_col: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """Index and search at once: of the index, the rows of the queries' terms."""
    index = written(postings(pages, id_col, text_col, _asked(queries, query_id, query).select("term").distinct()), "postings")
    n, mean = size_of(pages, text_col)
    return ranked(index, queries, n, mean, k, query_id, query)


def link_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) of nodes (node) by edges (src, dst) among them: what a walk along links, with a jump to anywhere now
    and then, comes to. Ranks add up to 1; what nodes without links hold is shared out among all. Repeated edges and
    loops count once; ends that are no node are ignored; no nodes, no rows.

    A round is an equi-join from the links' side, which adaptive execution splits at hubs, and a sum by node with
    partial aggregates. It is written, so the plan doesn't grow with rounds."""
    nodes = nodes.select("node").where("node is not null").distinct()
    own = nodes.select(F.col("node").alias("src"))
    links = edges.select("src", "dst").distinct().join(own, "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    links = written(links, "links")
    degree = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    state = written(nodes.join(degree, "node", "left").select("node", "degree", F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(rounds):
        loose = state.where("degree is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = links.join(state.select(F.col("node").alias("src"), (F.col("rank") / F.col("degree")).alias("share")), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("got"))
        rank = F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))
        old, state = state, written(state.select("node", "degree").join(got, "node", "left").select("node", "degree", rank.alias("rank")), "ranks")
        forget(old)
    return state.select("node", "rank")
