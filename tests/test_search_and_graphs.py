"""Search, link ranks, commit graphs, suffix joins and running sums against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from shardwright.operators import commits, digest, search, staleness


def plain_bm25(pages, query, k):
    words = {p: re.findall(r"[^\W_]+", (t or "").lower()) for p, t in pages}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for p, ws in words.items():
        score, tf = 0.0, Counter(ws)
        for w, times in Counter(re.findall(r"[^\W_]+", query.lower())).items():
            if tf[w]:
                score += times * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        if any(tf[w] for w in re.findall(r"[^\W_]+", query.lower())):
            out.append((-round(score, 6), p))
    return [(p, -s) for s, p in sorted(out)[:k]]


def test_search_odd_pages(spark, tmp_path):
    pages = [("a", "Red red fish"), ("b", None), ("c", ""), ("d", "one FISH, two-fish: über"), ("e", "red fish"), ("f", "fish red"), ("g", "x" * 50_000 + " red")]
    queries = [(1, "red"), (2, "fish fish Über"), (3, None), (4, "unknown words"), (5, "RED fish one")]
    df = spark.createDataFrame([(p, t, "z", 9) for p, t in pages], "rel string, text string, term string, tf int")
    got = {}
    for r in search.search(df, spark.createDataFrame(queries, "query_id int, query string"), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["page"], r["score"]))
    assert got == {i: plain_bm25(pages, q, 3) for i, q in queries if q and plain_bm25(pages, q, 3)}
    index = search.postings(df)
    search.write_index(index, str(tmp_path / "index"), 3)
    again = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    assert search.search(df.limit(0), spark.createDataFrame(queries, "query_id int, query string")).count() == 0


def test_search_adds_up_where_pages_are(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST", 20, raising=False)
    monkeypatch.setattr(search, "ADDED", 500, raising=False)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    pages = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(80)]
    pages += [(100 + i, t) for i, t in pages]
    queries = [(i, " ".join(rng.choices([*words, "none"], k=rng.randrange(9)))) for i in range(25)]
    df, asked = spark.createDataFrame(pages, "rel int, text string"), spark.createDataFrame(queries, "query_id int, query string")
    found = search.search(df, asked, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["page"], r["score"]))
    assert got == {i: best for i, q in queries if (best := plain_bm25(pages, q, 4))}
    # what queries and pages have in common is never shuffled, only rows of the index are, and the best of each task
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", found._jdf.queryExecution().executedPlan().toString())
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"term", "page", "query_id"}


def plain_rank(nodes, edges, rounds, d=0.85):
    nodes = sorted({x for x in nodes if x is not None})
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    out = Counter(a for a, _ in edges)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = {n: (1 - d) / len(nodes) + d * loose / len(nodes) for n in nodes}
        for a, b in edges:
            new[b] += d * rank[a] / out[a]
        rank = new
    return rank


def test_link_rank_with_a_hub(spark):
    rng = random.Random(4)
    nodes = [f"n{i}" for i in range(60)] + [None, "n1"]
    edges = [(f"n{i}", "n0") for i in range(1, 50)] + [("n0", f"n{i}") for i in range(20)] + [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [("n3", "gone"), (None, "n1"), ("n5", "n5")] * 2
    got = search.link_rank(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string"), 12)
    got, want = {r["node"]: r["rank"] for r in got.collect()}, plain_rank(nodes, edges, 12)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want) and abs(sum(got.values()) - 1) < 1e-9
    assert search.link_rank(spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def plain_reach(parents, tips):
    up = {}
    for sha, parent in parents:
        up.setdefault(sha, []).append(parent)
    seen, todo = set(), [x for x in tips if x]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [p for p in up.get(x, []) if p]
    return seen


def test_reached_over_random_histories(spark):
    rng = random.Random(2)
    for case in range(4):
        n = 120
        parents = [("c0", None)]
        for i in range(1, n):
            parents.append((f"c{i}", f"c{i - 1 if rng.random() < 0.8 else rng.randrange(i)}"))
            if rng.random() < 0.1:
                parents.append((f"c{i}", f"c{rng.randrange(i)}"))  # a merge, now and then of a commit with itself
        tips = [f"c{rng.randrange(n)}" for _ in range(3)] + [None]
        got = commits.reached(spark.createDataFrame(parents, "sha string, parent string"), spark.createDataFrame([(x,) for x in tips], "sha string"))
        assert sorted(r["sha"] for r in got.collect()) == sorted(plain_reach(parents, tips)), case


def test_long_history_in_few_rounds(spark):
    n = 3000
    parents = spark.range(n).select(F.concat(F.lit("c"), "id").alias("sha"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    refs = spark.createDataFrame([("c2999", "c100"), (commits.NONE, "c5"), (None, None)], "local string, remote string")
    known = spark.createDataFrame([("c2000",), ("not here",)], "sha string")
    got = {r["sha"] for r in commits.unpushed(parents, refs, known).collect()}
    assert got == {f"c{i}" for i in range(2001, 3000)}
    new = spark.createDataFrame([("c2", commits.NONE)], "local string, remote string")  # a new branch down to its root
    assert {r["sha"] for r in commits.unpushed(parents, new, known.limit(0)).collect()} == {"c0", "c1", "c2"}


def test_suffixes_of_paths(spark):
    paths = ["src/a.py", "lib/src/a.py", "za/foo.py", "index.ts", "top.py", "deep/er/top.py", "a/b/index.ts", None, "src/a.py"]
    cited = ["a.py", "src/a.py", "a/foo.py", "/foo.py", "/src/a.py", "xindex.ts", "dex.ts", "index.ts", "b/index.ts", "c/index.ts", "top.py", "/top.py", "er/top.py", "é.py", None, "a.py"]
    got = {r["cited"] for r in staleness.ending_with(spark.createDataFrame([(c,) for c in cited], "cited string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    want = {c for c in cited if c and any(p and p.endswith(c) and p.rpartition("/")[2] == c.rpartition("/")[2] for p in paths)}
    assert got == want and want >= {"a/foo.py", "/src/a.py"}


def test_suffixes_over_many_ranges(spark):
    """Half of all paths share their base name; no range gets more than its share."""
    paths = spark.range(4000).select(F.concat(F.lit("p"), F.col("id"), F.when(F.col("id") % 2 == 0, "/index.ts").otherwise(F.concat(F.lit("/f"), "id", F.lit(".ts")))).alias("path"))
    cited = spark.range(0, 8000, 7).select(F.concat(F.lit("p"), F.col("id"), F.lit("/index.ts")).alias("cited"))
    got = {r["cited"] for r in staleness.ending_with(cited, paths).collect()}
    assert got == {f"p{i}/index.ts" for i in range(0, 8000, 7) if any(str(j).endswith(str(i)) and f"p{j}/index.ts".endswith(f"p{i}/index.ts") for j in (i,)) and i % 2 == 0 and i < 4000}
    keys = paths.select(F.reverse("path").alias("key")).repartitionByRange(8, "key").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = sorted(r["count"] for r in keys)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_chunks_of_one_bucket_and_null_ones(spark):
    rng = random.Random(1)
    rows = [("big" if i % 10 else None, f"p{i:05d}", rng.randrange(2000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "bucket string, path string, n_bytes long, extra int").repartition(5)
    got = {r["path"]: (r["bucket"], r["chunk"], r["extra"]) for r in digest.chunks(df, limit=50_000).collect()}
    sums, want = Counter(), {}
    for b, p, n, e in sorted(rows, key=lambda r: r[1]):
        want[p] = (b, sums[b] // 50_000, e)
        sums[b] += n
    assert got == want
    assert digest.chunks(df.limit(0)).count() == 0
