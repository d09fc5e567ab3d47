"""Users' rules, sketches by day and the state of a growing vault against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardwright.operators import rules, sketches
from shardwright.streaming import vault_state

RULE = "label string, pattern string, word string"


def test_rules_with_and_without_words(spark):
    docs = [(1, "one TODO here\r\ntodo: two\n", "x"), (2, None, "x"), (3, "", None), (1, "todo_list 2024 and 2025", "x"), (4, "word " * 20_000 + "todo 1999", "y"), (5, "Ünder the Todo", "z")]
    table = [("todo", "(?i)todo", " TODO "), ("todo", "(?i)todo", "todo"), ("year", "[0-9]{4}", None), ("none", None, "todo"), (None, "x", None), ("under", "Ü", "ünder"), ("late", "2025$", ""), ("gone", "two$", "one")]
    got = rules.scan(spark.createDataFrame(docs, "doc_id int, text string, label string").drop("label"), spark.createDataFrame(table, RULE))
    want = Counter()
    for i, t, _ in docs:
        for n, line in enumerate((t or "").splitlines(), 1):
            words = set(re.findall(r"\w+", line.lower()))
            for label, pattern, word in {(a, b, (c or "").strip().lower()) for a, b, c in table if a and b}:
                if (not word or word in words) and (m := re.search(pattern, line)):
                    want[i, n, label, m[0]] += 1
    assert Counter(map(tuple, got.select("doc_id", "line_no", "label", "snippet").collect())) == want and len(want) > 7


def test_rules_that_are_too_many_or_none(spark):
    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id int, text string")
    many = spark.range(rules.PLAIN + 44).select(F.concat(F.lit("r"), "id").alias("label"), F.lit("alpha").alias("pattern"), F.lit(None).cast("string").alias("word"))
    with pytest.raises(ValueError, match="word"):
        rules.scan(docs, many)
    assert rules.scan(docs, many.withColumn("word", F.lit("alpha"))).count() == rules.PLAIN + 44
    assert rules.scan(docs, many.limit(0)).count() == 0
    assert rules.scan(docs.limit(0), many.limit(3)).count() == 0


def test_rules_of_a_word_on_most_lines(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the line "), F.col("id")).alias("text"))
    table = spark.createDataFrame([("a", "line [0-9]*7$", "the"), ("b", "^the", "line")], RULE)
    for small in (rules.SMALL, 0):
        assert dict(rules.scan(docs, table, small=small).groupBy("label").count().collect()) == {"a": 300, "b": 3000}


def test_functions_in_sql(spark):
    names = rules.register(spark)
    assert len(names) == 6
    row = spark.sql(r"SELECT sw_words('Ab c_d, É!') AS w, sw_words(NULL) AS no, sw_stem('a/b.c.md') AS s, sw_slug_ok('a-b1') AS yes, sw_slug_ok('a-\n') AS odd, sw_wikilinks('[[a]] [b] [[c|d]]') AS l, sw_day('2024-02-30') AS bad").first()
    assert tuple(row) == (["ab", "c_d", "é"], [], "b.c", True, False, ["a", "c|d"], None)
    texts = ["a\r\nb\x0bc\x1cd e\x85f", "", None, "x\n\n", "\n", "y" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {}
    for r in spark.sql("SELECT * FROM {docs}, LATERAL sw_lines(x)", docs=docs).orderBy("i", "line_no").collect():
        got.setdefault(r.i, []).append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t}


def test_sketches_merge_to_the_whole(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-{rng.randint(1, 9):02}" if rng.random() < 0.95 else None, rng.randint(0, 4000) if rng.random() < 0.9 else None, rng.choice("aaaaaaabbbcd") if rng.random() < 0.9 else None) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "d string, people int, items string")
    days = sketches.daily(df, F.col("d"), F.col("people"), F.col("items"))
    per_day = {r.day: r for r in sketches.people(days).collect()}
    for d in {x[0] for x in rows}:
        exact = len({p for x, p, _ in rows if x == d and p is not None})
        assert abs(per_day[d].n_people - exact) <= sketches.error() * exact + 1 and per_day[d].n_rows == sum(x[0] == d for x in rows)
    whole = sketches.spans(days)
    exact = len({p for _, p, _ in rows if p is not None})
    assert abs(sketches.people(whole).first().n_people - exact) <= sketches.error() * exact
    assert [tuple(r) for r in sketches.most_frequent(whole, 2).orderBy(F.desc("n")).collect()] == Counter(x for *_, x in rows if x).most_common(2)
    assert sketches.daily(df.limit(0), F.col("d"), F.col("people"), F.col("items")).count() == 0


def test_frequent_items_among_many(spark):
    """More distinct items than places: the frequent ones are told, within the stated error."""
    n = 200_000
    df = spark.range(n).select(F.lit("d").alias("d"), F.col("id").alias("p"), F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit("warm")).otherwise(F.concat(F.lit("x"), "id")).alias("item"))
    got = dict(sketches.most_frequent(sketches.spans(sketches.daily(df, F.col("d"), F.col("p"), F.col("item"))), 2).select("item", "n").collect())
    exact = {"hot": n // 4, "warm": n // 10}
    assert set(got) == set(exact) and all(abs(got[k] - v) <= 8 / 3 * n / sketches.TRACKED for k, v in exact.items())


def _plain(pages):
    """What stands among pages (rel: text)."""
    alive = {r: t for r, t in pages.items() if t is not None}
    stem = lambda r: re.sub(r"\.md$", "", r.split("/")[-1])
    names = Counter(map(stem, alive))
    broken = {("broken", x, r) for r, t in alive.items() for x in re.findall(r"\[\[(\w+)\]\]", t) if not names[x] and x != "tasks"}
    return broken | {("duplicate", stem(r), r) for r in alive if names[stem(r)] > 1}


def test_vault_that_grows_in_batches(spark, tmp_path):
    rng, shape, pages, places = random.Random(8), "rel string, text string, ord long, target string", {}, [f"{c}/{n}.md" for c in "abc" for n in "pqrstu"]
    run = lambda log, state, at: vault_state.follow(spark.readStream.schema(shape).parquet(str(at)), str(log), str(state), shards=3).awaitTermination()
    every = []
    for batch in range(4):
        rows = []
        for k in range(9):
            rel = rng.choice(places)
            text = None if rng.random() < 0.3 else "see " + " ".join(f"[[{rng.choice('pqrstuvwpqr')}]]" for _ in range(rng.randint(0, 4))) + " [[tasks]] `[[code]]`"
            rows.append((rel, text, batch * 100 + k, "x"))
            pages[rel] = text
        rows += rows[-1:] + [(None, "[[p]]", 0, "x")]
        every += rows
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(tmp_path / "log", tmp_path / "state", tmp_path / "in")
        log = spark.read.schema(vault_state.CHANGE).parquet(str(tmp_path / "log"))
        assert {tuple(r) for r in vault_state.standing(log).collect()} == _plain({r: (re.sub("`.*?`", "", t) if t else t) for r, t in pages.items()}), batch
    spark.createDataFrame(every, shape).coalesce(1).write.parquet(str(tmp_path / "once"))
    run(tmp_path / "log1", tmp_path / "state1", tmp_path / "once")
    once = vault_state.standing(spark.read.schema(vault_state.CHANGE).parquet(str(tmp_path / "log1")))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, vault_state.standing(log).collect()))
