"""Nearest neighbours and whitening against brute force in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shardwright.llm import forest, vectors, whitening

SHAPE = "vec_id long, embedding array<float>, label string, v string, id string, g int, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", 1, None) for i, v in rows], SHAPE)


def listed(rows):
    """Distinct rows by id and vector, of the usual length."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return sorted(fine)


def brute_nearest(rows, k=10):
    every = listed(rows)
    x = np.array([v for _, v in every], np.float64)
    out = {}
    for at, (i, v) in enumerate(every):
        if i % 100 == 0:
            d = np.sqrt(((x - x[at]) ** 2).sum(1))
            near = sorted((d[j], every[j][0], j) for j in range(len(every)) if j != at)[:k]
            out[i, v] = [(j, float(s)) for s, j, _ in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    pairs = [(q, i) for (q, _), near in want.items() for i, _ in near]
    return sum(i in {j for j, _ in got[q]} for q, i in pairs) / len(pairs)


def test_neighbours_of_a_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_nearest(rows)
    df = __spark_entry__.queries()["op11_nearest_neighbours"](spark, sf_dir)
    assert [f.simpleString() for f in df.schema.fields] == ["query_id:bigint", "rank:int", "vec_id:bigint", "score:double"]
    got = found(df)
    assert set(got) == {q for q, _ in want} and recall(got, want) >= 0.9
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and len({i for i, _ in near}) == 10
        assert near == sorted(near, key=lambda x: (x[1], x[0]))
        for i, score in near:
            assert score == pytest.approx(float(np.sqrt(((exact[q] - exact[i]) ** 2).sum())), rel=1e-14)


def test_recall_beyond_the_sample(spark, monkeypatch):
    """The trees are fitted on a fifteenth of the rows, all rows are indexed: isotropic vectors are the hardest ones."""
    monkeypatch.setattr(forest, "SAMPLE", 400)
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(6000)]
    got = found(forest.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert recall(got, brute_nearest(rows)) >= 0.9


def test_blocks_of_hot_leaves(spark, monkeypatch):
    """A third of the rows is one vector, another third lies close to it; leaves are dealt out in blocks of few rows."""
    monkeypatch.setattr(forest, "BLOCK", 64 * 8 * 4)
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(8).astype(np.float32)
    rows = [(i, hot.tolist()) for i in range(0, 3000, 3)]
    rows += [(i, (hot + rng.standard_normal(8) * 0.01).astype(np.float32).tolist()) for i in range(1, 3000, 3)]
    rows += [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(2, 3000, 3)]
    got, want = found(forest.nearest(frame(spark, rows), F.col("vec_id") % 100 == 0)), brute_nearest(rows)
    assert recall(got, want) >= 0.9
    for (q, v), near in want.items():  # all copies are at 0, the smallest ids first
        if np.array_equal(np.array(v, np.float32), hot):
            assert got[q] == near == [(i, 0.0) for i in [x for x in range(0, 40, 3) if x != q][:10]]


def test_odd_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (8, [1.0, 1.0]), (9, [-1.0, 0.0])]
    got = [tuple(r) for r in forest.nearest(frame(spark, odd + rows), F.col("vec_id") % 100 == 0).collect()]
    # 0; 100 at the same place; 100 elsewhere: each finds all the others, one row with one id twice stays one
    assert len(got) == 3 * 4
    of_zero = sorted((r, i, round(s, 6)) for q, r, i, s in got if q == 0)
    assert of_zero == [(1, 100, 0.0), (2, 8, 1.0), (3, 9, 2.0), (4, 100, round(5**0.5, 6))]
    assert forest.nearest(frame(spark, odd), F.col("vec_id") % 100 == 0).count() == 0
    assert forest.nearest(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert forest.nearest(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0


def test_doubles_stay_doubles(spark):
    near = 1 + 1e-12
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, near]), (2, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert found(forest.nearest(df, F.col("vec_id") == 0)) == {0: [(1, near - 1.0), (2, 2.0)]}


def test_the_heap_takes_the_nearest_leaf_first():
    rng = np.random.default_rng(1)
    f = forest.grown(rng.standard_normal((2000, 8)).astype(np.float32), 3, 4, seed=2)
    assert f.leaves == 16 and np.allclose(f.directions.reshape(-1, 8)[:8] @ f.directions.reshape(-1, 8)[:8].T, np.eye(8))
    x = rng.standard_normal((20, 8)).astype(np.float32)
    own = f.leaf_of(x)
    for at, order in enumerate(f.search(x)):
        order = list(order)
        assert sorted(order) == list(range(48)) and set(order[:3]) == set(own[at])
    counts = np.bincount(f.leaf_of(f.sample).ravel(), minlength=48)
    assert counts.min() >= 100 and counts.max() <= 150


def brute_white(rows, most=32):
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:most]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return dev, c @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def test_whitening_of_a_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    df = __spark_entry__.queries()["op12_embedding_whitening"](spark, sf_dir)
    assert [f.simpleString() for f in df.schema.fields][:6] == ["vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double"]
    got = df.orderBy("vec_id", "component").toPandas()
    dev, white, explained = brute_white(rows)
    assert len(got) == len(rows) * 32 and set(got["n"]) == {len(rows)}
    assert got["deviation"].tolist() == [d for d in dev for _ in range(32)]
    mine = got["whitened"].to_numpy().reshape(-1, 32)
    sign = np.sign((mine * white).sum(0))
    assert np.allclose(mine, white * sign, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] <= 1e-4


def test_whitening_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0, 0.0]), (3, [inf, 1.0, 0.0]), (4, [None, 1.0, 2.0]), (6, []), (7, [1.0, 2.0])]
    rows = [(0, [0.0, 0.0, 0.0]), (5, [1.0, 0.5, 0.0]), (8, [-1.0, 0.25, 0.0]), (8, [-1.0, 0.25, 0.0]), (None, [0.5, -2.0, 0.0])]
    got = whitening.whitened(frame(spark, odd + rows)).collect()
    assert len(got) == 5 * 3 and {r["n"] for r in got} == {5}
    assert {r["whitened"] for r in got if r["component"] == 3} == {0.0}  # no variance there
    assert all(r["identity_error"] < 1e-9 for r in got)
    alone = whitening.whitened(frame(spark, [(1, [2.0, 3.0])])).collect()
    assert [(r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in alone] == [(0.0, 0.0, 0, 0.0)] * 2
    assert whitening.whitened(frame(spark, odd[:5])).count() == 0
    assert whitening.whitened(frame(spark, [])).count() == 0


def test_deviation_beyond_64_bits(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(frame(spark, rows)).collect()}
    x = [[int(min(max(c, -(2.0**40)), 2.0**40) * 64) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for (i, _), v in zip(rows, x, strict=True)}


def test_usable_takes_the_most_common_length(spark):
    df = frame(spark, [(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0]), (4, [2.0, 2.0])])
    assert vectors.usable(df, "embedding", zero=True)[1] == 1
