"""Sketches by day that merge later: who was there, and what came most often, without the rows.

A day's sketch is made once, from that day's rows, with partial aggregates: a task sends a few kilobytes a day, however
many rows or hot keys it has. Any span of days is a merge of their sketches; no row is read again.

People are counted by HyperLogLog with 2^LOG_SIZE places, whose relative standard error is 1.04 / sqrt(2^LOG_SIZE). The
most frequent items are kept in tables of TRACKED places: counts are exact while a span has no more distinct items, else
a count is off by at most 8/3 of the span's rows over TRACKED, and an item that isn't reported comes at most that often.

Defined cases: null people and null items aren't counted; a null day is a day; a day without people counts 0; an empty
table has no sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SIZE, TRACKED = 12, 10_000


def error(sigmas: float = 3.0, log_size: int = LOG_SIZE) -> float:
    """The relative error of a count of people, at so many standard errors."""
    return sigmas * 1.04 / math.sqrt(1 << log_size)


def daily(rows: DataFrame, day: Column, person: Column, item: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, day, people, items, n_rows): a row of sketches for each day, to be written and kept."""
    df = rows.select(*by, day.alias("day"), person.alias("_person"), item.cast("string").alias("_item"))
    top = F.expr(f"approx_top_k_accumulate(_item, {TRACKED})")
    return df.groupBy(*by, "day").agg(F.hll_sketch_agg("_person", F.lit(LOG_SIZE)).alias("people"), top.alias("items"), F.count("*").alias("n_rows"))


def spans(days: DataFrame, *by: Column | str) -> DataFrame:
    """The same of longer spans, or of all days where `by` is empty."""
    merged = F.hll_union_agg("people").alias("people"), F.expr(f"approx_top_k_combine(items, {TRACKED})").alias("items"), F.sum("n_rows").alias("n_rows")
    return days.groupBy(*by).agg(*merged)


def people(days: DataFrame) -> DataFrame:
    """The sketches' columns as numbers: n_people, an estimate, and n_rows, exact."""
    return days.withColumn("n_people", F.hll_sketch_estimate("people")).drop("people", "items")


def most_frequent(days: DataFrame, k: int = 30) -> DataFrame:
    """(the other columns, item, n): the k most frequent items of each sketch, as rows."""
    keep = [c for c in days.columns if c not in ("people", "items", "n_rows")]
    df = days.select(*keep, F.explode(F.expr(f"approx_top_k_estimate(items, {int(k)})")).alias("_x"))
    return df.select(*keep, F.col("_x.item").alias("item"), F.col("_x.count").alias("n"))
