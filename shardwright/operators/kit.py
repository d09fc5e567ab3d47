"""Versions and update plans."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shardwright.functions.text import version_key


def newest(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """The newest of the plain versions, compared number by number; empty if there is none."""
    df = tags.withColumn("k", version_key(F.col(tag)))
    return df.agg(F.coalesce(F.max_by(tag, F.when(F.col("k").isNotNull(), F.struct("k", tag))), F.lit("")).alias("newest"))


def update_plan(kit: DataFrame, local: DataFrame) -> DataFrame:
    """(name, action): NEW, UPD or same for each offered file; files that are local only are left alone."""
    a, b = kit.select("name", F.col("content").alias("a")), local.select("name", F.col("content").alias("b"), F.lit(True).alias("here"))
    action = F.when(F.col("here").isNull(), "NEW").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("UPD")
    return a.join(b, "name", "left").select("name", action.alias("action"))


def may_pin(applied: DataFrame, dry_run: bool = False) -> bool:
    """Whether the version may be pinned: everything offered is applied, and this is no dry run."""
    return not dry_run and bool(applied.agg(F.coalesce(F.bool_and("applied"), F.lit(True))).first()[0])


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Unified diff with three lines of context; empty for equal texts. There is no such built-in function."""
    return pd.Series(["" if a == b else "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "old", "new")) for a, b in zip(old, new)])
