"""The commit graph: which commits a push brings that no remote has, merges included.

Most of a history is runs of commits with one parent and one child. They are contracted by pointer jumping (rounds go by
the logarithm of the longest run), reachability goes over the runs that are left (rounds go by the number of forks and
merges in a row), and its answer is carried back to the commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.scratch import forget, written

NONE = "0" * 40


def runs(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(sha, head): the commit at which each commit's run begins, on the side of the children. A run ends above a tip, a
    merge, a fork, a commit without children. parents: (sha, parent), a row for each parent."""
    edges = parents.where("parent is not null")
    every = parents.select("sha").union(edges.select("parent")).union(tips.select("sha")).distinct()
    n_parents = edges.groupBy("sha").agg(F.count("*").alias("n_parents"))
    # the only child of a commit, if that child has no other parent
    child = edges.join(n_parents, "sha").groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n"), F.min("sha").alias("child"), F.max("n_parents").alias("most"))
    child = child.where("n = 1 and most = 1").select("at", "child").join(tips.select(F.col("sha").alias("at")), "at", "left_anti")
    state = written(every.join(child, every["sha"] == child["at"], "left").select("sha", F.coalesce("child", "sha").alias("head")), "runs")
    while True:
        up = state.select(F.col("sha").alias("head"), F.col("head").alias("next"))
        old, state = state, written(state.join(up, "head").select("sha", F.col("next").alias("head"), (F.col("next") != F.col("head")).alias("moved")), "runs")
        forget(old)
        if state.where("moved").isEmpty():
            return state.select("sha", "head")


def reached(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(sha) of tips (sha) and all their ancestors."""
    tips = tips.select("sha").where("sha is not null").distinct()
    edges = parents.where("parent is not null").select("sha", "parent").distinct()
    of = written(runs(edges, tips), "heads")
    # edges between runs: from any commit of one to the head of another
    above = of.select(F.col("sha").alias("parent"), F.col("head").alias("below"))
    steps = edges.join(of, "sha").join(above, "parent").where("head <> below").select("head", "below").distinct()
    steps = written(steps, "steps")
    seen = new = written(tips.join(of, "sha").select("head").distinct(), "seen")
    while True:
        found = steps.join(new, "head").select(F.col("below").alias("head")).distinct().join(seen, "head", "left_anti")
        new = written(found, "new")
        if new.isEmpty():
            return of.join(seen, "head", "left_semi").select("sha")
        seen = written(seen.select("head").unionByName(new), "seen")


def unpushed(parents: DataFrame, refs: DataFrame, known: DataFrame) -> DataFrame:
    """(sha) of the commits that refs (local, remote) bring: those reached from a local tip and from no commit that a
    remote has. known: (sha) of the remotes' tips; a ref's own remote tip counts as known; all zeros or null stand for a
    ref that is deleted (local) or new (remote). One run for all refs; a root commit is an ordinary one."""
    real = lambda c: F.col(c).isNotNull() & (F.replace(c, F.lit("0"), F.lit("")) != "")
    local = refs.where(real("local")).select(F.col("local").alias("sha"))
    theirs = refs.where(real("remote")).select(F.col("remote").alias("sha")).union(known.select("sha")).distinct()
    there = parents.select("sha").union(parents.where("parent is not null").select("parent")).distinct()
    theirs = theirs.join(there, "sha", "left_semi")  # a remote may be ahead of what is here
    return reached(parents, local).join(reached(parents, theirs), "sha", "left_anti")
