"""Names and links of a growing vault as streaming state: broken links and duplicate names come and go as pages arrive.

Two keyed steps. By page: a page that arrives again is held against the links it had, so that only differences go on. By
name: who is called so and who links there. A name's links are dealt to SHARDS keys by the linking page, and the
definitions, of which a page has one, go to all of them, so that a name that most pages link to or bear is not one task's
work. A key's pages are a map in the state store, one entry each, read in turn and only when the name appears, disappears
or becomes one of several; no list of them is made.

The result is a log of changes (issue, target, rel, delta): an issue stands while its deltas add up to 1. Sums don't
depend on the order in which rows of a batch are handled.

Defined cases: a null text is a page that was removed; of versions in one batch that of the largest number counts, a later
batch comes after an earlier one; a page may link to a name several times, which counts once; names
of generated pages always resolve; pages without name or rel are left out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from shardwright.functions.text import basename, strip_code
from shardwright.operators.links import GENERATED, WIKI, wiki_target

SHARDS = 8
_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "issue string, target string, rel string, delta int"


class _Page(StatefulProcessor):
    """By page: what it links to now and what it linked to, as (target, kind, rel, delta)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "alive boolean, targets array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (rel,) = key
        last = max(rows, key=lambda r: (r.ord, r.text_hash))  # of one page, in one batch
        old = self.known.get() if self.known.exists() else (False, [])
        alive, targets = last.alive, sorted(set(last.targets or []))
        self.known.update((alive, targets))
        if alive != old[0]:
            yield Row(target=last.stem, kind="name", rel=rel, delta=1 if alive else -1)
        for x in sorted(set(targets) ^ set(old[1])):
            yield Row(target=x, kind="link", rel=rel, delta=1 if x in targets else -1)

    def close(self) -> None:
        pass


class _Name(StatefulProcessor):
    """By name and shard: the changes that a definition or a link brings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")
        self.bearers = handle.getMapState("bearers", "rel string", "one int")
        self.linkers = handle.getMapState("linkers", "rel string", "one int")

    def _all(self, issue: str, target: str, pages, delta: int) -> Iterator[Row]:
        for (rel,) in pages.keys():
            yield Row(issue=issue, target=target, rel=rel, delta=delta)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        target = key[0]
        before = n = self.n.get()[0] if self.n.exists() else 0
        for r in rows:
            if r.kind == "link":
                pages, issue, change = self.linkers, "broken", n == 0
            else:
                pages, issue, was, n = self.bearers, "duplicate", n, n + r.delta
                if was == 0 or n == 0:
                    yield from self._all("broken", target, self.linkers, -r.delta)
                if {was, n} == {1, 2}:  # those that were there before or stay tell of it too
                    yield from self._all("duplicate", target, self.bearers, r.delta)
                change = was > 0 if r.delta > 0 else was > 2
                if not r.own:
                    continue
            if r.delta > 0:
                pages.updateValue((r.rel,), (1,))
            else:
                pages.removeKey((r.rel,))
            if change:
                yield Row(issue=issue, target=target, rel=r.rel, delta=r.delta)
        if n != before:
            self.n.update((n,))

    def close(self) -> None:
        pass


def changes(pages: DataFrame, ord_col: str = "ord", shards: int = SHARDS) -> DataFrame:
    """The log of changes of a stream of pages (rel, text, and a number that tells which of two versions is later). Both
    steps keep their state in RocksDB: the session's state store provider must be PROVIDER."""
    stem = F.regexp_replace(basename(F.col("rel")), r"\.md\z", "")
    text = strip_code(F.coalesce("text", F.lit("")))
    targets = F.transform(F.regexp_extract_all(text, F.lit(WIKI), F.lit(1)), wiki_target)
    df = pages.select("rel", stem.alias("stem"), F.col(ord_col).cast("long").alias("ord"), F.xxhash64("text").alias("text_hash"), F.col("text").isNotNull().alias("alive"),
        F.array_except(F.filter(targets, lambda x: x != ""), F.array(*map(F.lit, GENERATED))).alias("targets")).where("rel is not null and stem <> ''")
    moved = df.groupBy("rel").transformWithState(_Page(), "target string, kind string, rel string, delta int", "Append", "None")
    own = F.pmod(F.xxhash64("rel"), F.lit(shards)).cast("int")
    to = F.when(F.col("kind") == "name", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(own))
    dealt = moved.select("target", "kind", "rel", "delta", own.alias("mine"), F.explode(to).alias("shard")).withColumn("own", F.col("mine") == F.col("shard")).drop("mine")
    return dealt.groupBy("target", "shard").transformWithState(_Name(), CHANGE, "Append", "None")


def follow(pages: DataFrame, out: str, checkpoint: str, shards: int = SHARDS) -> StreamingQuery:
    """Appends the changes of what hasn't been seen yet to the log `out`, as Parquet. Runs of one checkpoint must keep the
    number of shards."""
    spark = pages.sparkSession
    before = spark.conf.get(_CONF)
    spark.conf.set(_CONF, PROVIDER)
    try:
        log = changes(pages, shards=shards)
        return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_CONF, before)


def standing(log: DataFrame) -> DataFrame:
    """(issue, target, rel) of what stands after all changes of a log."""
    return log.groupBy("issue", "target", "rel").agg(F.sum("delta").alias("_n")).where("_n > 0").drop("_n")
