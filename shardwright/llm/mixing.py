"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash. A document's virtual finish time is the tokens of its source up to and with it,
divided by the source's target; a source may be read several times over, up to MAX_REPEATS, and its clock runs on. The
queue is range-sorted by finish time over all sources, the words that it sends are summed up along that order, and the
mix ends where the sum reaches the budget. Targets share the budget by weight, a source that would have to be read more
than MAX_REPEATS times stops there, and the rest is shared anew (the water level in closed form), so that targets add up
to the budget and the queue is spent at virtual time 1: of the documents then under way, one a source, it has sent the
words up to the target.

No running sum meets in one task. Over a source it goes by buckets of the hash (BUCKETS, and more as the table grows,
so that one holds BUCKET_ROWS rows at most on average), along the sorted queue by its range partitions; the sums of
either are a small table. Rows get their numbers by being written; texts don't take part until the mix is known.

Defined cases: null text has size 0; sources go by code point, null last, a source of its own; documents of one hash go
by id, then size; repeated rows are rows of their own; if all sizes are 0, targets and takings are 0; an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.shared import WHITE, n_words, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
BUCKETS = 4096
BUCKET_ROWS = 50_000


def weights_by_rank(weights: tuple[int, ...] = WEIGHTS) -> Column:
    """Weights that repeat over the sources in order; column `rank` counts them from 1."""
    return F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))


def source_targets(sizes: DataFrame, weight: Column | None = None, repeats: int = MAX_REPEATS) -> DataFrame:
    """(no_source, source_key, source_size, weight, target) from rows (no_source, source_key, size). The windows run over
    one row per source."""
    src = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source_key")))
    src = src.withColumn("weight", (weights_by_rank() if weight is None else weight).cast("double")).withColumn("most", (F.col("source_size") * repeats).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    src = src.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    src = src.withColumn("full", F.col("most") <= F.col("weight") * F.col("level")).withColumn("place", F.row_number().over(order))
    level = F.min_by("level", F.when(~F.col("full"), F.col("place"))).over(every)
    return src.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)).select("no_source", "source_key", "source_size", "weight", "target")


def numbered(docs: DataFrame, text: str, source: str, doc_id: str, *more: Column) -> DataFrame:
    """(uid, doc_id, source, size) and more, written, which fixes the numbers."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *more), "mix-rows")


def queued(rows: DataFrame, weight: Column | None = None, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The queue: (uid, doc_id, size, source_size, target, round, finish, taken), a row for each time that a document
    starts before the end, and one of round 0 for every other. rows: (uid, doc_id, source, size), a written table."""
    buckets = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.shiftright(F.conv(F.left("draw", F.lit(8)), 16, 10).cast("long") * buckets, 32)  # rises with the draw
    keys = ["no_source", "source_key"]
    df = rows.select("uid", "doc_id", "size", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), draw.alias("draw")).withColumn("bucket", place)
    sums = written(df.groupBy(*keys, "bucket").agg(F.sum("size").alias("n")), "bucket-sizes")
    in_order = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("n").over(in_order), F.lit(0))).select(*keys, "bucket", "earlier")
    targets = source_targets(sums.select(*keys, F.col("n").alias("size")), weight, repeats).drop("weight")
    within = Window.partitionBy(*keys, "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(earlier.join(targets, keys), [*keys, "bucket"]).withColumn("begin", F.col("earlier") + F.col("inside")).drop("bucket", "earlier", "inside")
    # virtual times: all sources have words left at time 1, so what starts later can't come before the end
    end = F.round("target").cast("long")
    starts = lambda i: F.col("begin") + i * F.col("source_size")
    df = df.withColumn("round", F.explode(F.filter(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda i: (i == 0) | (starts(i) < end))))
    df = df.withColumn("finish", F.coalesce(F.try_divide(starts(F.col("round")) + F.col("size"), F.col("target")), F.lit(0.0)))
    df = df.withColumn("sent", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), end - starts(F.col("round")))))
    order = ["finish", *keys, "round", "draw", "doc_id", "size"]
    df = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-queue")
    parts = written(df.groupBy("part").agg(F.sum("sent").alias("n")), "mix-parts")  # a row for each range partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("part", "ahead")
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.coalesce(F.sum("sent").over(along), F.lit(0))).join(parts, "part")
    budget = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("sent"), F.lit(budget).cast("long") - F.col("ahead") - F.col("before")))
    return df.select("uid", "doc_id", "size", "source_size", "target", "round", "finish", taken.alias("taken"))


def fair_queue(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weight: Column | None = None, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words that the mix takes of it,
    all rounds together)."""
    queue = queued(numbered(docs, text, source, doc_id), weight, repeats, seed)
    return queue.groupBy("uid", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).drop("uid")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weight: Column | None = None, repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of docs, round, taken and finish
    (virtual time; a column of docs that has one of these names stays and hides it), sorted by finish over all
    partitions. Of the document under way at the cut the first words stay."""
    own = docs.columns
    rows = numbered(docs, text, source, doc_id, F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"))
    queue = queued(rows.select("uid", "doc_id", "source", "size"), weight, repeats, seed).where("taken > 0").select("uid", "size", "round", "taken", "finish")
    df = queue.join(rows.select("uid", "doc"), "uid").repartitionByRange("finish").sortWithinPartitions("finish")
    t = F.col(f"doc.`{text}`")
    lead = F.when(t.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    rest = F.when(F.col("taken") < F.col("size"), F.element_at(F.split(t, WHITE, (F.col("taken") + 1 + lead).cast("int")), -1))
    cut = lambda x: F.regexp_replace(F.left(t, F.length(t) - F.length(x)), "[\\x20\\x09-\\x0D]+\\z", "")
    df = df.withColumn("rest", rest).withColumn("cut", F.when(F.col("rest").isNull(), t).otherwise(cut(F.col("rest"))))
    columns = [F.col("cut").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in own]
    return df.select(*columns, *(c for c in ("round", "taken", "finish") if c not in own))
