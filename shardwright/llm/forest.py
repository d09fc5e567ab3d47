"""Approximate nearest neighbours: a forest of random-projection trees, searched through one queue that all trees share,
then exact reranking of the leaves' members.

A tree has a random direction for each level (all directions of the forest are orthogonal as far as dimensions go) and
for each node the median of what its part of a bounded sample projects to. Every distinct vector of the table is in one
leaf of each tree. A query takes leaves off a heap over all trees, nearest first: a leaf's key is the sum of squares of
the margins by which the query is on the other side, a lower bound of the squared distance where directions are
orthogonal. How many leaves it takes is calibrated: the least number at which the sample's own vectors find TARGET of
their neighbours in the sample; neighbours in the whole table are nearer, so recall there is no lower.

Equal vectors are one member with its k + 1 least ids, which is all that a list of k can show, so a vector that fills a
third of the table costs one row. Leaves are searched as blocks of members against blocks of queries, each of bounded
size; a block gives back its nearest k + 1 members a query, without those that lie beyond the query's (2k + 2)nd
neighbour in the sample (a bound that the k nearest found cannot pass, but for queries that would be left with too few:
these, and each query's own leaves, give back all).

Defined cases: vectors that are null, empty, all zero, hold a null or non-finite entry, or haven't the most common
length (ties: the shorter) take no part; rows with a null id don't either. Rows that repeat both id and vector count
once; rows with one id and several vectors are told apart by the vector, and are candidates for each other. Ties go to
the smaller id. Fewer candidates than k: all of them. No rows, no result."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.kernel import lean
from shardwright.llm.shared import written
from shardwright.llm.vectors import entry_type, matrix, packed, unpacked, usable

#: Bound of the sample that the trees are fitted on (rows), and of its members that calibrate the number of leaves.
SAMPLE, CALIBRATED = 8192, 512
TREES, DEPTH = 3, 6
#: Sample members that a leaf has at least.
LEAF = 64
#: Recall within the sample that the number of leaves is chosen for.
TARGET = 0.96
#: Bytes of vectors in a block.
BLOCK = 16 << 20
#: Pairs that are compared at a time.
PAIRS = 1 << 20


@dataclass
class Forest:
    directions: np.ndarray  # trees x depth x dimensions
    cuts: np.ndarray  # trees x 2^depth: the node's median at the node's place in heap order
    sample: np.ndarray
    visits: int

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    @property
    def leaves(self) -> int:
        return self.cuts.shape[1]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tld->ntl", x.astype(np.float64), self.directions, optimize=True)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through the forest."""
        p = self.projected(x)
        out = np.empty(p.shape[:2], np.int64)
        for t in range(p.shape[1]):
            node = np.ones(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (p[:, t, level] > self.cuts[t][node])
            out[:, t] = node - self.leaves + t * self.leaves
        return out

    def search(self, x: np.ndarray):
        """For each vector, its leaves in the order in which the shared heap gives them."""
        for margins in self.projected(x):
            heap = [(0.0, t, 1) for t in range(len(margins))]
            yield self._popped(heap, margins.tolist())

    def _popped(self, heap: list, margins: list):
        n, cuts = self.leaves, self.cuts
        while heap:
            far, t, node = heapq.heappop(heap)
            if node >= n:
                yield node - n + t * n
                continue
            m = margins[t][node.bit_length() - 1] - cuts[t][node]
            near = 2 * node + int(m > 0)
            heapq.heappush(heap, (far, t, near))
            heapq.heappush(heap, (far + m * m, t, near ^ 1))


def grown(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Trees whose nodes cut their part of the sample in halves. visits: all leaves as yet."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) / LEAF)))))
    normals: list[np.ndarray] = []
    while len(normals) < trees * depth:
        normals.extend(np.linalg.qr(rng.standard_normal((dim, dim)))[0].T)
    directions = np.array(normals[: trees * depth], np.float64).reshape(trees, depth, dim)
    cuts = np.zeros((trees, 1 << depth))
    x = sample.astype(np.float64)
    for t in range(trees):
        node = np.ones(len(x), np.int64)
        for level in range(depth):
            p = x @ directions[t, level]
            order = np.lexsort((p, node))
            starts = np.searchsorted(node[order], np.arange(1 << level, (2 << level) + 1))
            for k in range(1 << level):
                part = p[order[starts[k] : starts[k + 1]]]
                if len(part):
                    cuts[t, (1 << level) + k] = part[(len(part) - 1) // 2]
            node = 2 * node + (p > cuts[t][node])
    return Forest(directions, cuts, sample, trees << depth)


def calibrated(forest: Forest, k: int) -> int:
    """The least number of leaves at which members of the sample find TARGET of their k neighbours in it."""
    sample = forest.sample
    asked = sample[: min(CALIBRATED, len(sample))]
    most = len(forest.cuts) * forest.leaves
    if len(sample) <= k + 1:
        return most
    leaf, found_at = forest.leaf_of(sample), []
    for lo in range(0, len(asked), 64):
        part = asked[lo : lo + 64]
        d = distances(part, sample)
        d[np.arange(len(part)), lo + np.arange(len(part))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        for at, leaves in zip(near, forest.search(part), strict=True):
            place = np.zeros(most, np.int64)
            place[np.fromiter(leaves, np.int64)] = np.arange(most)
            found_at.append(place[leaf[at]].min(1))
    places = np.sort(np.concatenate(found_at))
    return int(places[int(np.ceil(TARGET * len(places))) - 1]) + 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product: near enough to choose by, not to return."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision from the original entries."""
    d = a.astype(np.float64) - b.astype(np.float64)
    return np.sqrt((d * d).sum(1))


def members(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 least ids (in order). The limit is applied before the shuffle too."""
    key = [F.xxhash64("v").alias("mark"), "v"]
    one = Window.partitionBy("mark", "v").orderBy("id")
    least = rows.select("id", *key).distinct().withColumn("place", F.row_number().over(one)).where(F.col("place") <= k + 1)
    return least.groupBy("mark", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _blocks(counts: np.ndarray, per: int) -> np.ndarray:
    return np.maximum(1, -(-counts // per)).astype(np.int64)


def _count(df: DataFrame, column: Column, size: int) -> np.ndarray:
    """Rows by number of leaf: an aggregate of as many rows as the forest has leaves."""
    out = np.zeros(size, np.int64)
    for row in df.groupBy(column.alias("g")).count().collect():
        out[row["g"]] = row["count"]
    return out


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for the usable rows of df for which queries holds: their k nearest other
    rows, by Euclidean distance."""
    spark, kind = df.sparkSession, entry_type(df, vec_col)
    shape = "query_id long, rank int, vec_id long, score double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")).where("id is not null")
    rows, dim = usable(rows, "v", zero=False)
    if not dim:
        return spark.createDataFrame([], shape)

    table = written(members(rows.select("id", "v"), k), "members")
    n = table.count()
    rate = min(1.0, SAMPLE / n)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "mark"), F.lit(1 << 30)) < int(rate * (1 << 30))
    sample = [r["v"] for r in table.where(drawn).orderBy("mark", "v").limit(2 * SAMPLE).select("v").collect()]
    if not sample:
        sample = [table.first()["v"]]
    forest = grown(np.array(sample, kind), TREES, DEPTH, seed)
    forest.visits = calibrated(forest, k)
    width = len(forest.cuts) * forest.leaves
    shared = spark.sparkContext.broadcast(forest)

    def leaves(batches):
        for batch in batches:
            of = shared.value.leaf_of(matrix(batch.column(0), dim))
            g, c = np.unique(of, return_counts=True)
            yield pa.record_batch({"g": g.astype(np.int32), "c": c})

    per_leaf = np.zeros(width, np.int64)
    for row in table.select("v").mapInArrow(lean(leaves), "g int, c long").groupBy("g").agg(F.sum("c").alias("c")).collect():
        per_leaf[row["g"]] = row["c"]

    def visited(batches):
        f = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = matrix(part.column("v"), dim)
                d = distances(x, f.sample)
                at = 2 * k + 1
                bound = np.sqrt(np.partition(d, at, axis=1)[:, at]) * (1 + 1e-9) + 1e-9 if d.shape[1] > at else np.full(len(x), np.inf)
                own, out = f.leaf_of(x), []
                bound = np.where(per_leaf[own].max(1) > k, bound, np.inf)
                for order in f.search(x):
                    taken, held = [], np.zeros(len(f.cuts), np.int64)
                    for g in order:
                        if len(taken) >= f.visits and held.max() > k:
                            break
                        taken.append(g)
                        held[g // f.leaves] += per_leaf[g]
                    out.append(taken)
                yield pa.record_batch({
                    "id": part.column("id"), "mark": part.column("mark"), "x": packed(x.astype(kind, copy=False)), "bound": pa.array(bound),
                    "own": pa.array(own.tolist(), pa.list_(pa.int32())), "taken": pa.array(out, pa.list_(pa.int32())),
                })

    asked = rows.where("asked").select("id", "v").distinct().select("id", F.xxhash64("v").alias("mark"), "v")
    asked = written(asked.mapInArrow(lean(visited), "id long, mark long, x binary, bound double, own array<int>, taken array<int>"), "asked")
    per_query = _count(asked.select(F.explode("taken").alias("g")), F.col("g"), width)

    per = max(1, BLOCK // (dim * kind.itemsize))
    member_blocks, query_blocks = _blocks(per_leaf, per), _blocks(per_query, per)

    def dealt(batches):
        """Members: a row for each of their leaves that a query visits and each block of the leaf's queries."""
        for batch in batches:
            x = matrix(batch.column("v"), dim).astype(kind, copy=False)
            g = shared.value.leaf_of(x)
            row = np.repeat(np.arange(len(x)), g.shape[1])
            g = g.ravel()
            row, g = row[per_query[g] > 0], g[per_query[g] > 0]
            mb = (batch.column("mark").to_numpy().view(np.uint64)[row] >> np.uint64(11)) % member_blocks[g].astype(np.uint64)
            times = query_blocks[g]
            qb = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, g, mb = np.repeat(row, times), np.repeat(g, times), np.repeat(mb, times)
            for lo in range(0, len(row), 8192):
                s = slice(lo, lo + 8192)
                took = batch.take(pa.array(row[s]))
                yield pa.record_batch({"g": g[s].astype(np.int32), "mb": mb[s].astype(np.int32), "qb": qb[s].astype(np.int32), "ids": took.column("ids"), "mark": took.column("mark"), "x": packed(x[row[s]])})

    held = table.select("v", "mark", "ids").mapInArrow(lean(dealt), "g int, mb int, qb int, ids array<long>, mark long, x binary")
    visits = asked.select("id", "mark", "x", F.col("bound"), "own", F.explode("taken").alias("g"))
    visits = visits.select(
        "g", F.explode(F.sequence(F.lit(0), _at(member_blocks, "g") - 1)).alias("mb"),
        F.pmod(F.xxhash64("id", "mark"), _at(query_blocks, "g")).cast("int").alias("qb"), "id", "mark", "x",
        F.when(F.array_contains("own", F.col("g")), F.lit(float("inf"))).otherwise(F.col("bound")).alias("bound"),
    )

    def compared(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The nearest k + 1 members of the block for each query of the block."""
        found = {"q": [], "m": [], "d": []}
        if mine.num_rows and theirs.num_rows:
            x, y = unpacked(mine.column("x"), dim, kind), unpacked(theirs.column("x"), dim, kind)
            bound = mine.column("bound").to_numpy()
            ids = theirs.column("ids").combine_chunks()
            least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
            step = max(1, PAIRS // len(y))
            for lo in range(0, len(x), step):
                part = x[lo : lo + step]
                d = distances(part, y)
                top = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k + 1 else np.full(len(part), np.inf)
                # what rounding may have moved across the limit is looked at exactly
                q, m = np.nonzero(d <= np.minimum(top, bound[lo : lo + step] ** 2)[:, None] * (1 + 1e-9) + 1e-9)
                e = exact(part[q], y[m])
                order = np.lexsort((least[m], e, q))
                q, m, e = q[order], m[order], e[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                keep = place <= k
                found["q"].append(q[keep] + lo)
                found["m"].append(m[keep])
                found["d"].append(e[keep])
        q, m, d = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((found["q"], np.int64), (found["m"], np.int64), (found["d"], np.float64)))
        q, m = pa.array(q.astype(np.int64)), pa.array(m.astype(np.int64))
        return pa.table({"query_id": mine.column("id").take(q), "query_mark": mine.column("mark").take(q), "mark": theirs.column("mark").take(m), "ids": theirs.column("ids").take(m), "score": pa.array(d)})

    pairs = visits.groupBy("g", "mb", "qb").cogroup(held.groupBy("g", "mb", "qb")).applyInArrow(compared, "query_id long, query_mark long, mark long, ids array<long>, score double")
    # a member comes once for each tree that leads to it, always with the same distance
    query = ["query_id", "query_mark"]
    once = pairs.groupBy(*query, "mark", F.col("ids")[0].alias("least")).agg(F.first("ids").alias("ids"), F.min("score").alias("score"))
    near = once.withColumn("place", F.row_number().over(Window.partitionBy(*query).orderBy("score", "least", "mark"))).where(F.col("place") <= k + 1)
    each = near.select(*query, "mark", F.explode("ids").alias("vec_id"), "score").where("not (vec_id = query_id and mark = query_mark)")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("score", "vec_id", "mark"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _at(values: np.ndarray, column: str) -> Column:
    """values at the place that a column names; a literal as long as the forest has leaves, one number if all are equal."""
    if (values == values[0]).all():
        return F.lit(int(values[0])).cast("int")
    return F.get(F.array(*(F.lit(int(v)).cast("int") for v in values)), F.col(column))
