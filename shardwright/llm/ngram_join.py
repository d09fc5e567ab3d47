"""N-gram Jaccard self-join by MinHash banding.

Every text becomes the set of its five-word shingles (words: `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). Texts of the
same words are one class, whose size is counted and whose copies are never paired. Class signatures are cut into bands
whose number follows from the target recall; rows are shuffled on band hashes. A bucket with the same members as another
is looked at once.

Buckets of the same least member have one home, where their members meet: a group of near copies shares most bands, so
that its sets of shingle hashes, made once a class, go to a home or a few and not to a place for every band. Pairs are
verified on full sets; of the buckets that a pair shares the least one counts it, at that bucket's home. Homes above
BLOCK classes or BLOCK_WORDS words are dealt out as pairs of blocks to many tasks. Pairs never become rows: a task adds
up links per class and returns a spanning forest, from which distributed connected components make the groups.

Defined cases: null text counts as empty; texts without a word are alone, with no link; one to four words are a single
shingle; rows with a null or repeated id are rows of their own and get their text's result (class_id is the least id of
the group, null where it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm import kernel as K
from shardwright.llm.components import components
from shardwright.llm.shared import forget, written

SHINGLE = 5
ROWS = 4
BLOCK = 512
BLOCK_WORDS = 4 << 20
_COPY = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands of so many rows that a pair of this similarity shares one with at least this probability."""
    p = similarity**rows
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def copy_hashes(h: np.ndarray, d: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence; rows without words get 0."""
    out = []
    full = np.flatnonzero(n)
    starts = np.concatenate(([0], np.cumsum(n)))[:-1]
    place = np.arange(len(h)) - starts[d]
    for base in _COPY:
        x = np.zeros(len(n), np.uint64)
        if len(full):
            x[full] = K.mix(np.add.reduceat(h * K.powers(base, int(n.max()))[place], starts[full]) ^ n[full].astype(np.uint64))
        out.append(x)
    return out[0], out[1]


def shingles(h: np.ndarray, d: np.ndarray, n: np.ndarray, short: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words, in order of rows, and their rows; rows of fewer words give `short`."""
    if len(h) >= k:
        ok = np.flatnonzero(d[k - 1 :] == d[: len(d) - k + 1])
        sh = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            sh = sh * _MUL + h[i : len(h) - k + 1 + i]
        sh, at = K.mix(sh[ok]), d[ok]
    else:
        sh, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        sh, at = np.concatenate((sh, short[few])), np.concatenate((at, few))
        o = np.argsort(at, kind="stable")
        sh, at = sh[o], at[o]
    return sh, at


def _node(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.stack((hi, lo), 1).astype(">u8").view("S16").ravel() if len(hi) else np.zeros(0, "S16")


def _binary(hi: np.ndarray, lo: np.ndarray, ok: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(np.stack((hi, lo), 1).astype(">u8"))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hi), [None, pa.py_buffer(data.tobytes())])
    return pa.compute.if_else(pa.array(ok), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _signatures(k: int, rows: int, bands: int):
    rng = np.random.default_rng(20240229)
    mul = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            ids, marks, (data, offs) = batch.column(0), batch.column(1), K.utf8(batch.column(2))
            for lo, hi in K.runs(offs):
                o = offs[lo : hi + 1] - offs[lo]
                h, d = K.word_hashes(data[offs[lo] : offs[hi]], o)
                n = np.bincount(d, minlength=hi - lo)
                c1, c2 = copy_hashes(h, d, n)
                sh, at = shingles(h, d, n, c1, k)
                full = np.flatnonzero(n)
                starts = np.searchsorted(at, full)
                out = np.zeros((hi - lo, bands), np.uint64)
                if len(full):
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            key = K.mix(key * _MUL + np.minimum.reduceat(sh * mul[r] + add[r], starts))
                        out[full, b] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(out.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), marks.slice(lo, hi - lo), _binary(c1, c2, n > 0), pa.array(n), lists], ["doc_id", "mark", "node", "n", "bands"])

    return run


def _sets(k: int):
    """Rows (node, n_copies, keys, text) to (node, n_copies, keys, words): the text's distinct shingle hashes, sorted, as
    bytes. Rows whose text isn't the node's are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, (data, offs) = batch.column(0).to_pylist(), K.utf8(batch.column(3))
            for lo, hi in K.runs(offs):
                h, d = K.word_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.bincount(d, minlength=hi - lo)
                c1, c2 = copy_hashes(h, d, n)
                names = np.ascontiguousarray(np.stack((c1, c2), 1).astype(">u8"))
                sh, at = shingles(h, d, n, c1, k)
                cut = np.searchsorted(at, np.arange(hi - lo + 1))
                own = [r for r in range(hi - lo) if names[r].tobytes() == node[lo + r]]
                if own:
                    rows = batch.select([0, 1, 2]).take(pa.array([lo + r for r in own]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([np.unique(sh[cut[r] : cut[r + 1]]).tobytes() for r in own], pa.binary())], ["node", "n_copies", "keys", "words"])

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column's rows, and n + 1 offsets into them."""
    offs = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), offs - offs[0]


def _verify(similarity: float):
    """Batches of (home, bi, bj, block, node, n_copies, keys, own, words), sorted by the first three; keys: of all buckets
    of the node, own: of those at this home."""

    def shared(keys: list[np.ndarray], own: set[int]) -> np.ndarray:
        """Whether the least key that two rows share is of this home."""
        n = len(keys)
        flat, row = np.concatenate(keys), np.repeat(np.arange(n), [len(x) for x in keys])
        o = np.lexsort((row, flat))
        flat, row = flat[o], row[o]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        state = np.zeros((n, n), np.int8)
        for lo, hi in zip(first, np.append(first[1:], len(flat))):
            if hi - lo > 1:
                at = np.ix_(row[lo:hi], row[lo:hi])
                part = state[at]
                part[part == 0] = 1 if int(flat[lo]) in own else 2
                state[at] = part
        return state == 1

    def common(sets: list[np.ndarray]) -> np.ndarray:
        n = len(sets)
        flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
        o = np.argsort(flat, kind="stable")
        flat, row = flat[o], row[o]
        fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
        several = ~fresh | np.append(~fresh[1:], False)
        place, row, total = np.cumsum(fresh & several)[several] - 1, row[several], np.zeros((n, n), np.float32)
        for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 8192):
            a, b = np.searchsorted(place, (lo, lo + 8192))
            m = np.zeros((n, 8192), np.float32)
            m[row[a:b], place[a:b] - lo] = 1
            total += m @ m.T
        return total

    def links(sets: list[np.ndarray], keys: list[np.ndarray], own: set[int], side: np.ndarray, cross: bool):
        """Index pairs i < j of similar texts that this home has to count."""
        none = np.zeros(0, int), np.zeros(0, int)
        if len(sets) == 2:
            if cross and side[0] == side[1] or int(np.intersect1d(keys[0], keys[1])[0]) not in own:
                return none
            both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
            return (np.array([0]), np.array([1])) if both >= similarity * (len(sets[0]) + len(sets[1]) - both) - 1e-9 else none
        ok = shared(keys, own)
        if cross:
            ok &= side[:, None] != side[None]
        if not ok.any():
            return none
        both, size = common(sets), np.array([len(x) for x in sets], np.float64)
        ok &= both >= similarity * (size[:, None] + size[None] - both) - 1e-6
        return np.nonzero(np.triu(ok, 1))

    def group(key, rows: list) -> list[tuple]:
        """rows: (block, node, n_copies, keys, own keys, set)."""
        seen: dict[bytes, tuple] = {}
        for x in rows:
            seen.setdefault(x[1], x)
        rows = list(seen.values())
        if len(rows) < 2:
            return []
        own = {int(x) for r in rows for x in r[4]}
        i, j = links([x[5] for x in rows], [x[3] for x in rows], own, np.array([x[0] for x in rows]), key[1] != key[2])
        if not len(i):
            return []
        n, size = len(rows), np.array([x[2] for x in rows], np.int64)
        docs = np.bincount(i, size[j], n) + np.bincount(j, size[i], n)
        texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        up = list(range(n))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        return [(rows[x][1], rows[root(x)][1], int(docs[x]), int(texts[x])) for x in range(n) if texts[x]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def made(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["node", "peer", "n_docs", "n_texts"])

        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            block, node, size = (batch.column(i).to_pylist() for i in (3, 4, 5))
            (every, at), (own, own_at), words = _flat(batch.column(6)), _flat(batch.column(7)), batch.column(8)
            out: list[tuple] = []
            for r, name in enumerate(names):
                if name != key:
                    if len(rows) > 1:
                        out += group(key, rows)
                    key, rows = name, []
                rows.append((block[r], node[r], size[r], every[at[r] : at[r + 1]], own[own_at[r] : own_at[r + 1]], np.frombuffer(words[r].as_py(), np.uint64)))
            if out:
                yield made(out)
        if len(rows) > 1 and (out := group(key, rows)):
            yield made(out)

    return run


def ngram_join(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its group of linked texts), copy_id (least doc_id of its
    exact class), n_copies (rows of its class), n_links (other documents of Jaccard similarity or more, copies
    included), n_text_links (other texts of that similarity). Expected recall per pair at the threshold: `recall`. Ids
    may be of any type that has an order."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands = bands_for(similarity, recall)
    sig = written(docs.mapInArrow(K.lean(_signatures(shingle, ROWS, bands)), f"doc_id {kind}, mark long, node binary, n long, bands array<long>"), "signatures")
    # the class's document that lends its text: of least id, and there of least hash, so that rows without an id are told apart
    lender = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    classes = sig.where("node is not null").groupBy("node").agg(lender.alias("of"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("copy_id", F.col("of.doc_id")), "classes")
    rows = classes.select("node", "n", F.explode("bands").alias("key"))
    # buckets with the same members: the one of the least key stays
    stat = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("node").alias("home"))
    kept = stat.where("m > 1").groupBy("m", "members", "home").agg(F.min("key").alias("key")).select("key", "home")
    rows = written(rows.join(kept, "key"), "buckets")
    homes = written(rows.select("home", "node", "n").distinct().groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_WORDS)).alias("nb")), "homes")  # written, so that the join below is of two plain exchanges, which can be split
    # at most `bands` keys a node
    keys = rows.join(homes, "home").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("key", "home", "nb"))).alias("keys"))
    nodes = keys.join(classes.select("node", "of", "n_copies"), "node")
    texts = nodes.join(docs, F.col("of.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("of.mark") == F.col("mark"))).select("node", "n_copies", "keys", "text")
    sets = texts.mapInArrow(K.lean(_sets(shingle)), "node binary, n_copies long, keys array<struct<key: bigint, home: binary, nb: bigint>>, words binary")
    at = F.explode(F.array_distinct(F.transform("keys", lambda x: F.struct(x["home"].alias("home"), x["nb"].alias("nb")))))
    sets = sets.withColumn("at", at).select(
        F.col("at.home").alias("home"), F.col("at.nb").alias("nb"), "node", "n_copies", F.transform("keys", lambda x: x["key"]).alias("every"),
        F.transform(F.filter("keys", lambda x: x["home"] == F.col("at.home")), lambda x: x["key"]).alias("own"), "words")
    sets = sets.withColumn("block", F.expr("pmod(xxhash64(node, home), nb)")).withColumn("other", F.explode(F.expr("sequence(0L, nb - 1)")))
    sets = sets.select("home", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "n_copies", "every", "own", "words")
    dealt = sets.repartition("home", "bi", "bj").sortWithinPartitions("home", "bi", "bj")
    found = written(dealt.mapInArrow(K.lean(_verify(similarity)), "node binary, peer binary, n_docs long, n_texts long"), "links")
    forget(rows)
    sums = found.groupBy("node").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_texts").alias("n_texts"))
    roots = components(found, "node", "peer")
    linked = sums.join(roots, "node").join(classes.select("node", "copy_id", "n_copies"), "node")
    least = linked.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    linked = linked.join(least, "root").select("node", "class_id", "n_docs", "n_texts")
    several = classes.where("n_copies > 1").select("node", "copy_id", "n_copies")
    info = linked.join(several, "node", "full").select("node", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
    return sig.select("doc_id", "node").join(info, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
