"""Document fingerprints: digests of improbable features.

The entropy of every window of WIDTH bytes falls into one of BINS; a window is the more improbable the fewer windows
of the whole corpus share its bin. Among any WIDTH windows in a row the most improbable one gets a vote (the first of
equals), and windows of VOTES or more are the text's features. Features go, in order, into a chain of Bloom filters of
BITS bits, PER_FILTER features each. Likeness of two digests: each filter of the shorter chain against its best match
in the other, by common bits beyond chance over the most there could be, then the mean.

Entropies are integers that slide by one byte in and one byte out, so equal texts have equal fingerprints wherever they
stand.

Texts are read twice: once for the corpus' histogram and each row's id and hash, which give the ranges, and once to be
dealt to their range, whose first row goes to the range before it too. There are RANGES ranges at most, whatever the
corpus, of PART_BYTES at least; a task goes through its range as a stream, a megabyte at a time.

Defined cases: ids are whole numbers; null text counts as empty; empty texts have the empty fingerprint, which is like itself only; a text of
fewer than WIDTH bytes is a single feature; documents go by ascending id, nulls first, rows of one id by a hash of
their text; a sole document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.llm import kernel as K
from shardwright.llm.shared import written

WIDTH = 64
BINS = 1001
LEAST_BIN = 100
VOTES = 16
BITS = 2048
PER_FILTER = 160
PART_BYTES = 16 << 20
RANGES = 20_000
_N = np.arange(WIDTH + 1)
_G = np.round((1 << 16) * _N * np.log2(np.maximum(_N, 1))).astype(np.int64)
_STEP = np.diff(_G)
_POWERS = np.multiply.accumulate(np.full(WIDTH, 0x9E3779B97F4A7C15, np.uint64))


def entropy_bins(b: np.ndarray) -> np.ndarray:
    """The bin of the window that starts at each byte, of len(b) - WIDTH + 1."""
    n = len(b) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    base = int(_G[np.bincount(b[:WIDTH])].sum())
    step = 1 << 18  # bytes at once, to stay within the cache
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        part = b[lo : min(hi + WIDTH, len(b))]
        back, ahead = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)
        for d in range(1, WIDTH):
            same = (part[d:] == part[:-d]).view(np.uint8)
            back[d:] += same
            ahead[:-d] += same
        k = len(part) - WIDTH  # windows after the first here
        e = np.empty(k + 1, np.int64)
        e[0] = base
        np.cumsum(_STEP[back[WIDTH:]] - _STEP[ahead[:k]], out=e[1:])
        e[1:] += base
        out[lo:hi] = e[: hi - lo]
        base = int(e[-1])
    return ((6 * WIDTH << 16) - out) * (BINS - 1) // (6 * WIDTH << 16)


def _inside(offs: np.ndarray, n: int) -> np.ndarray:
    """Which of n windows lie within one row."""
    ok = np.ones(n, bool)
    for x in offs[1:-1]:
        ok[max(0, x - WIDTH + 1) : x] = False
    return ok


def ranks(counts: dict[int, int]) -> np.ndarray:
    """For each bin its rank among all, the rarest first; windows of almost no entropy come last."""
    order = sorted(range(BINS), key=lambda i: (i < LEAST_BIN, counts.get(i, 0), i))
    out = np.empty(BINS, np.int64)
    out[order] = np.arange(BINS)
    return out


def features(b: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all rows in order, and their rows."""
    rows = len(offs) - 1
    bins = entropy_bins(b)
    picked = [np.zeros(0, np.int64)]
    size = np.diff(offs)
    if len(bins):
        score = (rank[bins] << 40) | np.arange(len(bins))
        best, wide = score, 1
        while wide < WIDTH:
            best = np.minimum(best[: len(best) - wide], best[wide:]) if len(best) > wide else best[:0]
            wide *= 2
        if len(best):
            ok = _inside(offs, len(bins))
            row = np.repeat(np.arange(rows), size)[: len(bins)]
            whole = np.flatnonzero(ok[: len(best)] & ok[WIDTH - 1 :] & (row[: len(best)] == row[WIDTH - 1 :]))
            votes = np.bincount(best[whole] & ((1 << 40) - 1), minlength=len(bins))
            picked.append(np.flatnonzero(votes >= VOTES))
        for r in np.flatnonzero((size >= WIDTH) & (size < 2 * WIDTH - 1)):
            lo = offs[r]
            picked.append(np.array([score[lo : lo + size[r] - WIDTH + 1].min() & ((1 << 40) - 1)]))
    at = np.unique(np.concatenate(picked))
    h = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        h += (b[at + k].astype(np.uint64) + np.uint64(1)) * _POWERS[k]
    row = np.searchsorted(offs, at, "right") - 1
    # a row of whole windows has a vote winner of VOTES or more unless its votes are spread thin: then its best window
    few = np.flatnonzero((size > 0) & (np.bincount(row, minlength=rows) == 0))
    if len(few):
        more = np.zeros(len(few), np.uint64)
        for i, r in enumerate(few):
            lo, hi = offs[r], offs[r + 1]
            if size[r] >= WIDTH:
                lo = int(score[lo : hi - WIDTH + 1].min() & ((1 << 40) - 1))
                hi = lo + WIDTH
            part = b[lo:hi].astype(np.uint64) + np.uint64(1)
            more[i] = (part * _POWERS[: len(part)]).sum(dtype=np.uint64)
        h, row = np.concatenate((h, more)), np.concatenate((row, few))
        o = np.argsort(row, kind="stable")
        h, row = h[o], row[o]
    return K.mix(h), row


class Digests:
    """Fingerprints of some texts: filters as rows of bits, and each text's range of them."""

    def __init__(self, texts: list[bytes], rank: np.ndarray):
        n = len(texts)
        filters, count = [], np.zeros(n, np.int64)
        self.n = np.zeros(n, np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        for lo, hi in K.runs(np.concatenate(([0], np.cumsum(lengths)))):
            b = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
            h, row = features(b, np.concatenate(([0], np.cumsum(lengths[lo:hi]))), rank)
            k = np.bincount(row, minlength=hi - lo)
            self.n[lo:hi] = k
            chain = -(-k // PER_FILTER)
            first = np.cumsum(chain) - chain
            count[lo:hi] = chain
            own = first[row] + (np.arange(len(row)) - (np.cumsum(k) - k)[row]) // PER_FILTER
            bits = np.zeros((int(chain.sum()), BITS), bool)
            for j in range(5):
                bits[own, ((h >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
            filters.append(bits)
        self.bits = np.concatenate(filters) if filters else np.zeros((0, BITS), bool)
        self.ends = np.cumsum(count)
        self.starts = self.ends - count

    def strings(self) -> list[str]:
        packed = np.packbits(self.bits, axis=1)
        return ["" if a == z else f"{n}:{base64.b64encode(packed[a:z].tobytes()).decode()}" for n, a, z in zip(self.n, self.starts, self.ends)]


def likeness(a: Digests, i: np.ndarray, b: Digests, j: np.ndarray) -> np.ndarray:
    """Likeness of the digests a[i] and b[j], pair by pair."""
    ka, kb = (a.ends - a.starts)[i], (b.ends - b.starts)[j]
    out = np.where((ka == 0) & (kb == 0), 1.0, 0.0)
    one = np.flatnonzero((ka == 1) & (kb == 1))
    for lo in range(0, len(one), 256):
        part = one[lo : lo + 256]
        x, y = a.bits[a.starts[i[part]]], b.bits[b.starts[j[part]]]
        out[part] = _beyond((x & y).sum(1), x.sum(1), y.sum(1))
    for p in np.flatnonzero((ka > 0) & (kb > 0) & (ka + kb > 2)):
        x, y = a.bits[a.starts[i[p]] : a.ends[i[p]]], b.bits[b.starts[j[p]] : b.ends[j[p]]]
        if len(x) > len(y):
            x, y = y, x
        y32, most = y.astype(np.float32).T, []
        for lo in range(0, len(x), 256):
            most.append(_beyond(x[lo : lo + 256].astype(np.float32) @ y32, x[lo : lo + 256].sum(1)[:, None], y.sum(1)[None]).max(1))
        out[p] = np.concatenate(most).mean()
    return out


def _beyond(common, x, y):
    chance = x * y / BITS
    return np.clip((common - chance) / np.maximum(np.minimum(x, y) - chance, 1e-9), 0, 1)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, text) to (doc_id, mark), then (bin, n) of all windows, bin -1 for the bytes."""
    total, size = np.zeros(BINS, np.int64), 0
    for batch in batches:
        data, offs = K.utf8(batch.column(2))
        size += len(data)
        for lo, hi in K.runs(offs):
            bins = entropy_bins(data[offs[lo] : offs[hi]])
            total += np.bincount(bins[_inside(offs[lo : hi + 1] - offs[lo], len(bins))], minlength=BINS)
        none = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, none], ["doc_id", "mark", "bin", "n"])
    at = np.flatnonzero(total)
    none = pa.nulls(len(at) + 1, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(np.append(at, -1)), pa.array(np.append(total[at], size))], ["doc_id", "mark", "bin", "n"])


def _places(ids: pa.Array, marks: pa.Array) -> np.ndarray:
    """Rows' ids, nulls first, and marks as bytes that sort alike."""
    flip = lambda x: (x.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    out = np.zeros(len(ids), np.dtype([("full", "u1"), ("id", ">u8"), ("mark", ">u8")]))
    out["full"], out["id"], out["mark"] = ids.is_valid().to_numpy(zero_copy_only=False), flip(ids.fill_null(-(1 << 63))), flip(marks)
    return out.view("S17").ravel()


def _dealt(least):
    """To rows (doc_id, mark, text) adds the range of each, and hands a range's first rows to the range before it too.
    least: the place of each range's first row, sorted, a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = least.value
        for batch in batches:
            place = _places(batch.column(0), batch.column(1))
            part = np.searchsorted(bounds, place, "right") - 1
            head = np.flatnonzero(place == bounds[part])
            take = pa.array(np.concatenate((np.arange(len(part)), head)))
            ahead = np.concatenate((np.zeros(len(part), bool), np.ones(len(head), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((part, (part[head] - 1) % len(bounds))).astype(np.int32)), pa.array(ahead), *(c.take(take) for c in batch.columns)], ["part", "ahead", "doc_id", "mark", "text"])

    return run


def _compared(rank: np.ndarray):
    """Sorted rows (part, ahead, doc_id, mark, text) to results; each row's next one comes after it."""

    def results(rows: list[tuple]) -> pa.RecordBatch | None:
        """All but the last of rows; a row that begins a part's look-ahead has no result of its own."""
        at = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        if not at:
            return None
        edited = []
        for k in at:
            s = rows[k][3]
            q = len(s) // 4
            edited.append((s[: len(s) - q] + rows[k + 1][3][:q]).encode())
        own = Digests([r[3].encode() for r in rows], rank)
        new = Digests(edited, rank)
        at, place = np.array(at), np.arange(len(at))
        names, names_new = own.strings(), new.strings()
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][2] for k in at], pa.int64()), pa.array([len(rows[k][3]) for k in at], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited]), pa.array([names[k] for k in at]), pa.array(names_new), pa.array(likeness(own, at, new, place)), pa.array(likeness(own, at, own, at + 1))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            _, offs = K.utf8(batch.column(4))
            for lo, hi in K.runs(offs):
                part = batch.slice(lo, hi - lo)
                rows += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), (x or "" for x in part.column(4).to_pylist()))
                if (out := results(rows)) is not None:
                    yield out
                rows = rows[-1:]

    return run


def fingerprints(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    seen = written(docs.mapInArrow(K.lean(_seen), "doc_id long, mark long, bin long, n long"), "texts-seen")
    # at most BINS rows and one
    found = {r["bin"]: r["n"] for r in seen.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    size = found.pop(-1, 0)
    rank = ranks(found)
    ranges = seen.where("bin is null").select("doc_id", "mark").repartitionByRange(min(RANGES, -(-size // part_bytes) or 1), "doc_id", "mark")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("full"), "doc_id", "mark")).alias("x")
    # at most RANGES rows
    least = ranges.select("doc_id", "mark", F.spark_partition_id().alias("p")).groupBy("p").agg(first).select("x.doc_id", "x.mark").toArrow().combine_chunks()
    if not least.num_rows:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_chars"), *(F.lit("").alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), F.lit(0.0).alias("near_edited"), F.lit(0.0).alias("near_next")).limit(0)
    bounds = np.sort(_places(least["doc_id"].combine_chunks(), least["mark"].combine_chunks()))
    dealt = docs.mapInArrow(K.lean(_dealt(spark.sparkContext.broadcast(bounds))), "part int, ahead boolean, doc_id long, mark long, text string")
    dealt = dealt.repartitionById(len(bounds), "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "mark")
    return dealt.mapInArrow(K.lean(_compared(rank)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
