"""Language-model scores by prediction by partial matching, beside a unigram base.

The model reads a text as its lower-cased (A-Z) words, one space between them, then an end symbol, and predicts each
byte from the ORDER bytes before it. Escapes follow method D: a context that has seen T symbols, d of them distinct,
gives symbol s the share (2 c(s) - 1) / 2T and the escape d / 2T; a shorter context counts only symbols that the longer
one has not seen (symbol exclusion); below order 0 all bytes not yet seen are equal.

The trie is a table, one row per path of ORDER + 1 bytes, counted over all training documents. Everything that a path's
probability needs (totals, distinct symbols, exclusion sums, escapes) comes from joins and windows over at most 256
rows. No model is broadcast: documents stand in blocks of about BLOCK_BYTES, each block asks for the distinct paths and
tokens it holds, and gets their values back, so that memory depends on the block, not on the corpus. Token identity is a
64-bit hash.

Defined cases: null text counts as empty, and scores its end symbol only; a null id is in the fold of the empty text;
repeated rows are rows of their own; without any training document counts are 0 and the model is uniform; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm import kernel as K
from shardwright.llm.shared import fold, written

ORDER = 5
BLOCK_BYTES = 32 << 20
PART_BYTES = 1 << 18
END = 255  # no byte of UTF-8
_END_TOKEN = np.array([-7046029254386353131], np.int64)
_FOUND = "kind byte, key long, block long, n long"


def stream(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and the row of each (ends left out); paths of ORDER + 1 bytes and the row of each."""
    n = len(offs) - 1
    w = K.WORD[part]
    s, e = K.word_spans(part, offs, 0, len(part), w) if len(part) else (np.zeros(0, np.int64),) * 2
    low = K.LOWER[part]
    tokens = K.span_hash(low, s, e).view(np.int64) if len(s) else np.zeros(0, np.int64)
    row = np.searchsorted(offs, s, "right") - 1
    words = np.bincount(row, minlength=n)
    ln = e - s + 1
    size = np.bincount(row, ln, n).astype(np.int64)
    size[words == 0] = 1
    at = np.concatenate(([0], np.cumsum(size + ORDER)))  # each row: ORDER bytes of padding, then its symbols
    out = np.full(at[-1], END, np.uint8)
    first = np.cumsum(words) - words
    if len(s):
        within = np.cumsum(ln) - ln
        to = at[row] + ORDER + within - within[np.minimum(first, len(s) - 1)][row]
        real = ln.sum()
        step = np.arange(real) - np.repeat(within, ln)
        src = np.repeat(s, ln) + step
        dst = np.repeat(to, ln) + step
        out[dst] = low[np.minimum(src, len(low) - 1)]
        out[to + ln - 1] = 0x20
        full = np.flatnonzero(words)
        out[at[full + 1] - 1] = END
    path = np.zeros(len(out) - ORDER, np.int64)
    for k in range(ORDER + 1):
        path = (path << 8) | out[k : len(out) - ORDER + k]
    owner = np.repeat(np.arange(n), size + ORDER)[ORDER:]
    ok = np.ones(len(out), bool)
    for k in range(ORDER):
        ok[at[:-1] + k] = False
    ok = ok[ORDER:]
    return tokens, row, path[ok], owner[ok]


def _parts(text: pa.Array | pa.ChunkedArray):
    data, offs = K.utf8(text)
    for lo, hi in K.runs(offs, PART_BYTES):
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    o = np.argsort(keys, kind="stable")
    keys, n = keys[o], n[o]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _counted(keys: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys with their number in training; those of held-out rows too, with 0."""
    out = [K.unique_counts(keys[train])]
    if not train.all():
        u, _ = K.unique_counts(keys[~train])
        out.append((u, np.zeros(len(u), np.int64)))
    return out


class _Asked:
    """The distinct tokens (kind 0) and paths (kind 1) of one block so far, with their training counts."""

    def __init__(self):
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(_END_TOKEN, np.zeros(1, np.int64))], []]

    def add(self, text: pa.Array, held: np.ndarray) -> None:
        self.found[0].append((_END_TOKEN, np.array([int((~held).sum())])))
        for lo, hi, part, offs in _parts(text):
            train = ~held[lo:hi]
            tok, row, path, owner = stream(part, offs)
            self.found[0] += _counted(tok, train[row])
            self.found[1] += _counted(path, train[owner])
            if len(self.found[1]) > 24:
                self.found = [[_merged(x)] for x in self.found]

    def batch(self, block: int) -> pa.RecordBatch:
        found = [_merged(x) if x else (np.zeros(0, np.int64),) * 2 for x in self.found]
        kind = np.repeat(np.array([0, 1], np.int8), [len(x[0]) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([x[0] for x in found])), pa.array(np.full(len(kind), block, np.int64)), pa.array(np.concatenate([x[1] for x in found]))], ["kind", "key", "block", "n"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, _Asked] = {}
    for batch in batches:
        block = batch.column(2).to_numpy()
        held = batch.column(1).to_numpy(zero_copy_only=False)
        for k in np.unique(block).tolist():
            at = np.flatnonzero(block == k)
            text = batch.column(0) if len(at) == len(block) else batch.column(0).take(pa.array(at))
            blocks.setdefault(k, _Asked()).add(text, held[at])
    for k in list(blocks):
        yield blocks.pop(k).batch(k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, held_out, text) as (block, blob), compressed pieces of about 1 MB of a block's rows: they
    take a third of the shuffle that rows would."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        block = batch.column(0).to_numpy()
        for k in np.unique(block).tolist():
            own = batch.select([1, 2, 3]).take(pa.array(np.flatnonzero(block == k)))
            blobs = []
            for lo, hi in K.runs(K.utf8(own.column(2))[1]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(lo, hi - lo)]) for c in own.columns], schema=own.schema))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["block", "blob"])


def _scored(total: int, distinct: int):
    less = math.log10(total + 0.1 * (distinct + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kind, key, value = (answers[c].to_numpy() for c in ("kind", "key", "value"))
        parts = []
        for k in (0, 1):
            own = kind == k
            o = np.argsort(key[own], kind="stable")
            parts.append((K.Lookup(key[own][o]), value[own][o]))
        (word, count), (path, log_p) = parts
        log_c, end = np.log10(count + 0.1), word(_END_TOKEN)
        out = []
        for blob in docs["blob"]:
            rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
            n, known, base, score = [], [], [], []
            for lo, hi, part, offs in _parts(rows["text"]):
                tok, row, paths, owner = stream(part, offs)
                at, place = word(tok), path(paths)
                if end[0] < 0 or (at < 0).any() or (place < 0).any():
                    raise ValueError("a block lacks answers: its documents changed between two reads")
                n.append(np.bincount(row, minlength=hi - lo) + 1)
                known.append(np.bincount(row, count[at] > 0, hi - lo).astype(np.int64) + int(count[end][0] > 0))
                base.append(np.bincount(row, log_c[at], hi - lo) + log_c[end][0] - n[-1] * less)
                score.append(np.bincount(owner, log_p[place], hi - lo))
            n, known, base, score = (np.concatenate(x) for x in (n, known, base, score))
            out.append(pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total, np.int64), "base_score": base, "score": score}))
        del parts, word, path
        K.release()
        if not out:
            raise ValueError("a block has answers and no documents: they changed between two reads")
        return pa.concat_tables(out)

    return run


def path_probabilities(paths: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, value): log10 of the probability of each path's last byte after its first `order` bytes, from rows (key, n)
    of distinct packed paths and their counts; paths of count 0 are such as the training lacks."""
    mask = lambda j: (1 << 8 * (j + 1)) - 1
    ctx = Window.partitionBy(F.shiftright("g", 8))
    known = lambda x: F.sum(F.when(F.col("c") > 0, x).otherwise(0)).over(ctx)

    # counts of each order are sums of those of the order above
    levels = {order: paths.select(F.col("key").alias("g"), F.col("n").alias("c"))}
    for j in range(order - 1, -1, -1):
        levels[j] = written(levels[j + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask(j)).cast("long")).alias("g")).agg(F.sum("c").alias("c")), f"order-{j}")

    # at most 256 rows a context, as the last byte is all that differs
    a = levels[0].withColumn("t", F.sum("c").over(ctx)).withColumn("d", known(F.lit(1)))
    a = a.withColumn("q", F.when(F.col("c") == 0, 1 / (256 - F.col("d"))))
    for j in range(1, order + 1):
        up = a.select(F.col("g").alias("pg"), F.col("c").alias("pc"), F.col("t").alias("pt"), F.col("d").alias("pd"), F.col("q").alias("pq"))
        a = levels[j].withColumn("pg", F.col("g").bitwiseAND(F.lit(mask(j - 1)).cast("long"))).join(up, "pg")
        a = a.withColumn("t", F.sum("c").over(ctx)).withColumn("d", known(F.lit(1))).withColumn("seen", known(F.col("pc")))
        rest, new = F.col("pt") - F.col("seen"), F.col("pd") - F.col("d")
        escape = F.when(rest > 0, new / (2 * rest)).otherwise(1.0)
        q = F.when(F.col("c") > 0, None).when(F.col("pc") > 0, (2 * F.col("pc") - 1) / (2 * rest)).otherwise(escape * F.col("pq"))
        a = a.withColumn("q", q).select("g", "c", "t", "d", "q")
    p = F.when(F.col("c") > 0, (2 * F.col("c") - 1) / (2 * F.col("t"))).otherwise(F.when(F.col("t") > 0, F.col("d") / (2 * F.col("t"))).otherwise(1.0) * F.col("q"))
    return a.select(F.col("g").alias("key"), F.log10(p).alias("value"))


def ppm_scores(docs: DataFrame, folds: int = 10, held_fold: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    docs is read twice, and must come in the same partitions both times, as the scan of a table does: a block is a
    partition of it, or one of several equal parts of a large one. A block that changed ends the query with an error."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"))
    # text takes about twice its compressed size
    parts = max(1, round(2 * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) / block_bytes))
    docs = docs.withColumn("block", F.spark_partition_id().cast("long") * parts + F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts).cast("long")))
    asked = written(docs.select("text", "held_out", "block").mapInArrow(K.lean(_asked), _FOUND), "asked")
    counts = written(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    total, distinct = counts.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    paths = path_probabilities(counts.where("kind = 1").select("key", "n"))
    values = counts.where("kind = 0").select("kind", "key", F.col("n").cast("double").alias("value")).unionByName(paths.select(F.lit(1).cast("byte").alias("kind"), "key", "value"))
    answers = asked.select("kind", "key", "block").join(values, ["kind", "key"]).select("block", "kind", "key", "value")
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("block", "doc_id", "held_out", "text").mapInArrow(K.lean(_packed), "block long, blob binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(total, distinct), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _bytes(size: str) -> int:
    """A Spark byte setting as a number."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.removesuffix("b")[:1]]
