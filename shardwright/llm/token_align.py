"""Alignment of two tokenizers over the same text: groups between common cuts, links of overlapping tokens.

Texts are cut where neither tokenizer's tokens ever cross: before a space that follows a character other than white space
(byte-level pre-tokens end there; no piece of the other vocabulary goes on past it, which is looked up when it is loaded;
where that doesn't hold, a text is one segment). Alignment is worked out once for each distinct segment, as a relation:
tokens are exploded with their places, a windowed running sum of lengths gives their ends, both sides meet on segment and
end, a running count of common ends numbers the groups. Between two neighbouring ends, of either side, lies one token of
each side and no other such pair, so links are the ends themselves with the next token of each side: rows grow with
tokens, whatever the length of a group. How often a pair of ids is linked is counted over the corpus, weighted by how
often a segment occurs.

Documents get their segments' results back by block: a block is some BLOCK bytes of neighbouring documents, it asks for
its distinct segments only. Both go to their block packed, as compressed Arrow streams of neighbouring rows.

Defined cases: a text that is null or empty, or that a tokenizer doesn't give back byte for byte (U+2581 stands for a
space there, so texts that hold it), has no tokens: zeros and an empty digest, and it adds nothing to counts. Documents
are rows: null or repeated ids, and repeated rows, each get a row and each count. No rows, no result. A text is worked on
in one piece, so it has to fit into a task; nothing else gathers."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardwright.llm.kernel import lean, release, runs, utf8
from shardwright.llm.shared import forget, settle, written

#: Where the tokenizers' files lie by default.
TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block and of those that are split at a time, bytes of rows that are packed at a time, rows of a
#: result batch, segments whose results are put together at a time, segments that blocks ask for in a task of the relation.
BLOCK, CHUNK, PACK, ROWS, SEGMENTS, TASK = 32 << 20, 4 << 20, 16 << 20, 1 << 15, 1 << 18, 1 << 18
#: What is taken off ids, so that those below 2^16 go into two signed bytes.
BASE = 1 << 15
#: Tasks that share a block.
SPAN = 4
#: Pairs of linked ids (16 bytes each, and an index) that may go to all executors.
BROADCAST = 1 << 20

SPACE = "▁"
_BOUNDARY = re.compile(f"(?<=[^\\s{SPACE}])(?= )")
#: The same characters, spelt out for the other library of patterns: a space after one of them, or at the start.
_ODD = r"(?:^|[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}]) "
_PAST_SPACE = re.compile(f"[^{SPACE}]{SPACE}")
#: Fixed value: the pattern of pre-tokens that byte-level tokenizers of this kind share.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others as the characters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in shown}
    out.update((chr(256 + n), b) for n, b in enumerate(b for b in range(256) if chr(b) not in out))
    return out


def segments(text: str, cuts: bool = True) -> list[str]:
    """Segments of space + text, without the space that each of them begins with."""
    return [s[1:] for s in _BOUNDARY.split(" " + text)] if cuts else [text]


def split(texts: pa.Array, cuts: bool) -> Iterator[tuple[np.ndarray, pa.ListArray]]:
    """Rows of texts and their segments, some CHUNK bytes at a time: cut at every space where that is all there is to it,
    else by the rule."""
    if not len(texts):
        return
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if cuts else np.ones(len(texts), bool)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for some, by_rule in ((np.flatnonzero(~odd), False), (np.flatnonzero(odd), True)):
        ends = np.concatenate(([0], np.cumsum(sizes[some])))
        for lo, hi in runs(ends, CHUNK):
            rows = some[lo:hi]
            if by_rule:
                yield rows, pa.array([segments(texts[i].as_py(), cuts) for i in rows.tolist()], pa.list_(pa.string()))
            else:
                yield rows, pc.split_pattern(texts.take(pa.array(rows)), " ")


class Tokenizers:
    """Both tokenizers, and what their tokens stand for in bytes. Made once for each Python worker."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        alphabet, n = byte_alphabet(), self.a.get_vocab_size()
        words = [self.a.id_to_token(i) or "" for i in range(n)]
        self.bytes_a = [bytes(alphabet[c] for c in w) if all(c in alphabet for c in w) else b"" for w in words]
        every = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(every)]
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int32) for v in (self.bytes_a, self.bytes_b))
        if max(n, len(every)) > 2 * BASE:
            raise ValueError(f"vocabularies of more than {2 * BASE} entries")
        self.lone = self.b.piece_to_id(SPACE)
        kind = json.loads(byte_level)
        plain = kind.get("normalizer") is None and (kind.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.cuts = plain and every[self.lone] == SPACE and not any(_PAST_SPACE.search(p) for p in every)
        ascii_all = "".join(map(chr, range(128)))
        changes = any(self.b.normalize(x + y) != SPACE + (x + y).replace(" ", SPACE) for x in ascii_all for y in ascii_all)
        self.ascii = not changes
        self.ranked = self._ranked(kind) if plain else None

    def _ranked(self, kind: dict):
        """The same byte-level tokenizer by another library, which is several times faster on short texts, if ids are in
        the order of merges (that library merges by id); else None."""
        import tiktoken

        def parts(merge):
            return merge.split(" ") if isinstance(merge, str) else merge

        vocab, merges, splits = kind["model"]["vocab"], kind["model"]["merges"], kind["pre_tokenizer"]
        made = [vocab["".join(parts(m))] for m in merges]
        added = {t["id"] for t in kind.get("added_tokens", [])}
        ranks = {b: i for i, b in enumerate(self.bytes_a) if b and i not in added}
        if made != sorted(made) or len(ranks) != 256 + len(made) or not splits.get("use_regex", True) or splits.get("add_prefix_space"):
            return None
        return tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def segments(self, text: str) -> list[str]:
        return segments(text, self.cuts)

    def whole(self, segment: str) -> bool:
        """Do the pieces give it back? Byte-level tokens always do."""
        return SPACE not in segment and (segment.isascii() and self.ascii or self.b.normalize(segment) == (SPACE + segment.replace(" ", SPACE) if segment else ""))

    def encode(self, parts: list[str]) -> tuple[list, list]:
        """Ids of both sides for each segment."""
        if self.ranked:
            a = [self.ranked.encode_ordinary(" " + s) for s in parts]
        else:
            a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        for i, s in enumerate(parts):
            if not s:
                b[i] = [self.lone]  # nothing is put before an empty text
        return a, b


@functools.lru_cache(maxsize=2)
def _loaded(byte_level: bytes, pieces: bytes) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def _told(block: int, texts: list[pa.Array], tool: Tokenizers) -> Iterator[pa.RecordBatch]:
    """The distinct segments of a block's texts and how often each occurs, without texts that don't come back: their
    segments that don't are found among the distinct ones."""

    def counted(lists: Iterator[pa.ListArray]) -> pa.Table:
        parts = [pc.value_counts(x.flatten()) for x in lists]
        every = pa.table({"segment": pa.chunked_array([p.field("values") for p in parts], pa.string()), "n": pa.chunked_array([p.field("counts") for p in parts], pa.int64())})
        return every.group_by("segment", use_threads=False).aggregate([("n", "sum")]).combine_chunks()

    every = counted(x for held in texts for _, x in split(held, tool.cuts))
    lost = [s for s in every.column("segment").to_pylist() if not tool.whole(s)]
    if lost:
        gone = pa.array(lost, pa.string())
        every = counted(_without(x, gone) for held in texts for _, x in split(held, tool.cuts))
    for batch in every.to_batches(ROWS):
        yield pa.record_batch({"block": pa.array(np.full(batch.num_rows, block)), "segment": batch.column("segment"), "n": batch.column("n_sum")})


def _without(lists: pa.ListArray, gone: pa.Array) -> pa.ListArray:
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    bad = row[pc.is_in(lists.flatten(), value_set=gone).to_numpy(zero_copy_only=False)]
    return lists.take(pa.array(np.setdiff1d(np.arange(len(lists)), bad)))


def aligned(docs: DataFrame, byte_level: str = f"{TOKENIZERS}/{BYTE_LEVEL}", pieces: str = f"{TOKENIZERS}/{PIECES}", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of docs."""
    spark = docs.sparkSession
    with open(byte_level, "rb") as f, open(pieces, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    tools = lambda: _loaded(*files.value)
    cuts = tools().cuts

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = written(texts.mapInArrow(lean(_numbered), f"id {docs.schema[id_col].dataType.simpleString()}, text string, block long"), "texts")

    def counted(batches):
        at, held = None, []
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if len(part):
                    if held and blocks[part[0]] != at:
                        yield from _told(at, held, tools())
                        held = []
                    at = int(blocks[part[0]])
                    held.append(batch.column(1).slice(int(part[0]), len(part)))
        if held:
            yield from _told(at, held, tools())

    asked = written(texts.where("text <> ''").select("block", "text").mapInArrow(lean(counted), "block long, segment string, n long"), "asked")
    found = _relation(_encoded(asked, tools))
    # dealt out by key, which is worked out again where the rows arrive: of all that is sent it would be the larger part
    keyed = asked.select("segment", "block").repartition(_tasks(asked), *_key(F.col("segment")))
    keyed = keyed.select(*_key(F.col("segment")), "segment", "block").distinct()
    told = written(keyed.join(found, ["k1", "k2"]).drop("k1", "k2"), "told")
    forget(asked)
    forget(found)
    del asked, found, keyed
    settle(spark)

    def assembled(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine, theirs = _unpacked(mine), _unpacked(theirs)
        names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
        sums, digests = np.zeros((mine.num_rows, len(names)), np.int64), np.full(mine.num_rows, "", object)
        if theirs.num_rows:
            # a segment that isn't there belongs to texts without tokens
            words, shown = theirs.column("segment").combine_chunks(), theirs.column("groups").combine_chunks()
            n_a, n_best, count_sum = (theirs.column(c).to_numpy() for c in ("n_a", "n_best", "count_sum"))
            n_groups = pc.count_substring(shown, ";").to_numpy() + 1
            n_b = pc.count_substring(shown, ",").to_numpy() + 2 * n_groups - n_a
            each = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum], 1).astype(np.int64)
            texts = mine.column("text").combine_chunks()
            full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
            texts = texts if len(full) == len(texts) else texts.take(pa.array(full))
            for part, lists in split(texts, cuts):
                rows, ends = full[part], lists.offsets.to_numpy()
                at = pc.index_in(lists.flatten(), value_set=words)
                ends = (ends - ends[0]).astype(np.int64)
                for lo, hi in runs(ends, SEGMENTS):
                    some = at.slice(int(ends[lo]), int(ends[hi] - ends[lo]))
                    offsets = ends[lo : hi + 1] - ends[lo]
                    lost = np.logical_or.reduceat(some.is_null().to_numpy(zero_copy_only=False), offsets[:-1])
                    some = some.fill_null(0)
                    sums[rows[lo:hi]] = np.where(lost[:, None], 0, np.add.reduceat(each[some.to_numpy()], offsets[:-1]))
                    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), shown.take(some)), ";")
                    data, at_bytes = utf8(joined)
                    spans = zip(lost.tolist(), at_bytes[:-1].tolist(), at_bytes[1:].tolist(), strict=True)
                    digests[rows[lo:hi]] = ["" if gone else hashlib.sha256(data[i:j]).hexdigest() for gone, i, j in spans]
        release()
        columns = {n: pa.array(sums[:, i]) for i, n in enumerate(names)}
        return pa.table({"id": mine.column("id"), **columns, "groups_sha256": pa.array(digests.tolist(), pa.string())})

    shape = f"id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    mine, theirs = (x.mapInArrow(lean(_packed), "block long, rows binary").groupBy("block") for x in (texts, told))
    return mine.cogroup(theirs).applyInArrow(assembled, shape).withColumnRenamed("id", id_col)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their block, fixed by being written: SPAN neighbouring tasks give a SPANth of its BLOCK
    bytes each, so that small partitions make no small blocks."""
    first, size = TaskContext.get().partitionId() // SPAN << 33, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        before = size + np.cumsum(sizes) - sizes
        size += int(sizes.sum())
        yield pa.record_batch([*batch.columns, pa.array(first + before // (BLOCK // SPAN))], names=["id", "text", "block"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, rows): of some PACK bytes at a time, each block's rows as one compressed stream."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches(held).combine_chunks()
        order = np.argsort(every.column("block").to_numpy(), kind="stable")
        every = every.take(pa.array(order))
        blocks = every.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in itertools.pairwise(cuts):
            sink, rows = pa.BufferOutputStream(), every.slice(lo, hi - lo).drop_columns("block")
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows)
            yield pa.record_batch({"block": pa.array([blocks[lo]], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK:
            yield from packed(held)
            held, size = [], 0
    if held:
        yield from packed(held)


def _unpacked(packs: pa.Table) -> pa.Table:
    """The rows of a block; none: packs itself, without rows."""
    streams = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs.column("rows")]
    return pa.concat_tables(streams) if streams else packs


def _key(segment) -> list:
    """128 bits that stand for a segment, so that long ones don't go along with each of their tokens."""
    return [F.xxhash64(F.lit(i), segment).alias(f"k{i}") for i in (1, 2)]


def _encoded(asked: DataFrame, tools) -> DataFrame:
    """(k1, k2, times, n_a, ids, lengths) of distinct segments, by key: first the n_a tokens of A, then those of B. Ids
    stand there less BASE, in two bytes."""

    @F.arrow_udf("n_a int, ids array<smallint>, lengths array<smallint>")
    def encoded(words: pa.Array) -> pa.Array:
        return pa.concat_arrays([_tokens(words.slice(lo, 4096), tools()) for lo in range(0, max(len(words), 1), 4096)])

    distinct = asked.groupBy("segment").agg(F.sum("n").alias("times")).select(*_key(F.col("segment")), "times", encoded("segment").alias("tokens"))
    return distinct.select("k1", "k2", "times", "tokens.*").repartition(_tasks(asked), "k1", "k2")


def _tasks(asked: DataFrame) -> int:
    """So many tasks that each gets TASK of what blocks ask for at most, on average."""
    return max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // TASK))


def _tokens(words: pa.Array, tool: Tokenizers) -> pa.Array:
    a, b = tool.encode(words.to_pylist())
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ids = [np.fromiter(itertools.chain.from_iterable(x), np.int32, int(n.sum())) for x, n in ((a, n_a), (b, n_b))]
    sizes = [tool.size_a[ids[0]], tool.size_b[ids[1]]]
    row = np.arange(len(a))
    bytes_of = pc.binary_length(words).to_numpy(zero_copy_only=False) + 1
    if any((np.bincount(np.repeat(row, n), s, len(a)) != bytes_of).any() for n, s in ((n_a, sizes[0]), (n_b, sizes[1]))):
        raise ValueError("a segment doesn't come back from its tokens")
    order = np.argsort(np.concatenate((np.repeat(row, n_a), np.repeat(row, n_b))), kind="stable")
    offsets = pa.array(np.concatenate(([0], np.cumsum(n_a + n_b))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array((np.concatenate(x)[order] - less).astype(np.int16))) for x, less in ((ids, BASE), (sizes, 0))]
    return pa.StructArray.from_arrays([pa.array(n_a.astype(np.int32)), *lists], ["n_a", "ids", "lengths"])


def _relation(encoded: DataFrame) -> DataFrame:
    """(k1, k2, groups, n_a, n_best, count_sum) of each segment. All steps up to the groups go by segment, so there is no
    shuffle after that of encoded; rows are sorted by segment before they are exploded, so what comes out is in order."""
    key = ["k1", "k2"]
    tokens = encoded.sortWithinPartitions(*key).select(*key, "times", "n_a", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "token"))
    tokens = tokens.select(*key, "times", "place", (F.col("place") < F.col("n_a")).alias("of_a"), (F.col("token.ids").cast("int") + BASE).alias("id"), F.col("token.lengths").alias("length"))
    along = Window.partitionBy(*key, "of_a").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = tokens.select(*key, "times", "of_a", "id", F.sum("length").over(along).alias("end"))
    # Both sides meet on segment and end: side by side in one order, so that the full equi-join is a look at the next
    # row. From the last end back, running values are what follows: the group's number, the token that covers.
    back = Window.partitionBy(*key).orderBy(F.desc("end"), F.desc("of_a"))
    running = back.rowsBetween(Window.unboundedPreceding, 0)
    met = ends.withColumn("common", F.lead("end").over(back).eqNullSafe(F.col("end"))).withColumn("later", F.lag("end").over(back).eqNullSafe(F.col("end")))
    mark = F.concat(F.col("id").cast("string"), F.when(F.col("common") | F.col("later"), ";").otherwise(","))
    cover = met.select(
        *key, "times", "common", F.when(F.col("of_a"), mark).alias("a"), F.when(~F.col("of_a"), mark).alias("b"),
        F.last(F.when(F.col("of_a"), F.col("id")), True).over(running).alias("la"), F.last(F.when(~F.col("of_a"), F.col("id")), True).over(running).alias("lb"),
    )
    # rows of a segment are together and in order, lists keep it: there is no exchange since the sort
    gathered = cover.groupBy(*key).agg(
        F.first("times").alias("times"), F.count("a").cast("int").alias("n_a"),
        F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list(F.when(~F.col("common"), F.struct("la", "lb"))).alias("links"),
    )
    # the mark of a segment's last token leaves an empty group on both sides, which is cut off again
    by_group = lambda c: F.split(F.array_join(F.reverse(c), ""), ";")
    shown = F.expr("rtrim(';|', shown)")
    gathered = gathered.withColumn("shown", F.array_join(F.zip_with(by_group("a"), by_group("b"), lambda x, y: F.concat(x, F.lit("|"), y)), ";"))
    with _by_sorting(encoded.sparkSession):
        each = written(gathered.select(*key, "times", "n_a", shown.alias("groups"), "links"), "segments")
    settle(encoded.sparkSession)  # what the shuffles so far have left on disk is of no more use
    pair = ["la", "lb"]
    counts = each.select("times", F.inline("links")).groupBy(*pair).agg(F.sum("times").alias("linked"))
    best = F.max("linked").over(Window.partitionBy("lb"))
    counts = written(counts.select(*pair, "linked", (F.col("linked") == best).cast("int").alias("best")), "counts")
    # rows of a segment stay together where the counts go to them; beyond the bound they meet by shuffle
    near = F.broadcast(counts) if counts.count() <= BROADCAST else counts
    sums = each.select(*key, F.inline("links")).join(near, pair).groupBy(*key).agg(F.sum("best").cast("int").alias("n_best"), F.sum("linked").alias("count_sum"))
    found = written(each.select(*key, "groups", "n_a").join(sums, key), "found")
    forget(each)
    settle(encoded.sparkSession)
    return found


@contextlib.contextmanager
def _by_sorting(spark: SparkSession):
    """Lists are aggregated over sorted rows as they come, not in a hash table that would sort them again."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
