"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units (after a number) become typed placeholders. A template window is WINDOW
typed tokens in a row, hashed; a window of fewer than LITERALS plain words keeps its words, as placeholders alone say
nothing. Documents' windows meet the benchmark's in an equi-join on the hash.

What an item's windows meet in one place of a document is a passage: as many windows as there are whose shift (place in
the document less place in the item) differs by a quarter of the item's tokens at most (BAND; two tokens at least). Of a passage the
heaviest chain counts, in which both places rise from window to window, so that neither windows in another order nor
such as stand apart add up. A chain has one map of slots: each benchmark value stands for one document value (two may
stand for the same), which holds for copies and for re-parameterised questions alike. Of a number or unit with several
values the one of most windows counts, and windows with another one are left out unless all their slots are the item's;
a name with several values makes another question of the whole passage. An item is found if the windows of one of its
passages cover COVERAGE of its tokens.

Capitals say nothing where all words have them (headlines, texts in capitals) and where none has one over CALM tokens or
a whole text (lower case). Windows there are looked up once more, as plain words whatever their case, among the items'
plain windows. What they cover counts by itself, if a word of the passage has another case than in the item: a copy in
other capitals is found so, one in the same capitals is a matter of templates and slots. Text as it is usually written,
with a capital now and then, has few such windows.

Two things keep common phrases from pairing all documents with all items. A bitmap of the benchmark's hashes, BITMAP
bits at every size, drops document windows that can't match before the shuffle; where a huge benchmark fills it, more
rows reach the join and the result is the same. And documents and items are paired by the items' rarer windows only:
an item that is found shares so many windows that the few commonest can't be all of them (seeds()); all windows of the
pairs are then compared. Items of the same text are one item, that of the least id.

Defined cases: null texts count as empty; items of fewer than SHORTEST tokens are left out, as they say too little, items
of fewer than WINDOW are one window; rows of a null or repeated doc_id are told apart by their text; an empty table on
either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm import kernel as K
from shardwright.llm.shared import written

WINDOW = 5
SHORTEST = 4
LITERALS = 2
CALM = 20
COVERAGE = 0.5
BAND = 4
BITMAP = 1 << 24
#: Unit names and signs that count as units after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kmh kph hz khz mhz ghz w kw mw v a pa kpa bar j kj cal kcal usd eur gbp dollar dollars cent cents euro euros pound pounds percent degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeters inches inch feet foot yards miles mile gram grams kilogram kilograms liter liters litre litres".split()
_MUL = np.uint64(0x9E3779B97F4A7C15)
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TOKEN = _DIGIT.copy()
_TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_POINT = np.zeros(256, bool)
_POINT[[44, 46]] = True
_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        data, offs = K.utf8(pa.array(UNITS))
        _units.append(np.sort(K.span_hash(data, offs[:-1], offs[1:])))
    return _units[0]


def _small(part: np.ndarray) -> np.ndarray:
    """Bytes in lower case, accented Latin letters of two bytes too."""
    low = K.LOWER[part]
    at = np.flatnonzero(part[:-1] == 0xC3) + 1
    big = at[(part[at] >= 0x80) & (part[at] <= 0x9E) & (part[at] != 0x97)]
    low[big] |= 0x20
    return low


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all rows' tokens: typed hash, raw hash, whether it is a slot, row; the hash whatever the case, and whether the
    token is capitalised (1), not (0) or can't be told (2)."""
    typed, raw, slot, rows, flat, case = [], [], [], [], [], []
    for lo, hi in K.slices(data, offs, _TOKEN | _POINT):
        part = data[lo:hi]
        digit = _DIGIT[part]
        w = _TOKEN[part]
        if len(part) > 2:
            w[1:-1] |= _POINT[part[1:-1]] & digit[:-2] & digit[2:]
        s, e = K.word_spans(data, offs, lo, hi, w)
        if not len(s):
            continue
        h = K.span_hash(K.LOWER[part], s, e)
        row = np.searchsorted(offs, s + lo, "right") - 1
        other = np.concatenate(([0], np.cumsum(~(digit | _POINT[part]))))
        number = other[e] == other[s]
        first, second = part[s], part[np.minimum(s + 1, len(part) - 1)]
        name = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        unit = np.zeros(len(s), bool)
        after = np.flatnonzero(number[:-1] & (row[1:] == row[:-1])) + 1
        if len(after):
            u = _unit_hashes()
            at = np.minimum(np.searchsorted(u, h[after]), len(u) - 1)
            unit[after] = (u[at] == h[after]) & ~number[after]
        flat.append(K.span_hash(_small(part), s, e))
        lower = ((first >= 97) & (first <= 122)) | ((first == 0xC3) & (second >= 0x9F))
        case.append(np.where(name, 1, np.where(lower, 0, 2)).astype(np.int8))
        name &= ~unit
        t = h.copy()
        t[number], t[name], t[unit] = _NUM, _NAME, _UNIT
        typed.append(t)
        raw.append(h)
        slot.append(number | name | unit)
        rows.append(row)
    if not typed:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return tuple(np.concatenate(x) for x in (typed, raw, slot, rows, flat, case))


def plain_windows(flat: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k tokens as words whatever their case, and where they start."""
    n = len(flat) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, k + 200, np.uint64)
    for i in range(k):
        h = h * _MUL + flat[i : n + i]
    at = np.flatnonzero(row[k - 1 :] == row[:n])
    return K.mix(h[at]).view(np.int64), at


def unsaying(case: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """For each window of k tokens, whether its capitals say nothing: all words have them, or none over CALM tokens or a
    whole text around it."""
    n = len(case) - k + 1
    if n < 1:
        return np.zeros(0, bool)
    big = case == 1
    upper, lower = (np.concatenate(([0], np.cumsum(x))) for x in (big, case == 0))
    capitals, small = upper[k:] - upper[:-k], lower[k:] - lower[:-k]
    # stretches between capitals and ends of texts, and how many tokens each has
    turn = np.concatenate(([True], row[1:] != row[:-1]))
    stretch = np.cumsum(big | turn)
    size = np.bincount(stretch[~big], minlength=int(stretch[-1]) + 1)[stretch]
    calm = (size >= CALM) | (size == np.bincount(row)[row])
    return ((small == 0) & (capitals >= LITERALS)) | ((capitals == 0) & calm[:n] & calm[k - 1 :])


def windows(t: np.ndarray, raw: np.ndarray, slot: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k tokens, and where they start among all tokens."""
    n = len(t) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.concatenate(([0], np.cumsum(~slot)))
    few = plain[k:] - plain[:-k] < LITERALS
    h, r = np.full(n, k, np.uint64), np.full(n, k + 100, np.uint64)
    for i in range(k):
        h = h * _MUL + t[i : n + i]
    if few.any():
        for i in range(k):
            r = r * _MUL + raw[i : n + i]
        h = np.where(few, r, h)
    at = np.flatnonzero(row[k - 1 :] == row[:n])
    return K.mix(h[at]).view(np.int64), at


def _lists(t: np.ndarray, raw: np.ndarray, slot: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """For each window the raw hashes of its slots, odd for names and even for others, 0 for plain words."""
    values = np.where(slot, raw & ~np.uint64(1) | (t == _NAME), np.uint64(0)).view(np.int64)[at[:, None] + np.arange(k)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _cases(case: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """For each window the case of its tokens in place of slots: 1 small, 2 capital, 0 can't be told."""
    values = np.array([1, 2, 0], np.int64)[case][at[:, None] + np.arange(k)]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(values.ravel()))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items, ids, (data, offs) = batch.column(0), batch.column(1), K.utf8(batch.column(2))
        t, raw, slot, row, flat, case = tokens(data, offs)
        n = np.bincount(row, minlength=len(offs) - 1)
        first = np.cumsum(n) - n
        for k in range(SHORTEST, WINDOW + 1):
            for (h, at), family in ((windows(t, raw, slot, row, k), 0), (plain_windows(flat, row, k), 1)):
                fits = n[row[at]] == k if k < WINDOW else np.ones(len(at), bool)
                h, at = h[fits], at[fits]
                if len(at):
                    r = row[at]
                    item = pa.array(items.to_numpy()[r] & ~1 | family)
                    yield pa.RecordBatch.from_arrays([pa.array(h), item, ids.take(pa.array(r)), pa.array(at - first[r]), pa.array(n[r]), pa.array(np.full(len(at), k)), _cases(case, at, k) if family else _lists(t, raw, slot, at, k)], ["h", "item", "item_id", "ipos", "n", "k", "islots"])


def _doc_windows(bits, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for batch in batches:
            ids, marks, (data, offs) = batch.column(0), batch.column(1), K.utf8(batch.column(2))
            for lo, hi in K.runs(offs):
                t, raw, slot, row, flat, case = tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.bincount(row, minlength=hi - lo)
                first = np.cumsum(n) - n
                for k in sizes:
                    h, at = plain_windows(flat, row, k)
                    says = unsaying(case, row, k)[at]
                    for h, at, family in ((*windows(t, raw, slot, row, k), 0), (h[says], at[says], 1)):
                        b = h & (BITMAP - 1)
                        hit = np.flatnonzero(bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1)
                        if len(hit):
                            h, at = h[hit], at[hit]
                            r = row[at]
                            take = pa.array(r + lo)
                            yield pa.RecordBatch.from_arrays([pa.array(h), ids.take(take), marks.take(take), pa.array(at - first[r]), _cases(case, at, k) if family else _lists(t, raw, slot, at, k)], ["h", "doc_id", "mark", "dpos", "dslots"])

    return run


def heaviest(dpos: np.ndarray, ipos: np.ndarray, k: int) -> np.ndarray:
    """The windows, of places sorted by dpos and ipos, of the chain that covers most tokens: both places rise, and a window
    adds as many tokens as it is further on in both, k at most. Of equals that of the least change of shift, then of the
    latest window before."""
    n, shift = len(dpos), dpos - ipos
    if (shift == shift[0]).all():
        return np.arange(n)
    worth, before = np.full(n, k), np.full(n, -1)
    for j in range(1, n):
        step = np.minimum(dpos[j] - dpos[:j], ipos[j] - ipos[:j])
        value = np.where(step > 0, worth[:j] + np.minimum(step, k), 0)
        top = value.max()
        if top > k:
            at = np.flatnonzero(value == top)
            change = np.abs(shift[at] - shift[j])
            worth[j], before[j] = top, at[change == change.min()][-1]
    out, j = [], int(worth.argmax())
    while j >= 0:
        out.append(j)
        j = before[j]
    return np.array(out[::-1])


def consistent(islots: np.ndarray, dslots: np.ndarray) -> np.ndarray:
    """Which windows of a chain, rows of slots, fit one map; none if a name (its hash is odd) has several values."""
    full = islots != 0
    own = (~full | (islots == dslots)).all(1)
    if own.all():
        return own
    pairs, at, n = np.unique(np.stack((islots[full], dslots[full]), 1), axis=0, return_inverse=True, return_counts=True)
    best: dict[int, tuple] = {}
    for p, ((a, b), c) in enumerate(zip(pairs.tolist(), n.tolist())):
        if a in best and a & 1:
            return np.zeros(len(islots), bool)
        best[a] = max(best.get(a, (-1,)), (c, a == b, b, p))
    good = np.zeros(len(pairs), bool)
    good[[x[3] for x in best.values()]] = True
    fits = np.ones(islots.shape, bool)
    fits[full] = good[at.ravel()]
    return fits.all(1) | own


def passages(dpos: np.ndarray, ipos: np.ndarray, islots: np.ndarray, dslots: np.ndarray, n: int, coverage: float, until: int | None = None, reach: int | None = None, plain: bool = False) -> tuple[tuple[float, int, int] | None, int | None]:
    """Coverage, slots and changed slots of the best passage of an item of n tokens, None where none reaches the coverage,
    and the largest shift of the last passage. Passages that begin at shifts from `until` on are left out, and those
    that hold no shift beyond `reach`, as they are parts of one that was looked at. Plain windows have cases in place of
    slots: one at least has to differ, and none is counted."""
    k, wide = islots.shape[1], max(2, n // BAND)
    shift = dpos - ipos
    o = np.lexsort((dpos, shift))
    shift, dpos, ipos, islots, dslots = shift[o], dpos[o], ipos[o], islots[o], dslots[o]
    starts = np.flatnonzero(np.concatenate(([True], shift[1:] != shift[:-1])))
    ends = np.searchsorted(shift, shift[starts] + wide, "right")
    best = None
    for lo, hi in zip(starts.tolist(), ends.tolist()):
        if until is not None and shift[lo] >= until:
            break
        if reach is not None and shift[hi - 1] <= reach:
            continue
        reach = int(shift[hi - 1])
        if (hi - lo) * k < coverage * n:
            continue
        most = np.zeros(n + k, bool)
        for i in range(k):
            most[ipos[lo:hi] + i] = True
        if most[:n].sum() < (coverage * n if best is None else best[0] * n + 0.5):
            continue
        at = lo + np.lexsort((ipos[lo:hi], dpos[lo:hi]))
        at = at[heaviest(dpos[at], ipos[at], k)]
        if plain and not ((islots[at] != dslots[at]) & (islots[at] > 0) & (dslots[at] > 0)).any():
            continue
        if not plain:
            at = at[consistent(islots[at], dslots[at])]
        seen = np.zeros(n + k, bool)
        for i in range(k):
            seen[ipos[at] + i] = True
        share = int(seen[:n].sum()) / n
        if share >= coverage and (best is None or share > best[0]):
            full = islots[at] != 0
            pairs = np.unique(np.stack((islots[at][full], dslots[at][full]), 1), axis=0)
            best = (share, 0, 0) if plain else (share, len(pairs), int((pairs[:, 0] != pairs[:, 1]).sum()))
    return best, reach


def _found(coverage: float):
    """Batches of (doc_id, mark, item, item_id, n, k, dpos, ipos, islots, dslots), sorted by the first three and dpos, to
    items found. A passage ends an item's length and a band after it begins, so that much is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, best, reach = None, [], None, None

        def flush(until: int | None) -> None:
            nonlocal held, best, reach
            whole = [np.concatenate(x) for x in zip(*held)]
            got, reach = passages(*whole, key[4], coverage, until, reach, bool(key[2] & 1))
            if got and (best is None or got[0] > best[0]):
                best = got
            left = whole[0] - whole[1] >= until if until is not None else np.zeros(len(whole[0]), bool)
            held = [tuple(x[left] for x in whole)] if left.any() else []

        def result() -> list[tuple]:
            flush(None)
            return [(*key[:4], *best)] if best else []

        for batch in batches:
            out: list[tuple] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            dpos, ipos = (batch.column(i).to_numpy() for i in (6, 7))
            cuts = [0, *(r for r in range(1, len(keys)) if keys[r] != keys[r - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != key:
                    out += result() if key else []
                    key, held, best, reach = keys[lo], [], None, None
                n, k = key[4:]
                slots = [batch.column(c).slice(lo, hi - lo).flatten().to_numpy().reshape(-1, k) for c in (8, 9)]
                for a in range(lo, hi, 4096):
                    b = min(a + 4096, hi)
                    held.append((dpos[a:b], ipos[a:b], slots[0][a - lo : b - lo], slots[1][a - lo : b - lo]))
                    # a later window shifts by more than dpos - n; passages from a shift on reach a band further
                    until = int(dpos[b - 1]) - n - max(2, n // BAND)
                    if sum(len(x[0]) for x in held) > 4096 and until > int(held[0][0][0]):
                        flush(until)
            if out:
                yield _results(out)
        if key and (out := result()):
            yield _results(out)

    def _results(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out)], ["doc_id", "mark", "item", "item_id", "coverage", "n_slots", "n_changed"])

    return run


def seeds(items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(h, item) of the windows by which an item is paired with documents. An item of n tokens that is found has
    coverage x n / k of its windows' places at least in a document; all but one less than that many of its windows, those
    that most items have, are seeds, so that one of them is there."""
    common = items.select("h", "item").distinct().groupBy("h").agg(F.count("*").alias("in_items"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("in_items"), "h", "ipos"))  # the windows of one item
    ranked = items.join(common, "h").withColumn("place", place)
    return ranked.where(F.col("place") >= F.col("n") * coverage / F.col("k") - 1e-6).select("h", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per document row and item found in it: doc_id, mark (a hash of id and text), item_id, coverage (share of
    the item's tokens), n_slots (distinct values), n_changed (of them, other than in the item)."""
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    items = benchmark.where(F.length("text") > 0).groupBy("text").agg(F.min("item_id").alias("item_id")).select(F.xxhash64("text").alias("item"), "item_id", "text")
    item_type = items.schema["item_id"].dataType.simpleString()
    items = written(items.mapInArrow(K.lean(_item_windows), f"h long, item long, item_id {item_type}, ipos long, n long, k long, islots array<long>"), "item-windows")
    # at most BITMAP numbers, and as many sizes as windows can have
    found = items.select(F.col("h").bitwiseAND(F.lit(BITMAP - 1).cast("long")).cast("int").alias("b"), "k").distinct().toArrow()
    bitmap = np.zeros(BITMAP >> 3, np.uint8)
    b = np.unique(found["b"].to_numpy())
    np.bitwise_or.at(bitmap, b >> 3, np.left_shift(1, b & 7).astype(np.uint8))
    sizes = sorted(set(found["k"].to_pylist())) or [WINDOW]
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)
    mine = written(docs.mapInArrow(K.lean(_doc_windows(bits, sizes)), f"h long, doc_id {id_type}, mark long, dpos long, dslots array<long>").distinct(), "document-windows")
    pairs = mine.select("h", "doc_id", "mark").join(seeds(items, coverage), "h").select(F.struct("doc_id", "mark").alias("doc"), "item").distinct()
    windows = mine.select(F.struct("doc_id", "mark").alias("doc"), "h", "dpos", "dslots").join(pairs, "doc").join(items, ["h", "item"])
    windows = windows.select("doc.doc_id", "doc.mark", "item", "item_id", "n", "k", "dpos", "ipos", "islots", "dslots")
    dealt = windows.repartition("doc_id", "mark", "item").sortWithinPartitions("doc_id", "mark", "item", "dpos", "ipos")
    found = dealt.mapInArrow(K.lean(_found(coverage)), f"doc_id {id_type}, mark long, item long, item_id {item_type}, coverage double, n_slots long, n_changed long")
    # of an item that is found both ways, what its slots say
    best = F.min_by(F.struct("coverage", "n_slots", "n_changed"), F.col("item").bitwiseAND(F.lit(1).cast("long")))
    return found.groupBy("doc_id", "mark", F.shiftright("item", 1).alias("base"), "item_id").agg(best.alias("best")).select("doc_id", "mark", "item_id", "best.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    bad = contaminated(docs, benchmark, coverage).select(F.struct("doc_id", "mark").alias("found")).distinct()
    mine = F.struct(docs["doc_id"], F.xxhash64(docs["doc_id"], docs["text"]).alias("mark"))
    return docs.join(bad, mine == bad["found"], "left_anti")
