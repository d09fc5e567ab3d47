import hashlib

import corpus_pipeline
import pytest
from brute import Fingerprints, contaminated, fair_queue, near_groups, typed, words
from pyspark.sql import functions as F

from shardwright.llm import decontaminate, fingerprint, mixing, queries
from shardwright.llm.components import components
from shardwright.llm.ngram_join import bands_for, ngram_join


def test_join_matches_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = near_groups([r.text for r in rows])
    got = {r.doc_id: r for r in queries.op10_ngram_join(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r.doc_id].class_id, got[r.doc_id].n_links) == (rows[want[i][0]].doc_id, want[i][1])


def test_join_large_bucket_in_blocks(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k + 1 :]) for k in range(0, 120)] + ["other words here " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_groups(texts)
    for block in (16, 512):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(docs, block=block).collect()}
        assert got == want


def test_join_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (4, "A  b"), (None, "a b"), (5, "x y z"), (6, "q " * 50_000), (7, "q " * 50_001)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string")
    got = sorted(((r.doc_id is None, r.doc_id, r.class_id, r.n_links) for r in ngram_join(docs).collect()), key=str)
    assert got == sorted([(False, 1, 1, 0), (False, 2, 2, 0), (False, 3, 3, 3), (False, 4, 3, 3), (False, 4, 3, 3), (True, None, 3, 3), (False, 5, 5, 0), (False, 6, 6, 1), (False, 7, 6, 1)], key=str)
    assert ngram_join(docs.limit(0)).count() == 0
    assert bands_for(0.8, 0.9999) > bands_for(0.8, 0.9) and bands_for(1.0, 0.9) == 1


def test_join_rows_without_ids(spark):
    import time

    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text of its own with number "), F.col("id") % 10_000, F.lit(" and some more words after it all")).alias("text"))
    began = time.time()
    got = ngram_join(docs).groupBy("class_id", "n_copies", "n_links").count().collect()
    assert [tuple(r) for r in got] == [(None, 2, 1, 20_000)] and time.time() - began < 120


def test_join_recall_of_planted_copies(spark):
    """Pairs at or above the similarity that the join finds, of those that there are."""
    import random

    rng, texts = random.Random(8), []
    for g in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(2, 5)):
            w = base[:]
            for _ in range(len(w) // 90):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    want = near_groups(texts)
    got = {r.doc_id: r.n_links for r in ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(n for _, n in want.values()) > 400
    assert sum(got.values()) == sum(n for _, n in want.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 150), (200, 160), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 160: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "If Alice buys 12 apples for 3 dollars each and sells 5 apples to Bob then how much money has Alice left"
LONG = "unrelated opening words about the weather and the sea that go on for some time before anything else"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "one two"), (6, "seven plain tiny words")], "item_id long, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"{LONG}. {ITEM}. {LONG}", (1, 0)),
        (f"{LONG}. {ITEM.replace('Alice', 'Carol').replace('12', '44').replace('5', '9')}. {LONG}", (1, 3)),
        (f"{LONG}. {ITEM.replace('Alice', 'Carol', 1)}. {LONG}", None),  # Alice is two people
        (f"{LONG}. {LONG.upper()}", None),
        ("so seven plain tiny words here", (6, 0)),
        (None, None),
        ("", None),
    ],
)
def test_templates(spark, items, text, want):
    got = decontaminate.contaminated(spark.createDataFrame([(1, text, 0)], "doc_id long, text string, mark int"), items).collect()
    assert [(r.item_id, r.n_changed) for r in got] == ([want] if want else [])


TWICE = "A farmer has 40 sheep and buys 12 goats for 9 coins each then sells 40 eggs and keeps the rest for winter"


@pytest.mark.parametrize(
    ("item", "text", "want"),
    [
        (ITEM, ITEM.replace("5", "7").replace("for 3", "for 7"), [2]),  # two values became the same
        (TWICE, TWICE.replace("40 eggs", "41 eggs"), [0, 1]),  # one of two equal numbers changed
        (TWICE, TWICE.replace("40 sheep", "77 sheep").replace("12 goats", "8 goats"), [1, 2]),
        (TWICE, TWICE.replace("40", "61"), [1]),
    ],
)
def test_slots_in_conflict_cost_their_windows(spark, item, text, want):
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(1, f"{LONG}. {text}. {LONG}")], "doc_id long, text string"), items).collect()
    assert len(got) == 1 and got[0].coverage > 0.6 and got[0].n_changed in want


def test_contamination_matches_brute_force(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    flat = {i: f" {' '.join(words(t))} " for i, t in docs.items()}
    whole = {(d, i) for i, t in bench.items() for d, x in flat.items() if f" {' '.join(words(t))} " in x}
    assert whole <= got
    for d, i in got - whole:  # near copies share most words in a row
        own, item = words(docs[d]), words(bench[i])
        grams = {tuple(own[k : k + 3]) for k in range(len(own) - 2)}
        assert sum(tuple(item[k : k + 3]) in grams for k in range(len(item) - 2)) > 0.4 * len(item)


def test_items_in_other_capitals(spark, sf_dir):
    """Every item of the benchmark as it is, in capitals, in lower case and as a title, in the midst of usual text."""
    items = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/benchmark.parquet")
    around = "The usual text of Anna goes on here. It says little, as texts do. "
    rows = [(4 * r.item_id + i, around + f(r.text) + ". " + around) for r in items.collect() for i, f in enumerate((str, str.upper, str.lower, str.title))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert len(rows) > 100 and not [i for i, _ in rows if (i, i // 4) not in got]
    clean = spark.createDataFrame([(1, around.upper() * 9), (2, around.lower() * 9), (3, around.title() * 9), (4, ""), (5, None)], "doc_id long, text string")
    assert decontaminate.contaminated(clean, items).count() == 0


def _cut(text, *at):
    w = text.split()
    return [" ".join(w[a:b]) for a, b in zip((0, *at), (*at, len(w)))]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (". ".join([*reversed(_cut(ITEM, 5, 10, 15)), LONG]), False),  # in reverse order
        (f" {LONG} {LONG} ".join(_cut(ITEM, 5, 10, 15)), False),  # scattered
        (ITEM.replace("Alice", "Carol", 1).replace("dollars", "shiny dollars"), False),  # two people, a word between them
        (ITEM.replace("Alice", "Carol").replace("12", "44").replace("3 dollars each", "3 dollars for each").replace("how much", "then how much"), True),
        (f"{ITEM.replace('Alice', 'Carol', 1)}. {LONG} {LONG}. {ITEM}", True),  # the second is whole
    ],
)
def test_passages(spark, text, found):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame([(1, f"{LONG}. {text}. {LONG}")], "doc_id long, text string"), items).collect()
    assert len(got) == found


def test_contamination_rules_match_plain_ones(spark, sf_dir):
    import random

    sf_dir, rng = sf_dir.replace("0.001", "0.01"), random.Random(4)
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()} | {1000: ITEM, 1001: TWICE, 1002: "so very few words", 1003: "one two", 1004: "the the the the the the the the end", None: "an item that has no number of its own at all"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000}
    items = [*bench.values()]
    for i in range(250):
        w = [x for _ in range(rng.randint(1, 3)) for x in rng.choice(items).split()]
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, rng.choice(["red", "7", "Bob"])), lambda: w.pop(at) if len(w) > 1 else None, lambda: w.__setitem__(at, rng.choice(["9", "Zoe", "blue", "kg"])), lambda: w.extend(w[at : at + 9])])()
        if rng.random() < 0.2:
            a, b = sorted(rng.sample(range(len(w) + 1), 2))
            w = w[b:] + w[a:b] + w[:a]
        docs[5000 + i] = " ".join(w)
    docs[6000] = "the " * 9000
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_slots, r.n_changed) for r in decontaminate.contaminated(rows, spark.createDataFrame(list(bench.items()), "item_id long, text string")).collect()}
    grams = {i: {x for x, _ in typed(t, decontaminate.UNITS)} for i, t in bench.items()}
    n = 0
    for d, t in docs.items():
        have = {x for x, _ in typed(t[:5000], decontaminate.UNITS)}
        for i, item in bench.items():
            want = contaminated(t[:5000], item, decontaminate.UNITS) if len(grams[i] & have) >= 0.3 * len(grams[i]) else None
            n += want is not None
            mine = got.get((d, i))
            if want and want[3]:  # two values of as many windows: either may stay
                assert mine and abs(mine[0] - want[0]) < 0.3
            else:
                assert mine == (want[:3] if want else None), (t[:300], item)
    assert n > 200


def test_decontaminated_keeps_the_rest(spark, items):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, "fine", "b"), (None, ITEM, "c"), (None, None, "d"), (2, ITEM, "e"), (2, ITEM, "e")], "doc_id long, text string, item_id string")
    assert sorted(r.item_id for r in decontaminate.decontaminated(docs, items).collect()) == ["b", "d"]
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == 6


def _plain_features(b, rank):
    bins = fingerprint.entropy_bins(b)
    import numpy as np

    for i in range(0, len(bins), 97):
        c = np.bincount(b[i : i + 64])
        e = int((fingerprint._G[c]).sum())
        assert bins[i] == ((6 * 64 << 16) - e) * 1000 // (6 * 64 << 16)
    votes = {}
    key = [(rank[x], i) for i, x in enumerate(bins)]
    for j in range(len(bins) - 63):
        i = min(key[j : j + 64])[1]
        votes[i] = votes.get(i, 0) + 1
    return sorted(i for i, n in votes.items() if n >= fingerprint.VOTES)


def test_features_match_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    rank = fingerprint.ranks({i: int(n) for i, n in enumerate(rng.integers(0, 1000, fingerprint.BINS))})
    texts = [bytes(rng.integers(97, 97 + k, n, dtype=np.uint8)) for k, n in ((20, 3000), (3, 900), (26, 400), (5, 130), (9, 80), (9, 64), (9, 10), (1, 0))]
    b, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    h, row = fingerprint.features(b, offs, rank)
    for r, t in enumerate(texts):
        alone, _ = fingerprint.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), rank)
        assert (alone == h[row == r]).all()
        if len(t) >= 127 and (want := _plain_features(np.frombuffer(t, np.uint8), rank)):
            assert len(want) == (row == r).sum()
        assert ((row == r).sum() > 0) == (len(t) > 0)


def test_fingerprints(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), part_bytes=200_000).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for i, r in enumerate(docs):
        s, nxt, g = r.text or "", docs[(i + 1) % len(docs)].text or "", got[r.doc_id]
        q = len(s) // 4
        edited = s[: len(s) - q] + nxt[:q]
        assert (g.n_chars, g.edited_sha256) == (len(s), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(s, g.fingerprint) == g.fingerprint
        assert by_text.setdefault(edited, g.edited_fingerprint) == g.edited_fingerprint
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    long = [g for g in got.values() if g.n_chars > 800]
    assert sum(g.near_edited for g in long) / len(long) > 0.5
    assert sum(g.near_next < 0.3 for g in long) / len(long) > 0.9


def test_fingerprints_match_plain_ones(spark, sf_dir):
    rows = sorted(r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000)[:70]
    rows = [tuple(r) for r in rows] + [(9001, rows[3].text * 8), (9002, "ab" * 40), (9003, None), (9004, "short"), (9005, "é" * 70), (9006, "x" * 64)]
    plain = Fingerprints([t for _, t in rows])
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=30_000).collect()}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (plain.string(t), plain.string(edited)), i
        assert abs(got[i].near_edited - plain.likeness(t, edited)) < 1e-6 and abs(got[i].near_next - plain.likeness(t, after)) < 1e-6, i


def test_fingerprints_of_rows_of_one_id(spark):
    rows = [(None, f"text number {i} of many that have no id at all, and so on") for i in range(600)] + [(7, f"{i} " * 40) for i in range(300)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes=2000).collect()
    assert len(got) == 900 and len({r.edited_sha256 for r in got}) > 800


def test_fingerprint_odd_rows(spark):
    rows = [(None, "first"), (3, None), (3, ""), (5, "ab" * 300), (5, "ab" * 300), (9, "é" * 70_000), (12, "x")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = fingerprint.fingerprints(docs, part_bytes=1000).collect()
    assert len(got) == len(rows)
    assert [r.fingerprint for r in got if r.doc_id == 3] == ["", ""]
    last = next(r for r in got if r.doc_id == 12)
    assert last.edited_sha256 == hashlib.sha256(b"x").hexdigest()
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.edited_sha256 == hashlib.sha256(("é" * 52_500 + "x").encode()).hexdigest()
    alone = fingerprint.fingerprints(docs.where("doc_id = 12")).collect()
    assert [(r.near_next, r.n_chars) for r in alone] == [(1.0, 1)]
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_mix_targets_and_bounds(spark, sf_dir):
    got = queries.op6_source_mix(spark, sf_dir.replace("0.001", "0.01")).collect()
    per = {}
    for r in got:
        assert r.taken <= 3 * r.size
        x = per.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] += r.size
    for (size, target), (taken, sizes) in per.items():
        assert sizes == size and abs(taken - target) <= 1 and target <= 3 * size
    assert abs(sum(t for _, t in per) - sum(s for s, _ in per)) < 1e-3


def test_mix_matches_a_heap_of_sources(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 6 + ["b", "b", "c", None]), rng.choice([0, 1, 3, 40, 200])) for i in range(300)]
    docs = spark.createDataFrame([(i, "w " * n, s, 1, 2, 3) for i, s, n in rows], "doc_id long, text string, source string, begin int, target int, round int")
    got = {r.doc_id: r for r in mixing.fair_queue(docs).collect()}
    targets = {s: got[i].target for i, s, _ in rows}
    want = fair_queue(rows, targets, lambda r: (hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest(), r[0]))
    assert sum(r.taken for r in got.values()) == sum(n for *_, n in rows) or abs(sum(r.taken for r in got.values()) - sum(n for *_, n in rows)) <= 2
    assert max(abs(got[i].taken - want[i]) for i, *_ in rows) <= 1  # a word at the end, as targets are no whole numbers
    many = mixing.queued(mixing.numbered(docs, "text", "source", "doc_id")).groupBy("doc_id").agg(F.sum("taken").alias("n"))
    assert {r.doc_id: r.n for r in many.collect()} == {i: r.taken for i, r in got.items()}
    plan = mixing.numbered(docs, "text", "source", "doc_id")
    assert [r.finish for r in mixing.queued(plan).where("taken > 0").orderBy("finish").collect()][-1] >= 1


def test_mix_rows(spark):
    rows = [(1, "a b c", "s1"), (2, None, None), (3, " x  y\tz w ", None), (4, "one two three four five six", "s2"), (4, "one two three four five six", "s2"), (None, "q", "s3")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    mix = mixing.mixed(docs)
    out = mix.collect()
    assert mix.columns == ["doc_id", "text", "source", "size", "round", "taken", "finish"] and {r.size for r in out} == {1}
    assert all(len(words(r.text)) == r.taken for r in out)
    queue = mixing.fair_queue(docs).agg(F.sum("taken")).first()[0]
    assert sum(r.taken for r in out) == queue
    assert mixing.mixed(docs.limit(0)).count() == 0
    empty = mixing.fair_queue(docs.withColumn("text", F.lit(" "))).collect()
    assert all((r.taken, r.target) == (0, 0.0) for r in empty)


def test_pipeline_stages(spark, sf_dir):
    """Each stage against what it should have done with its own input."""
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        assert name == "source_mix" or docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs)
    ids = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    before, after = map(ids, seen["language_id"])
    assert all(not any(c.isalpha() for c in before[i] or "") for i in before if i not in after) or len(after) > 0.97 * len(before)
    before, after = map(ids, seen["near_duplicates"])
    order = sorted(before)
    groups = near_groups([before[i] for i in order])
    assert set(after) == {order[g] for g, _ in groups.values()}
    before, after = map(ids, seen["decontamination"])
    bench = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = {i for i, t in before.items() if any(f" {b} " in f" {' '.join(words(t))} " for b in bench)}
    assert held and not held & set(after) and len(before) - len(after) <= len(held) * 1.2 + 1
    before, after = map(ids, seen["secret_scan"])
    assert set(before) == set(after) and any(before[i] != after[i] for i in after)
    mix = seen["source_mix"][1]
    assert mix.count() > 0 and mix.columns[: len(columns)] == columns
    assert [r.finish for r in mix.collect()] == sorted(r.finish for r in mix.collect())


def test_pipeline_with_clashing_columns(spark, sf_dir, tmp_path):
    names = ["lang_pred", "score", "rejected", "node", "class_id", "mark", "_id", "spans", "row", "taken", "size", "target", "begin"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({n: F.lit(n) for n in names})
    none = docs.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    docs.limit(60).unionByName(none).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "round", "finish"]
    assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(names)}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
