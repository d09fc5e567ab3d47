"""Alignment of tokenizers against whole texts encoded at once and plain loops over byte offsets."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from shardwright.llm import token_align

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tool():
    with open(f"{token_align.TOKENIZERS}/{token_align.BYTE_LEVEL}", "rb") as f, open(f"{token_align.TOKENIZERS}/{token_align.PIECES}", "rb") as g:
        return token_align.Tokenizers(f.read(), g.read())


def spans(ids, of):
    ends = list(itertools.accumulate(len(of[i]) for i in ids))
    return list(zip(ids, [0, *ends[:-1]], ends, strict=True))


def plain(tool, texts):
    """Results of all texts, by definition."""
    links, shown, sizes = [], [], []
    for text in texts:
        a, b = (tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        if not text or b"".join(tool.bytes_a[i] for i in a) != want or b"".join(tool.bytes_b[i] for i in b) != want:
            links.append([]), shown.append(None), sizes.append((0, 0, 0))
            continue
        sa, sb = spans(a, tool.bytes_a), spans(b, tool.bytes_b)
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups = [([i for i, _, e in sa if lo < e <= hi], [i for i, _, e in sb if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        shown.append(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
        links.append([(i, j) for i, s, e in sa for j, t, f in sb if s < f and t < e])
        sizes.append((len(a), len(b), len(groups)))
    count = Counter(itertools.chain(*links))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [
        (*n, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), "" if g is None else hashlib.sha256(g.encode()).hexdigest())
        for x, g, n in zip(links, shown, sizes, strict=True)
    ]


def test_all_documents_match_plain_loops(spark, sf_dir, tool):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    short = [(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 3000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in short], "doc_id long, text string, id string, block int")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_align.aligned(docs.repartition(3)).collect()}
    want = plain(tool, [t for _, t in short])
    assert len(short) > 100 and got == {i: w for (i, _), w in zip(short, want, strict=True)}


def test_query_columns_and_whole_texts(spark, sf_dir, tool):
    df = __spark_entry__.queries()["op13_token_alignment"](spark, sf_dir)
    assert [f.simpleString() for f in df.schema.fields] == ["doc_id:bigint", *(f"{c}:bigint" for c in COLUMNS[:-1]), "groups_sha256:string"]
    got = {r["doc_id"]: (r["n_a"], r["n_b"]) for r in df.collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got == {r["doc_id"]: (len(tool.a.encode(" " + r["text"]).ids), len(tool.b.encode(r["text"]))) if r["text"] else (0, 0) for r in rows}


def test_odd_texts(spark, tool):
    texts = [None, "", " ", "   ", "a", "  a  b ", "a▁b", "▁", "<s>", "</s> <|endoftext|> <unk>", "x\n y\t z", "  　 x", "日本語 の テキスト", "😀 👩‍👩‍👧 é é", "\x00 \x00", "word " * 3000, "q" * 5000, "ab" * 3000 + " c", "the the the", "the the the"]
    docs = spark.createDataFrame([(None if i % 7 == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in token_align.aligned(docs).collect()), key=str)
    assert got == sorted(plain(tool, texts), key=str)
    assert token_align.aligned(docs.limit(0)).count() == 0
    assert token_align.aligned(docs.where(F.col("text").isNull())).collect()[0]["groups_sha256"] == ""


def test_blocks_of_a_few_bytes(spark, tool, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK", 40)
    monkeypatch.setattr(token_align, "SEGMENTS", 5)
    texts = [f"some words of text {i % 5} and more, unlikely: zyx{i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_align.aligned(docs).collect()}
    assert got == dict(enumerate(plain(tool, texts)))


def test_rows_go_to_blocks_packed(spark, tool, monkeypatch):
    rows = pa.record_batch({"id": pa.array([1, None, 3, 4] * 500), "text": pa.array(["some words", None, "", "more"] * 500), "block": pa.array([7, 8, 7, 1 << 40] * 500)})
    packs = list(token_align._packed(iter([rows.slice(0, 0), rows.slice(0, 999), rows.slice(999)])))
    assert [p.column("block").to_pylist() for p in packs] == [[7], [8], [1 << 40]] and sum(p.nbytes for p in packs) < rows.nbytes / 4
    got = [tuple(r.values()) for p in packs for r in token_align._unpacked(pa.Table.from_batches([p])).to_pylist()]
    assert got == [(1, "some words"), (3, "")] * 500 + [(None, None)] * 500 + [(4, "more")] * 500
    assert not list(token_align._packed(iter([rows.slice(0, 0)])))
    for name, size in (("BLOCK", 300), ("PACK", 200)):
        monkeypatch.setattr(token_align, name, size)
    texts = [None, "", "a▁b", *(f"text {i % 5} of some, unlikely: zyx{i}" for i in range(40))]
    df = token_align.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()} == dict(enumerate(plain(tool, texts)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t ab1,.'é日▁ 　 \u0085\x1c", "the", "'s", "<s>", "ing", "😀", "​"]), max_size=14).map("".join))
def test_segments_are_what_whole_texts_give(tool, text):
    if text and all(tool.whole(s) for s in tool.segments(text)):
        (_, lists), = token_align.split(pa.array([text]), tool.cuts)
        assert lists.to_pylist() == [tool.segments(text)]
        a, b = tool.encode(tool.segments(text))
        assert [i for x in a for i in x] == tool.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in b for i in x] == tool.b.encode(text)
    else:
        back = b"".join(tool.bytes_b[i] for i in tool.b.encode(text))
        assert not text or back != (" " + text).encode()


def test_every_character_comes_back_or_has_no_tokens(tool):
    every = [chr(c) for c in [*range(0x3000), *range(0xF000, 0x10100), *range(0x1F300, 0x1F700)]]
    fine = [c for c in every if tool.whole("a" + c) and tool.whole(c)]
    assert len(every) - len(fine) <= 2
    tool.encode([s for c in fine for s in tool.segments("a" + c + " b")])
