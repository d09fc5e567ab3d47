import hashlib
import json
import math
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from shardwright.llm import chat_format, license_scan, queries, secrets, url_filter

CONTROL = ["<|im_start|>", "<|im_end|>\n", "<|\\im_end|>", "<|\\\\im_start|>", "<|im_end", "im_end|>", "&n", "&a\n", "\\", "<|", "$1", "", " x\ny "]


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(c, i, role, a + b) for c, a in enumerate(CONTROL) for i, (b, role) in enumerate(zip(CONTROL, ["user", "assistant", "a\nb", "<|im_end|>", None, "&n"] * 3))]
    rows += [(99, None, "assistant", None), (99, 1, "assistant", "x" * 200_000), (None, 1, "user", "hi")]
    df = chat_format.formatted(chat_format.turns_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in df.withColumn("t", chat_format.read_back(F.col("formatted"), F.col("mask"))).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((x[1] if x[1] is not None else -1), x[2] or "", x[3] or "") for x in rows if x[0] == c)
        assert [(t.role, t.text) for t in got[c].t] == [(r, t) for _, r, t in want]
        assert [t.masked for t in got[c].t] == [t if r == "assistant" else None for _, r, t in want]
        assert got[c].formatted.count("<|im_end|>") == len(want) == got[c].formatted.count("<|im_start|>")


def test_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op2_chat_format(spark, sf_dir).collect()}
    convs = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), _sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), _sha(loss))


def test_chat_layouts(spark):
    ask, answer = "why\n?", "be{c}ause"
    records = [
        {"messages": [{"role": "user", "content": ask}, {"role": "assistant", "content": answer}]},
        {"id": 3, "messages": [{"content": ask, "role": "user"}, {"content": answer, "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": ask}, {"from": "gpt", "value": answer}]},
        {"instruction": ask, "output": answer},
        {"instruction": "why", "input": None, "output": answer},
        {"prompt": ask, "completion": answer},
        {"prompt": ask, "response": answer},
        {"question": ask, "answer": answer},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "why"}, {"type": "text", "text": "?"}]}, {"role": "assistant", "content": [{"type": "text", "text": answer}]}]},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, "{"), (51, '{"other": 1}'), (52, None)]
    got = {}
    for r in chat_format.turns_of_payloads(spark.createDataFrame(rows, "conv_id long, payload string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.layout))
    for i in range(len(records)):
        assert [x[1] for x in got[i]] == ["why" if i == 4 else ask, answer] and [x[0] for x in got[i]] == ["user", "assistant"], i
    assert all(got[i] == [(None, None, None)] for i in (50, 51, 52))
    with pytest.raises(ValueError):
        chat_format.turns_of_rows(spark.createDataFrame([(1, "x")], "a int, b string"))
    assert chat_format.formatted(chat_format.turns_of_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def _plain_base(text):
    kinds = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in re.finditer(p, text, re.A) if len(m[g]) >= least)


ODD = ["", None, "password: token: abcdefgh", "TOKEN='abc' secret == x.y.z-12", "é AKIA" + "B" * 16 + " ü " + "AKIAAKIA" + "1" * 12, "apikey=" + "a" * 24, "f" * 30_000, "ſecret=abcdefgh toKen=abcdefgh", "api_key : \"q+w/e_r.t=y-\" " * 500, "deadbeef" * 2 + "g" + "0123456789abcdef" * 2 + "AKIA" + "X" * 15]


def test_base_secrets_match_brute_force(spark, sf_dir):
    rows = [r.text for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("text").collect()] + ODD
    docs = spark.createDataFrame([(i, t, f"s{i % 5}", "x") for i, t in enumerate(rows)], "doc_id long, text string, source string, spans string")
    got = {r.doc_id: r for r in secrets.scanned(docs).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        base = [(x.start, x.rank, x.end, secrets.KINDS[x.rank]) for x in got[i].findings if x.rank < 3]
        assert base == _plain_base(t or ""), (i, (t or "")[:80])


def test_secret_query_columns(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op8_secret_scan(spark, sf_dir).collect():
        base = _plain_base(text[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert r.base_sha256 == _sha(",".join(f"{n}:{s}:{e}" for s, _, e, n in base))
        assert r.n_live + r.n_example == (r.spans.count(",") + 1 if r.spans else 0)


def test_ownership_tells_examples_from_live(spark):
    own, copied = "gh" + "p_" + "a1B2" * 9, "gh" + "p_" + "Zz00" * 9
    rows = [(1, f"key {own} here", "a"), (2, own, "a")] + [(10 + i, f"see {copied}", f"s{i}") for i in range(5)] + [(30 + i, f"token={copied}", f"s{i}") for i in range(3)]
    docs = spark.createDataFrame(rows + [(None, None, None), (40, f"x {own} token={own} y", "a"), (40, f"x {own} token={own} y", "a")], "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = [(r.doc_id, [(secrets.KINDS[x.rank], x.live) for x in r.findings]) for r in secrets.scanned(docs).collect()]
    kinds = dict(got)
    assert kinds[1] == [("github", True)] == kinds[2]
    assert all(kinds[10 + i] == [] for i in range(5))
    assert all(kinds[30 + i] == [("assign", False)] for i in range(3))
    assert len(got) == len(rows) + 3 and kinds[None] == []
    clean = [(r.doc_id, r.text, r.n_chars) for r in secrets.redacted(docs).collect()]
    assert (1, "key [github] here", 17) in clean and (10, f"see {copied}", 44) in clean and (None, None, None) in clean
    assert [x[1] for x in clean if x[0] == 40] == ["x [github] [assign] y"] * 2
    assert secrets.scanned(docs.limit(0)).count() == 0 and secrets.redacted(docs.limit(0)).count() == 0


def test_value_copied_within_one_source(spark):
    common, copied = "gh" + "p_" + "Qq11" * 9, "gh" + "p_" + "Rr22" * 9
    rows = [(i, f"page {i} says {common}", "hot") for i in range(40)] + [(100 + i, f"page {i} has token={common}", "hot") for i in range(3)]
    rows += [(200 + i, f"one text, many copies: {copied}", "hot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: [(secrets.KINDS[x.rank], x.live) for x in r.findings] for r in secrets.scanned(docs).collect()}
    assert all(got[i] == [] for i in range(40)) and all(got[100 + i] == [("assign", False)] for i in range(3))
    assert all(got[200 + i] == [("github", True)] for i in range(40))
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert all(clean[i] == t for i, t, _ in rows if i < 200) and all(clean[200 + i] == "one text, many copies: [github]" for i in range(40))


def test_secrets_of_a_text_full_of_them(spark):
    own = "gh" + "p_" + "a1B2" * 9
    text = "".join(f"token=abcdef{i:06d};é\n" for i in range(60_000)) + f"{own} end"
    docs = spark.createDataFrame([(1, text, "a"), (2, f"\U0001f600 {own}", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: r.findings for r in secrets.scanned(docs).collect()}
    assert len(got[1]) == 60_001 and [(x.start, x.end) for x in got[1][:2]] == [(0, 18), (21, 39)]
    assert [(x.start, x.end, x.live) for x in got[2]] == [(2, 2 + len(own), True)]
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[1] == "[assign];é\n" * 60_000 + "[github] end" and clean[2] == "\U0001f600 [github]"


def test_marks_without_an_end_take_linear_time(spark):
    import time

    begin, end, part = "-----BEGIN RSA PRIVATE" + " KEY-----", "-----END RSA PRIVATE" + " KEY-----", "ey" + "J"
    odd = [(1, (begin + "\n") * (1_000_000 // 32)), (2, part * 333_000), (3, part * 100_000 + "." + part * 100_000), (4, (begin + "x" * 40) * 9000 + end + begin * 9000), (5, "-----BEGIN " + "A" * 1_000_000)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in odd], "doc_id long, text string, source string")
    secrets.scanned(docs.limit(0)).count()
    began = time.time()
    got = {r.doc_id: [(secrets.KINDS[x.rank], x.start, x.end) for x in r.findings] for r in secrets.scanned(docs).collect()}
    assert time.time() - began < 20, "five odd texts of a megabyte"
    assert [got[i] for i in (1, 2, 3, 5)] == [[]] * 4
    assert got[4] == [("pem", 0, len(begin + "x" * 40) * 9000 + len(end))]


def test_passed_over_parts_hold_nothing(spark):
    """Matches of both kinds in random sequences of their parts are those of the plain pattern."""
    import random

    rng = random.Random(5)
    begin, end = "-----BEGIN PRIVATE" + " KEY-----", "-----END PRIVATE" + " KEY-----"
    pieces = [begin, end, "\n", "é" * 30, "M" * 64, "ey" + "J", "abcdefgh12", ".", "-", " ", "abc", "-----BEGIN ", "PRIVATE KEY-----"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: {(secrets.KINDS[x.rank], x.start, x.end) for x in r.findings if secrets.KINDS[x.rank] in secrets.VAIN} for r in secrets.scanned(docs, max_owners=10**9, max_repositories=10**9).collect()}
    for kind, pattern, _, least, _ in secrets.MORE:
        if kind in secrets.VAIN:
            for i, t in enumerate(texts):
                want = {(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least}
                assert {x for x in got[i] if x[0] == kind} == want, (i, t)


def test_value_that_most_rows_hold(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id") % 9000, F.lit(" token=abcdefgh12")).alias("text"), F.lit("hot").alias("source"))
    got = secrets.scanned(docs).select(F.explode("findings").alias("x")).groupBy("x.live").count().collect()
    assert [(r.live, r["count"]) for r in got] == [(False, 30_000)]


def test_secret_sql(spark, sf_dir):
    import duckdb

    sf_dir = sf_dir.replace("0.001", "0.01")
    odd = [(90_000 + i, t, None if i % 3 else "s", None) for i, t in enumerate(ODD)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", F.lit(None).cast("string").alias("x")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, source string, x string"))
    con, documents = duckdb.connect(), docs.drop("x").toPandas()  # noqa: F841
    want = sorted(con.sql(f"WITH w AS ({queries.oracle_sql()['op8_secret_scan']}) SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example FROM w").fetchall())
    got = sorted((r.doc_id, *(sum(x.rank == k for x in r.findings) for k in range(3)), _sha(_listed(x for x in r.findings if x.rank < 3)), _listed(r.findings), sum(x.live for x in r.findings), sum(not x.live for x in r.findings)) for r in secrets.scanned(docs).collect())
    assert got == want


def _listed(findings):
    return ",".join(f"{secrets.KINDS[x.rank]}:{x.start}:{x.end}" for x in findings)


def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").collect()}
    rows = queries.op9_url_filter(spark, sf_dir.replace("0.001", "0.01")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = _host_path(pages[r.page_id])
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_aliases(spark):
    link = lambda u: f'<html><LINK href="{u}" rel=canonical></html>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    rows = [
        (1, "http://a.net/x", link("http://shop.com/de/1")), (2, "http://b.net/y?q=1", refresh("http://A.net/x#z")), (3, "http://c.net/", link("/other")),
        (4, "http://c.net/other", None), (5, "http://d.net/p/q", link("r")), (6, "http://d.net/p/r", refresh("http://k.org/")), (7, "http://d.net/s", refresh("//x.com/de/")),
        (8, "http://d.net/s", link("http://d.net/p/r")), (9, None, None), (10, "no url", ""), (11, "http://shop.com/de/1", ""), (11, "http://shop.com/de/1", ""), (None, "http://z.net", link("#here")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()), key=str)
    want = [(1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow"), (10, None, "allow"), (11, "com/de/", "block"), (11, "com/de/", "block"), (None, None, "allow")]
    assert got == sorted(want, key=str)
    more = spark.createDataFrame([("http://c.net/", "http://z.com/de/")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_filter.judged(pages, url_filter.rule_table(spark), more).collect()}
    assert got[3] == got[4] == "block" and got[5] == "allow"
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark)).count() == 0


def test_url_pages_that_differ_in_the_query(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://s.net/view?id=1", link("http://shop.com/de/1")), (2, "http://s.net/view?id=2#x", link("http://shop.com/fr/1")), (3, "http://s.net/view?id=3", ""), (4, "http://s.net/view", ""), (5, "http://t.net/", link("http://S.net/view?id=1#top"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.path, r.rule, r.verdict) for r in url_filter.judged(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: ("/view", None, "block"), 2: ("/view", None, "allow"), 3: ("/view", None, "allow"), 4: ("/view", None, "allow"), 5: ("/", None, "block")}


def test_license_classifier_on_unseen_variants(spark):
    import random

    rng, lines = random.Random(99), []
    for f, notices in license_scan.NOTICES.items():
        for x in notices:
            w = x.split()
            for _ in range(3):
                y = w[:]
                if len(y) > 8:
                    del y[rng.randrange(len(y))]
                lines.append((f, " ".join(["Note:", *y, "Thanks"])))
    got = {r.line: r.family for r in license_scan.classified(spark.createDataFrame([(x,) for x in {x for _, x in lines}], "line string")).collect()}
    right = sum(got[x] == f for f, x in lines)
    wrong = sum(got[x] not in (f, license_scan.UNKNOWN) for f, x in lines)
    assert right / len(lines) > 0.9 and wrong / len(lines) < 0.05
    plain = ["My driving licence is new", "a licence to print money was what they had", "Copyright reform passed the house", "This agreement grants a licence for the Foobar toolkit under the Quux terms"]
    got = {r.line: r.family for r in license_scan.classified(spark.createDataFrame([(x,) for x in plain], "line string")).collect()}
    assert not {got.get(x, "none") for x in plain} & set(license_scan.NOTICES)


def test_license_features_agree(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "  .. a . b.c. d+e (MIT)", "x", "GPL", "SPDX-License-Identifier: GPL-2.0-only"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", license_scan._features(F.col("line")).alias("f"))
    for r in df.collect():
        assert set(r.f) == license_scan.features(r.line)


def test_license_rows(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op4_license_scan(spark, sf_dir.replace("0.001", "0.01")).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert set(got) == set(docs)
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General Public": "GPL", "CC BY-NC": "CC-BY-NC"}
    for i, t in docs.items():
        want = {f for k, f in names.items() if k in t}
        assert want <= set(got[i].families.split(",")) or not want, (i, got[i])
        if not re.search(license_scan.CUE, t):
            assert got[i].families == "" and got[i].n_notices == 0
    odd = [(1, None), (2, ""), (3, "GPL\n\nlicensed under the GPL v2 or later\nReleased under the MIT License."), (None, "word " * 100_000 + "licence"), (3, "x")]
    out = license_scan.license_scan(spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, lines int")).collect()
    assert len(out) == 5 and sorted(r.families for r in out if r.doc_id == 3) == ["", "GPL,MIT"]
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_scan_of_lines_without_usual_words(spark):
    lines = [(f, x) for f, notices in license_scan.NOTICES.items() for x in notices]
    lines += [("LGPL", "This library is LGPL v2.1"), ("AGPL", "Distributed under AGPLv3"), ("BSD", "Released under BSD 3-Clause"), ("MIT", "Code: MIT"), ("Proprietary", "All rights reserved.")]
    lines += [(f, f"Note: {x} Thanks") for f, x in lines if len(x.split()) > 8]
    lines += [("MIT", "documentation files (the \"Software\"), to deal in the Software without restriction,"), ("GPL", "it under the terms of the GNU General Public License as published by")]
    docs = spark.createDataFrame([(i, f"some words\n{x}\nund mit ihm") for i, (_, x) in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.license_scan(docs).collect()}
    assert [(x, got[i]) for i, (f, x) in enumerate(lines) if got[i] != f] == []
    plain = spark.createDataFrame([(i, x) for i, x in enumerate(["Er kam mit ihr.", "Mit wem?", "That is so.", "see this file", "one of us or all"])], "doc_id long, text string")
    assert [r.n_notices for r in license_scan.license_scan(plain).collect()] == [0] * 5


def test_license_lines_left_out_are_none(spark, sf_dir):
    import random

    rng, held = random.Random(5), set(license_scan.anchors())
    _, weights, *_ = license_scan.trained()
    free = sorted({x for f in weights for x in f.split(" ")} - held)
    lines = {" ".join(rng.choices(free, k=rng.randint(1, 12))) for _ in range(2000)} | {f for f in weights if not held & set(f.split(" "))}
    got = license_scan.classified(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert got.where(F.col("family") != "none").count() == 0


def _plain_family(line):
    """The verdict on a paragraph, from the trained weights alone."""
    import numpy as np

    families, weights, bias, heat, (sure, similar) = license_scan.trained()
    found = license_scan.features(line)
    known = [weights[f] for f in sorted(found) if f in weights]
    if not known and not found & set(license_scan.worths()):
        return "none"
    z = (sum(known, np.zeros(len(families))) / math.sqrt(max(len(known), 1)) + bias) * heat
    k, p = int(z.argmax()), 1 / np.exp(z - z.max()).sum()
    if families[k] == "none":
        return "none"
    if families[k] == "unknown" or p < sure or license_scan.likeness(found, families[k], license_scan.worths()) < similar:
        return "unknown"
    return families[k]


def _plain_complete(line, family):
    of = lambda x: sum(license_scan.worths().get(f, 1.0) for f in x)
    mine = license_scan.telling(license_scan.features(line))
    notices = [license_scan.telling(license_scan.features(x)) for x in license_scan.NOTICES[family]]
    return max(of(mine & x) / of(x) for x in notices) >= license_scan.trained()[4][1]


def _plain_scan(text):
    """[(number, family)] of a text, paragraph by paragraph."""
    out, lines = [], [x.rstrip(" \t\r") if re.search("[A-Za-z0-9]", x) else "" for x in text.split("\n")]
    i = 0
    while i < len(lines):
        j = i
        while j + 1 < len(lines) and lines[j] and lines[j][-1] not in ".!?:;" and lines[j + 1]:
            j += 1
        whole = _plain_family(" ".join(x for x in lines[i : j + 1]))
        own = [(n + 1, f) for n in range(i, j + 1) if (f := _plain_family(lines[n])) != "none"] if j > i else []
        if whole != "none" and not any(f not in ("unknown", whole) and _plain_complete(lines[n - 1], f) for n, f in own):
            out.append((min([n for n, f in own if f == whole != "unknown" and _plain_complete(lines[n - 1], f)], default=i + 1), whole))
        else:
            out += own
        i = j + 1
    return out


def test_license_scan_matches_plain_scorer(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    notices = [x for lines in license_scan.NOTICES.values() for x in lines] + license_scan.OTHER
    wrapped = ["\n".join(textwrap.wrap("# start. " + x, w)) for x in notices for w in (24, 45, 60, 79)]
    docs += [(100_000 + i, f"{x}\n\n{y}\n{x}") for i, (x, y) in enumerate(zip(wrapped, wrapped[7:] + wrapped[:7]))]
    got = {r.doc_id: r.lines for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        assert got[i] == ",".join(f"{n}:{f}" for n, f in _plain_scan(t or "")), (i, t[:200])


def test_license_paragraphs(spark):
    mit = license_scan.NOTICES["MIT"][-2]
    gpl = license_scan.NOTICES["GPL"][1]
    texts = {
        "\n".join(textwrap.wrap(mit, 70)): ["MIT"], "code\n" + "\n".join("# " + x for x in textwrap.wrap(gpl, 72)) + "\n#\n# more": ["GPL"], "\n".join(" * " + x for x in textwrap.wrap(license_scan.NOTICES["ISC"][0], 60)): ["ISC"],
        "European Union Public Licence v1.2": ["EUPL"], "Licensed under the Eclipse Public License 2.0.": ["EPL"], "a long line of prose that has no end of its own here and goes on\nReleased under the MIT License.": ["MIT"],
    }
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [x.split(":")[1] for x in r.lines.split(",")] for r in license_scan.license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    strange = ["Licensed under the Quux Public License 3.0.", "Licensed under the Mulan Permissive Software License, Version 2.", "SPDX-License-Identifier: Quux-1.0", "This work is licensed under the Frobnitz License, version 9.", "Distributed under the Grue License.", "Released under the terms of the Zork Software Licence."]
    got = license_scan.license_scan(spark.createDataFrame([(i, x) for i, x in enumerate(strange)], "doc_id long, text string")).collect()
    assert [(strange[r.doc_id], r.families) for r in got if r.families] == [] and sum(r.n_unknown for r in got) >= 5


def test_license_paragraphs_at_any_width(spark):
    notices = [(f, license_scan.NOTICES[f][i]) for f, i in (("MIT", -2), ("GPL", 1), ("BSD", 0), ("ISC", 0), ("LGPL", 0))]
    odd = [("  // ", 30), ("", 15), ("\t* ", 25), ("# ", 38), ("", 200)]
    docs = [(100 * i + k, "An end.\n" + "\n".join(lead + y + " \r" for y in textwrap.wrap(x, w))) for i, (_, x) in enumerate(notices) for k, (lead, w) in enumerate(odd)]
    got = {r.doc_id: r.families for r in license_scan.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {100 * i + k: f for i, (f, _) in enumerate(notices) for k in range(len(odd))}


def test_license_versions_and_qualifiers(spark):
    texts = {
        "Licensed under the Apache License 1.1": "", "This file is under the Apache License, Version 1.1.": "", "License: Apache 2.0": "Apache-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA", "CC BY-NC-SA 4.0": "CC-BY-NC-SA", "CC BY-NC 4.0": "CC-BY-NC",
        "Licensed under CC BY-ND 4.0": "CC-BY-ND", "Released under Apache 2.0": "Apache-2.0", "All rights reserved.": "Proprietary", "Lizenziert unter der MIT-Lizenz.": "MIT", "Er kam mit der Lizenz.": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in license_scan.license_scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts


def test_license_line_of_most_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("x"), F.col("id") % 1000, F.lit("\nReleased under the MIT License.")).alias("text"))
    assert [(r.lines, r["count"]) for r in license_scan.license_scan(docs).groupBy("lines").count().collect()] == [("2:MIT", 20_000)]


def test_url_links_with_dots_and_hubs(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://a.com/x/y/z", link("../../de/1")), (2, "http://a.com/x/y/z2", link("./w/../q?p=../r")), (3, "http://b.net/k", "<meta http-equiv=refresh content=0;url=/a/b/../c>"), (4, "http://b.net/m", link("/..")), (5, "http://b.net", link("d/.."))]
    got = {r.from_url: r.to_url for r in url_filter.links_of(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"http://a.com/x/y/z": "http://a.com/de/1", "http://a.com/x/y/z2": "http://a.com/x/y/q?p=../r", "http://b.net/k": "http://b.net/a/c", "http://b.net/m": "http://b.net/", "http://b.net": "http://b.net/"}
    hub = [(i if i % 3 else None, f"http://h{i}.net/", link("http://shop.com/de/1")) for i in range(2000)] + [(9000 + i, f"http://c.net/{i}", link(f"http://c.net/{i + 1}")) for i in range(60)] + [(9060, "http://c.net/60", link("http://shop.com/de/2"))]
    got = url_filter.judged(spark.createDataFrame(hub, "page_id long, url string, html string"), url_filter.rule_table(spark)).groupBy("verdict").count().collect()
    assert [tuple(r) for r in got] == [("block", 2061)]
