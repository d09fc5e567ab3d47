"""Vault behaviour on pages written as bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shardwright.config import CorpusConfig, LintConfig, StaleConfig
from shardwright.functions import frontmatter as fm
from shardwright.functions import text as tx
from shardwright.operators import gate, lint, links, nav, staleness
from shardwright.render import collection_page, eval_report, index_page, live_page
from shardwright.sources.vault import MissingVault, base_names, collection, lint_scope, read_vault


def page(name, kind="gotcha", extra="", body="Some text.\n", **over):
    f = {"name": name, "type": kind, "title": "A title", "status": "active", "updated": "2024-01-05", "volatility": "durable", "provenance": "me", "area": "infra", "tags": "[a, b]"} | over
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in f.items() if v is not None) + extra + "---\n" + body


PAGES = {
    "gotchas/clean.md": page("clean", body="See [[task-one]], [[INDEX]], [x](../tasks/task-one.md#h), `[[not]]`, <!-- [[no]] -->\n```\n[[never]]\n```\n"),
    "gotchas/_odd.md": page("other-name", title='"quoted: fine"'),
    "gotchas/.hidden.md": page("hidden"),
    "gotchas/unsafe.md": page("unsafe", title="a: b", area="mars"),
    "gotchas/crlf.md": page("crlf").replace("\n", "\r\n"),
    "gotchas/none.md": "no block here\n",
    "gotchas/dup.md": page("twin"),
    "decisions/dup.md": page("twin", "decision", updated="2024-02-31", body="[[gone]] [[gone|x]] [t](missing.md) ![i](x.png) [u](https://e.test/a.) [m](mailto:x) [a](#h)\n"),
    "decisions/bad.md": page("Bad_Name", "wrong", status='"active"', volatility="sometimes", updated="YYYY-MM-DD", provenance=None, tags=None, body="{PROJECT}\n"),
    "decisions/long.md": page("long", "decision", body="x\n" * 121),
    "security/open.md": page("open", "security", volatility="decays-with-code", updated="2024-01-02", live_summary="short", body="`src/app.py:42` `lib/gone.rs` `b.py` `x.zzz`\n"),
    "security/closed.md": page("closed", "security", volatility="decays-with-code", status="resolved", updated="2024-02-31"),
    "security/rule.md": page("rule", "security"),
    "tasks/task-one.md": page("task-one", "task"),
    "tasks/done.md": page("done", "task", status="superseded"),
    "tasks/_SHARD_TEMPLATE.md": page("example-slug-kebab-case", "task", body="[[placeholder]]\n"),
    "architecture.md": page("architecture", "architecture", updated="TODO"),
    "reference/b.md": "x",
    "reference/a.md": "y",
}


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for rel, text in PAGES.items():
        (root / rel).parent.mkdir(exist_ok=True)
        (root / rel).write_bytes(text.encode() + (b"\xff" if rel == "gotchas/clean.md" else b""))
    return str(root)


@pytest.fixture(scope="module")
def files(spark, vault):
    return read_vault(spark, vault).cache()


@pytest.fixture(scope="module")
def records(files):
    return lint.shards(lint_scope(files, CorpusConfig().collections)).cache()


def test_listing(spark, files, vault):
    rows = {r.rel: r for r in files.collect()}
    assert "gotchas/_odd.md" in rows and "tasks/_SHARD_TEMPLATE.md" in rows and "gotchas/.hidden.md" not in rows
    assert "\r" not in rows["gotchas/crlf.md"].text and rows["gotchas/clean.md"].text == PAGES["gotchas/clean.md"]
    assert [r.stem for r in base_names(files, "reference").collect()] == ["a", "b"]
    with pytest.raises(MissingVault):
        read_vault(spark, vault + "/nowhere")


def test_collections(records):
    assert [r.rel for r in collection(records, "gotchas").collect()] == ["gotchas/_odd.md", "gotchas/clean.md", "gotchas/crlf.md", "gotchas/dup.md", "gotchas/unsafe.md"]


def test_lint(records):
    got = {}
    for r in lint.lint(records).collect():
        got.setdefault(r.rel, set()).add((r.rule, r.subject))
    assert "gotchas/clean.md" not in got and "gotchas/crlf.md" not in got
    assert got["gotchas/none.md"] == {("LR1", "")}
    assert got["gotchas/_odd.md"] == {("LR5", "other-name")}
    assert got["gotchas/unsafe.md"] == {("LR10", "title")}
    assert got["decisions/bad.md"] == {("LR2", "provenance"), ("LR3", "tags"), ("LR4", "Bad_Name"), ("LR5", "Bad_Name"), ("LR6", "wrong"), ("LR7", '"active"'), ("LR8", "sometimes"), ("LR9", "YYYY-MM-DD"), ("LR11", "{PROJECT}")}
    assert got["decisions/long.md"] == {("LR12", "121")}
    assert got["decisions/dup.md, gotchas/dup.md"] == {("LR13", "twin")}
    assert got["decisions/dup.md"] == {("LR5", "twin")}  # a day that no month has passes here
    assert got["architecture.md"] == {("FL11", "")}
    assert ("LR11", "example-slug-kebab-case") in got["tasks/_SHARD_TEMPLATE.md"]


def test_gate_codes(records):
    only = records.where("rel = 'architecture.md'")
    assert [r.exit_code for r in (lint.gate(lint.lint(only)).first(), lint.gate(lint.lint(only), strict=True).first())] == [0, 1]
    assert lint.gate(lint.lint(records)).first().exit_code == 1
    assert LintConfig.from_env({"KB_TYPES": "a, b"}).types == ("a", " b") and CorpusConfig.from_env({"KB_PLATFORMS": "claude, gemini,"}).platforms == ("claude", "gemini")


def test_dialects(spark):
    text = "---\nkey: one\nmy-key: a: b\nkey:two\n---\nbody\nstatus: late\n"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(*(fm.parse(F.col("t"), d).alias(d) for d in ("D1", "D2", "D3")), fm.line_value(F.col("t"), "status").alias("D4"), fm.line_value(F.col("t"), "key").alias("first"), fm.body(F.col("t")).alias("body")).first()
    assert got.D1 == got.D2 == {"key": "two"} and got.D3 == {"key": "one", "my-key": "a: b"}
    assert (got.D4, got.first, got.body) == ("late", "one", "body\nstatus: late\n")
    open_end = spark.createDataFrame([("---\nk: v\n---",)], "t string").select(fm.parse(F.col("t"), "D1").alias("a"), fm.parse(F.col("t"), "D3").alias("b")).first()
    assert open_end.a == {"k": "v"} and open_end.b == {}


def _needs_quote(v):
    def quoted(v):
        if len(v) >= 2 and v[0] == v[-1] == '"':
            return re.fullmatch(r'(?s)(?:\\.|[^"\\])*\\?', v[1:-1]) is not None
        return len(v) >= 2 and v[0] == v[-1] == "'" and "'" not in v[1:-1].replace("''", "")

    if not v or quoted(v) or (v[0] + v[-1]) in ("[]", "{}"):
        return False
    return ": " in v or v.endswith(":") or " #" in v or v[0] in fm.RESERVED or "\t" in v


def test_quoting_fuzz(spark):
    rng = random.Random(5)
    values = ["".join(rng.choices("ab :#\"'\\[]{}\t@", k=rng.randint(0, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", fm.needs_quote(F.col("v")).alias("n"), fm.needs_quote(fm.quote(F.col("v"))).alias("again"))
    for r in df.collect():
        assert r.n == _needs_quote(r.v) and not r.again, r


def test_repair_is_idempotent(spark):
    rows = ["---\nt: a: b\n\tx\n---\nbody\t\n", "---\nt: fine\n\tx\n---\n", "---\nt: \"ok\"\n---\n", "no block\tx", "---\nt: a: b\n---", "---\nmy-key: @x \n---\n"]
    once = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").select("i", fm.repaired(F.col("t")).alias("t")).orderBy("i").collect()]
    assert once == ['---\nt: "a: b"\n  x\n---\nbody\t\n', *rows[1:5], '---\nmy-key: "@x"\n---\n']
    twice = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(once)], "i int, t string").select("i", fm.repaired(F.col("t")).alias("t")).orderBy("i").collect()]
    assert twice == once


def test_links(spark, files):
    own = files.where("stem <> '_SHARD_TEMPLATE'")
    found = links.links(own)
    assert {(r.kind, r.target) for r in found.where("rel = 'gotchas/clean.md'").collect()} == {("wiki", "task-one"), ("wiki", "INDEX"), ("md", "tasks/task-one.md")}
    assert [r.target for r in links.broken_wiki(found, links.known_names(own)).collect()] == ["gone", "gone"]
    assert [r.target for r in links.broken_paths(found, files.select(F.col("rel").alias("path"))).collect()] == ["missing.md"]
    targets = {"a": "a", "a|alias": "a", "a#h": "a", "dir/a": "a", "a.md": "a", "a\\|x": "a", " a ": "a"}
    got = spark.createDataFrame([(x,) for x in targets], "x string").select("x", links.wiki_target(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in got} == targets
    codes = {"u200": (200, None), "u403": (403, None), "u404": (404, None), "u429": (429, None), "slow": (None, "t" * 80)}
    urls = spark.createDataFrame([("p", "url", u, u, i) for i, u in enumerate([*codes, "u404"])], "rel string, kind string, raw string, target string, ord long")
    dead = sorted((r.url, r.status) for r in links.dead_urls(urls, lambda u: codes[u]).collect())
    assert dead == [("slow", "t" * 50), ("u404", "HTTP 404"), ("u404", "HTTP 404")]


def test_paths(spark):
    import posixpath

    cases = ["a/../b", "../a", "a/./b//c", "/../a", "", ".", "a/..", "../../x/..", "/a/b/../../..", "a/b/../../../c"]
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", tx.normal_path(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == {x: posixpath.normpath(x) for x in cases}


def test_staleness(spark, records):
    cfg = StaleConfig(today="2024-02-01")
    assert [(r.age_days, r.rel) for r in staleness.queue(records, cfg).collect()] == [(30, "security/open.md")]
    assert [r.rel for r in staleness.undated(records).collect()] == ["security/closed.md"]
    cited = staleness.anchors(staleness.volatile(records), cfg)
    assert {r.cited for r in cited.collect()} == {"src/app.py", "lib/gone.rs", "b.py"}
    index = staleness.code_index(spark.createDataFrame([("repos/x-src/app.py",), ("repos/node_modules/lib/gone.rs",), ("repos/za/b.py",)], "path string"), cfg)
    assert [r.cited for r in staleness.missing_anchors(cited, index).collect()] == ["lib/gone.rs"]
    assert staleness.missing_anchors(cited, index.limit(0)).count() == 0
    with pytest.raises(ValueError):
        staleness.today(StaleConfig(today="2024-02-31"))
    assert staleness.today(StaleConfig(today="soon")) is not None


def test_navigation(spark, records):
    cfg = CorpusConfig()
    live = {(r.section, r.line) for r in nav.live_rows(records).collect()}
    assert ("live-security", "- [[open]] — short") in live and not any("closed" in x or "rule" in x for _, x in live)
    groups = [(r.area, r.n) for r in nav.grouped(records.where("collection = 'gotchas' and name <> ''"), cfg.areas).orderBy("place").collect()]
    assert groups == [("infra", 4), ("mars", 1)]
    body = collection_page(records.where("collection = 'security'"), "Security", "security.md", "2024-02-01", live_by="volatility").first().body
    assert "## Live (2)" in body and "## Rest (1)" in body and "[[open]] — A title ⚠️" in body
    old = body.replace("updated: 2024-02-01", "updated: 2020-01-01")
    pages = lambda *x: spark.createDataFrame(x, "path string, body string")
    states = {r.path: r.state for r in nav.compare(pages(("a", body), ("b", body), ("c", "x")), pages(("a", old), ("b", body + "more"), ("d", "y"))).collect()}
    assert states == {"a": "current", "b": "stale", "c": "new", "d": "extra"}


def test_ownership(spark):
    mark = "<!-- generated by shardwright: x -->"
    bodies = {"one": mark, "eight": "\n" * 7 + mark, "ten": "\n" * 9 + "  " + mark, "eleven": "\n" * 10 + mark, "prose": f"files carry a {mark} comment", "longer": "<!-- generated by shardwrights -->"}
    current = spark.createDataFrame(list(bodies.items()), "path string, body string")
    assert {r.path for r in current.where(nav.is_owned(F.col("body"))).collect()} == {"one", "eight", "ten"}
    platforms = spark.createDataFrame([("codex", "one"), ("gemini", "eight"), ("cursor", "prose")], "platform string, path string")
    assert [r.platform for r in nav.orphans(current, platforms, ("gemini",)).collect()] == ["codex"]
    may, kept = nav.writable(current, current)
    assert {r.path for r in kept.collect()} == {"eleven", "prose", "longer"} and may.count() == 3


def test_splice_and_phantoms(spark):
    b, e = "<!-- BEGIN:sync:open-work -->", "<!-- END:sync:open-work -->"
    df = spark.createDataFrame([(f"top\n{b}\nold\n{e}\nend", "a\\1$2"), ("none", "x")], "t string, c string")
    assert [r.x for r in df.select(nav.spliced(F.col("t"), "open-work", F.col("c")).alias("x")).collect()] == [f"top\n{b}\na\\1$2\n{e}\nend", "none"]
    pages = spark.createDataFrame([("m", "run `cat $VAULT/INDEX.md` or `python shardwright`")], "path string, body string")
    here = spark.createDataFrame([("v/INDEX.md",)], "path string")
    assert [r.target for r in nav.phantom_references(pages, here, variables={"$VAULT": "v"}).collect()] == ["shardwright"]


def test_gate_run(spark, files):
    paths = files.select(F.col("rel").alias("path"))
    own = files.where("rel in ('gotchas/clean.md', 'tasks/task-one.md', 'gotchas/unsafe.md')")
    out = gate.run_gate(own, paths)
    assert [(r.stage, r.exit_code) for r in out] == [("fix", 0), ("lint", 0), ("links", 0)]
    assert [r.rel for r in out[0].findings.collect()] == ["gotchas/unsafe.md"]
    blocked = gate.run_gate(files.where("rel in ('decisions/bad.md')"), paths)
    assert [r.stage for r in blocked] == ["fix", "lint"] and blocked[-1].blocking
    assert [r.stage for r in gate.run_gate(files.where("rel = 'decisions/bad.md'"), paths, block=False)] == ["fix", "lint", "links"]
    assert gate.push_range("0" * 40, None, []) is None and gate.push_range("a", "b", []) == "b..a"
    assert gate.push_range("a", "0" * 40, ["c", "d"]) == "d^..a" and gate.push_range("a", None, ["c"], root=True) == "a"


def test_pages(spark, records):
    text = index_page({"gotchas": 5, "tasks": 2}, ["b", "a"], "2024-02-01", architecture=True)
    assert "| [[gotchas]] | 5 |" in text and "*8 records in all.*" in text and text.index("reference/a") < text.index("reference/b")
    page = live_page(records, "P", "MEMORY.md", ["note"])
    body = page.first().body
    assert "## Open findings (1)\n- [[open]] — short" in body and "- [note](note.md)" in body
    platforms = spark.createDataFrame([("codex", "AGENTS.md", "# A"), ("gemini", "GEMINI.md", "# G")], "platform string, path string, heading string")
    assert {r.path: r.body for r in nav.platform_pages(page, platforms).collect()} == {"AGENTS.md": "# A\n" + body, "GEMINI.md": "# G\n" + body}
    report = eval_report({"on_rate": 50.0, "off_rate": 0.0}, [{"type": "a", "n": 2, "on_rate": None, "off_rate": 1.0, "delta": None}], [{"verdict": "both", "n": 1}])
    assert "| a | 2 | n/a | 1% | — |" in report
