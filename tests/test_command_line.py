"""The tools from their arguments to exit codes, and files as they are met on disk."""

import json

import pytest
from pyspark.sql import functions as F

from shardwright.__main__ import main
from shardwright.config import StaleConfig
from shardwright.functions import frontmatter as fm
from shardwright.functions import text as tx
from shardwright.operators import gate, leaks
from shardwright.sources import exports

MAIL = "zoe" + "@corp.io"
PAGE = "---\nname: {0}\ntype: {1}\ntitle: {2}\nstatus: active\nupdated: 2024-01-05\nvolatility: decays-with-code\nprovenance: me\narea: infra\ntags: [a]\n---\n{3}\n"


@pytest.fixture
def root(tmp_path):
    for rel, text in {
        "_knowledge/gotchas/one.md": PAGE.format("one", "gotcha", "A title", "see [[two]] and [x](../../src/a.py) `src/a.py`"),
        "_knowledge/tasks/two.md": PAGE.format("two", "task", "b: c", "[[one]]"),
        "src/a.py": "x = 1\n", "repos/src/a.py": "x = 1\n", "CLAUDE.md": "top\n<!-- BEGIN:sync:open-work -->\n<!-- END:sync:open-work -->\n", "GEMINI.md": "my own page\n",
    }.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(text)
    return tmp_path


def test_tools(spark, root, capsys):
    env = {"KB_ROOT": str(root), "KB_TODAY": "2024-02-01"}
    run = lambda *a, **e: main(list(a), spark, env | e)
    assert run("lint") == 1 and "LR10" in capsys.readouterr().out  # the title needs quotes
    assert run("fix", "--check") == 1 and run("fix", "--dry-run") == 0 and "b: c" in (root / "_knowledge/tasks/two.md").read_text()
    assert run("fix") == 0 and 'title: "b: c"' in (root / "_knowledge/tasks/two.md").read_text()
    assert run("lint") == 0 and run("links") == 0
    assert run("staleness") == 0 and run("staleness", "--fail-on-stale") == 1 and run("staleness", "--fail-on-stale", KB_STALE_DAYS="99") == 0
    assert run("sync", "--check") == 1 and run("sync") == 0
    out = capsys.readouterr().out
    assert "GEMINI.md is not ours" in out and (root / "GEMINI.md").read_text() == "my own page\n"
    assert "- [[two]] — b: c" in (root / "CLAUDE.md").read_text() and "[[one]]" in (root / "_knowledge/gotchas.md").read_text()
    assert (root / "AGENTS.md").exists() and run("sync", "--check") == 0
    assert run("sync", "--check", KB_PLATFORMS="claude") == 1  # AGENTS.md is an orphan then
    (root / "_knowledge/tasks/three.md").write_text(PAGE.format("three", "task", "t", "[[gone]] [y](none.md)"))
    assert run("links") == 1 and "[[gone]]" in capsys.readouterr().out
    assert run("maintain") == 1
    assert main(["lint"], spark, {"KB_ROOT": str(root / "nowhere")}) == 2


def test_scan_tool(spark, root, tmp_path_factory, capsys):
    for rel in ("_knowledge/x.md", ".env", ".github/w.yml", "a b/ok+1.md", ".git/config", "logo.png\n"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(b"\xff " + MAIL.encode() + b" \xc3")
    assert main(["scan"], spark, {"KB_ROOT": str(root)}) == 1
    out = capsys.readouterr().out
    assert all(f"{x}:1 [email]" in out for x in ("_knowledge/x.md", ".env", ".github/w.yml", "a b/ok+1.md")) and ".git/config" not in out
    side = tmp_path_factory.mktemp("side")
    (side / "tracked").write_text("src/a.py\n")
    scan = lambda *a: main(["scan", "--tracked", str(side / "tracked"), *a], spark, {"KB_ROOT": str(root)})
    assert scan() == 0
    (side / "log").write_text(f"commit {'a' * 40}\n    fine\n+++ b/{MAIL}\n+x {MAIL}\n-y\ncommit {'b' * 40} (tag: v1)\n-x {MAIL}\n")
    assert scan("--patches", str(side / "log")) == 1 and f"{'a' * 40}:added:1" in capsys.readouterr().out
    (side / "staged").write_text("diff --git a b\n+fine\n")
    assert scan("--staged", str(side / "staged")) == 0
    (side / "deny").write_text("# x\nx = 1\n")
    assert scan("--denylist", str(side / "deny")) == 1 and scan("--denylist", str(side / "none")) == 2
    assert [(r.sha[:1], r.line) for r in exports.patches(spark, str(side / "log")).collect()][-1] == ("b", f"-x {MAIL}")
    (side / "names").write_text("a.py\n\nb.py\na.py\n")
    assert sorted(r.path for r in exports.changed_files(spark, str(side / "names")).collect()) == ["a.py", "a.py", "b.py"]


def test_other_tools(spark, tmp_path, capsys):
    say = lambda t: json.dumps({"type": "user", "cwd": "/y/match", "timestamp": "2024-03-01T1", "message": {"role": "user", "content": t}})
    (tmp_path / "c d").mkdir()
    (tmp_path / "c d" / "s+1.jsonl").write_text(say("a question of some length"))
    paths = [r.path for r in exports.transcript_lines(spark, str(tmp_path / "c d")).select("path").collect()]
    assert paths == [str(tmp_path / "c d" / "s+1.jsonl")]
    args = ["prefilter", "--match", "MATCH", "--claude", str(tmp_path / "c d"), "--codex", str(tmp_path / "none"), "--out", str(tmp_path / "out")]
    assert main(args, spark, {}) == 0
    page = next((tmp_path / "out" / "main").iterdir())
    assert page.name.startswith("2024-03-01-claude-") and "a question of some length" in page.read_text() and f"source: {paths[0]}\n" in page.read_text()
    m = {"result": "r", "input_tokens": 10, "output_tokens": 4, "num_turns": 2, "cost_usd": 0.5}
    rows = [{"id": "t1", "project": "p", "type": "x", "on": {"m": m, "applied": True}, "off": {"m": m, "applied": False}}, {"id": "t2", "project": "p", "on": {"m": m}, "off": {"m": m, "applied": True}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    assert main(["report", "--results", str(tmp_path / "r.json")], spark, {}) == 0
    out = capsys.readouterr().out
    assert "| input_tokens | 10 | 10 |" in out and "| cost_usd | 0.5000 | 0.5000 |" in out and "| `t1` | p | x | yes | no | on only |" in out and "1 trap(s) failed" in out
    for n, text in (("kit/a.py", "new"), ("kit/b.py", "b"), ("own/a.py", "old"), ("own/z.py", "z")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(text)
    plan = lambda *a: main(["plan", "--kit", str(tmp_path / "kit"), "--local", str(tmp_path / "own"), "--version", "v2", *a], spark, {})
    assert plan("--check") == 1 and not (tmp_path / "own/b.py").exists()
    assert plan("--yes") == 0 and (tmp_path / "own/a.py").read_text() == "new" and (tmp_path / "own/.version").read_text() == "v2\n"
    assert plan("--check") == 0


def test_long_and_odd_values(spark):
    long = ['"' + "a" * 100_000 + '"', '"' + "\\n" * 50_000 + '"', "'" + "''" * 50_000 + "'", "'" + "x" * 100_000, "a-" * 50_000 + "a", "1." * 50_000 + "1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(long)], "i int, v string")
    got = df.select("i", fm.needs_quote(F.col("v")).alias("q"), fm.is_kebab(F.col("v")).alias("k"), F.size(tx.version_key(F.col("v"))).alias("n"), F.length(tx.strip(F.concat(F.lit("x"), F.repeat(F.lit(" "), 100_000), "v"))).alias("s")).orderBy("i").collect()
    assert [r.q for r in got] == [False, False, False, True, False, False]
    assert got[4].k and got[5].n == 50_001 and got[0].s == 200_003
    page = spark.createDataFrame([(f"---\nname: {long[0]}\n---\n", "gotchas/x.md", "gotchas", 1)], "text string, rel string, collection string, ord int")
    assert gate.repair(page).where("changed").count() == 0
    bad = spark.createDataFrame([(b"\xff\xfea\xc3(b\xf0\x9f\x98\x80",), ("�ok".encode(),), (None,)], "b binary")
    assert [r.t for r in bad.select(tx.decoded(F.col("b")).alias("t")).collect()] == ["a(b😀", "�ok", None]
    assert StaleConfig.from_env({"KB_STALE_DAYS": "3", "KB_TODAY": "2024-01-01"}) == StaleConfig(3, "2024-01-01")


def test_masks_make_word_ends(spark):
    key = "AKIA" + "ABCDEFGHIJ234567"
    lines = [f"you@example{key}", f"noreply@github.com{key}", "token noreply@github.com= abcdefghi", f"x{key}", "/home/me"]
    df = spark.createDataFrame([("f", "\n".join(lines))], "where string, text string")
    got = [(r.line_no, r.label) for r in leaks.hits(df).collect()]
    assert sorted(got) == [(1, "aws-access-key"), (2, "aws-access-key"), (3, "generic-secret-assign")]
