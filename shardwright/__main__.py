"""The tools: `python -m shardwright lint|fix|links|staleness|sync|scan|prefilter|report|plan|maintain`.

Operators do the work; the driver prints what they find and writes the few files that people read. Exit codes: 0 clean,
1 findings that block (of `plan`: updates exist), 2 no such vault or input, 3 an answer is wanted and there is no
terminal. Folders come from KB_ROOT and KB_VAULT, as the other settings do from their variables."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Mapping

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright import render
from shardwright.config import CorpusConfig, DigestConfig, LintConfig, StaleConfig
from shardwright.operators import digest, evalstats, gate, kit, leaks, links, lint, nav, staleness
from shardwright.sources import exports
from shardwright.sources.page_writer import write_pages
from shardwright.sources.vault import MissingVault, base_names, collection, lint_scope, read_vault

TEMPLATE = "_SHARD_TEMPLATE.md"
PLATFORM_PAGES = {"codex": ("AGENTS.md", "# Start here"), "gemini": ("GEMINI.md", "# Start here"), "cursor": (".cursor/rules/kb-context.mdc", "---\nalwaysApply: true\n---\n")}


class Place:
    def __init__(self, spark: SparkSession, env: Mapping[str, str]):
        self.spark, self.env = spark, env
        self.root = os.path.abspath(env.get("KB_ROOT") or ".")
        self.vault = os.path.abspath(env.get("KB_VAULT") or os.path.join(self.root, "_knowledge"))
        self.cfg = CorpusConfig.from_env(env)

    def files(self) -> DataFrame:
        return read_vault(self.spark, self.vault)

    def records(self, files: DataFrame) -> DataFrame:
        return lint.shards(lint_scope(files, self.cfg.collections))

    def at(self, rel: str) -> str:
        return os.path.relpath(os.path.join(self.vault, rel), self.root)


def _say(df: DataFrame, line) -> int:
    n = 0
    for r in df.toLocalIterator():
        print("  " + line(r))
        n += 1
    return n


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def run_lint(p: Place, a: argparse.Namespace) -> int:
    cfg = LintConfig.from_env(p.env)
    found = lint.lint(p.records(p.files()), cfg).cache()
    _say(found.orderBy("severity", "rel", "rule"), lambda r: f"{r.severity:5} {r.rel}: {r.rule} {r.message} {r.subject}".rstrip())
    end = lint.gate(found, cfg.strict or a.strict).first()
    print(f"{end.errors} error(s), {end.warnings} warning(s)")
    return end.exit_code


def run_fix(p: Place, a: argparse.Namespace) -> int:
    changed = gate.repair(p.files()).where("changed").select("rel", "text")
    names = [r.rel for r in changed.select("rel").orderBy("rel").collect()]
    if names and not (a.check or a.dry_run):
        write_pages(changed, p.vault)
    for rel in names:
        print(f"  {'would fix' if a.check or a.dry_run else 'fixed'} {p.at(rel)}")
    n = len(names)
    print(f"{n} file(s) with values that need quotes")
    return int(a.check and n > 0)


def run_links(p: Place, a: argparse.Namespace) -> int:
    files = p.files()
    inside = os.path.relpath(p.vault, p.root)
    own = files.where(F.regexp_extract("rel", r"([^/]*)\z", 1) != TEMPLATE).withColumn("rel", F.concat(F.lit(f"{inside}/"), "rel"))
    found = links.links(own).cache()
    n = _say(links.broken_wiki(found, links.known_names(own)).orderBy("rel", "ord"), lambda r: f"{r.rel} -> [[{r.target}]]")
    gone = links.broken_paths(found, exports.repo_files(p.spark, p.root)).orderBy("rel", "ord")
    for r in gone.toLocalIterator():
        # what lies outside the root, or is absolute, only the disk knows
        if not os.path.exists(os.path.join(p.root, os.path.dirname(r.rel), r.target.split("#")[0])):
            print(f"  {r.rel} -> ({r.target})")
            n += 1
    if a.urls:
        _say(links.dead_urls(found, lambda u: _probe(u, a.timeout)), lambda r: f"{r.rel} -> {r.url} [{r.status}]")
    print(f"{n} broken link(s)")
    return int(n > 0)


def _probe(url: str, timeout: int) -> tuple[int | None, str | None]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:
            return r.status, None
    except urllib.error.HTTPError as e:
        return e.code, None
    except Exception as e:
        return None, str(e)


def run_staleness(p: Place, a: argparse.Namespace) -> int:
    cfg = StaleConfig.from_env(p.env)
    records = p.records(p.files())
    n = _say(staleness.queue(records, cfg), lambda r: f"{r.age_days:>4}d {p.at(r.rel)} (updated {r.updated}) {r.title}")
    n += _say(staleness.undated(records).orderBy("rel"), lambda r: f"   ? {p.at(r.rel)} (no valid date)")
    repos = p.env.get("KB_REPOS") or os.path.join(p.root, "repos")
    if not a.age_only and os.path.isdir(repos):
        cited = staleness.anchors(staleness.volatile(records), cfg)
        code = exports.repo_files(p.spark, repos).withColumn("path", F.concat(F.lit(repos.rstrip("/") + "/"), "path"))
        n += _say(staleness.missing_anchors(cited, staleness.code_index(code, cfg)).orderBy("rel", "cited"), lambda r: f"{p.at(r.rel)} -> `{r.cited}` not found")
    print(f"{n} to verify")
    return int(a.fail_on_stale and n > 0)


def pages(p: Place, files: DataFrame) -> DataFrame:
    """(path, body) of every generated page, path relative to the root."""
    cfg, day = p.cfg, staleness.today(StaleConfig.from_env(p.env)).isoformat()
    records = p.records(files)
    at = lambda name: p.at(f"{name}.md")
    own = {c: records.where((F.col("collection") == c) & (F.col("name") != "")) for c in cfg.collections}
    style = {"gotchas": {"by_area": True}, "security": {"live_by": "volatility"}, "tasks": {"live_by": "status"}}
    out = [render.collection_page(own[c], c.capitalize(), at(c), day, cfg, **style.get(c, {})) for c in cfg.collections]
    counts = {r["collection"]: r["n"] for r in records.where("collection <> '' and name <> ''").groupBy("collection").agg(F.count("*").alias("n")).collect()}
    root_page = not files.where("rel = 'architecture.md'").isEmpty()
    names = [r.stem + ".md" for r in base_names(files, "reference").collect()]  # a list that the page shows
    index = render.index_page(counts, names, day, root_page, cfg)
    out.append(p.spark.createDataFrame([(at("INDEX"), index)], "path string, body string"))
    live = render.live_page(records, cfg.project, "MEMORY.md", cfg=cfg)
    on = [(k, *PLATFORM_PAGES[k]) for k in cfg.platforms if k in PLATFORM_PAGES]
    if "claude" in cfg.platforms:
        out.append(live)
    if on:
        out.append(nav.platform_pages(live, p.spark.createDataFrame(on, "platform string, path string, heading string")).select("path", "body"))
    every = out[0]
    for df in out[1:]:
        every = every.unionByName(df)
    return every


def _on_disk(p: Place, paths: list[str]) -> DataFrame:
    rows = []
    for path in paths:
        full = os.path.join(p.root, path)
        if os.path.exists(full):
            with open(full, errors="ignore") as f:
                rows.append((path, f.read()))
    return p.spark.createDataFrame(rows, "path string, body string")


def run_sync(p: Place, a: argparse.Namespace) -> int:
    files = p.files()
    rendered = pages(p, files).cache()
    paths = [r.path for r in rendered.select("path").collect()]  # a page for each collection and platform
    current = _on_disk(p, paths + [path for path, _ in PLATFORM_PAGES.values()])
    shared = {path for path, _ in PLATFORM_PAGES.values()}
    may, kept = nav.writable(rendered, current.where(F.col("path").isin(*shared)), p.cfg)
    drift = nav.compare(may, current).where(F.col("state").isin("new", "stale"))
    orphans = nav.orphans(current, p.spark.createDataFrame([(k, v) for k, (v, _) in PLATFORM_PAGES.items()], "platform string, path string"), p.cfg.platforms, p.cfg)
    n = _say(orphans.orderBy("path"), lambda r: f"{r.path} is orphaned: {r.platform} is off")
    if a.check:
        n += _say(drift.orderBy("path"), lambda r: f"{r.path} is {r.state}")
        return int(n > 0)
    for r in kept.collect():
        print(f"  {r.path} is not ours: left alone")
    write_pages(may.select(F.col("path").alias("rel"), F.col("body").alias("text")), p.root)
    for r in may.select("path").orderBy("path").collect():
        print(f"  wrote {r.path}")
    if "claude" in p.cfg.platforms:
        _splice(p, files)
    return 0


def _splice(p: Place, files: DataFrame) -> None:
    path = os.path.join(p.root, "CLAUDE.md")
    if not os.path.exists(path):
        print("  no CLAUDE.md: live blocks not wired")
        return
    with open(path, errors="ignore") as f:
        text = f.read()
    rows = nav.live_rows(p.records(files)).groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("b"))
    blocks = {r["section"]: r["b"] for r in rows.collect()}
    df = p.spark.createDataFrame([(text,)], "t string")
    for name in ("live-security", "open-work"):
        df = df.withColumn("t", nav.spliced(F.col("t"), name, F.lit(blocks.get(name, "_none open_"))))
    new = df.first()["t"]
    if new == text and "<!-- BEGIN:sync:" not in text:
        print("  CLAUDE.md has no markers: live blocks not synced")
        return
    _write(path, new)


def run_scan(p: Place, a: argparse.Namespace) -> int:
    rules = list(leaks.RULES)
    deny = a.denylist or p.env.get("PII_DENYLIST") or os.path.join(p.root, ".pii-denylist.local")
    if os.path.exists(os.path.expanduser(deny)):
        rules += leaks.rules_from_lines(p.spark.read.text(os.path.expanduser(deny)).select(F.col("value").alias("entry")))
    elif a.denylist:
        raise FileNotFoundError(a.denylist)
    files = leaks.scannable(exports.tracked_files(p.spark, p.root, a.tracked)).select(F.col("path").alias("where"), "text")
    found = leaks.hits(files, rules=rules)
    if a.commits or a.patches:
        none = p.spark.createDataFrame([], "sha string, message string")
        said = exports.commits(p.spark, a.commits) if a.commits else none
        added = exports.patches(p.spark, a.patches).select("sha", F.lit("added").alias("path"), "line") if a.patches else none.select("sha", F.lit("").alias("path"), F.col("message").alias("line"))
        found = found.unionByName(gate.scan_range(said, added, rules))
    if a.staged:
        lines = leaks.added_lines(exports.patches(p.spark, a.staged)).select(F.lit("staged").alias("where"), F.col("line").alias("text"))
        found = found.unionByName(leaks.hits(lines, rules=rules))
    n = _say(found.orderBy("where", "line_no", "label"), lambda r: f"{r['where']}:{r.line_no} [{r.label}] {r.snippet}")
    print(f"{n} possible leak(s)")
    return int(n > 0)


def run_prefilter(p: Place, a: argparse.Namespace) -> int:
    cfg, every = DigestConfig.from_options(a.match, a.cap, a.buckets), None
    for kind, root in (("codex", a.codex), ("claude", a.claude)):
        if root and os.path.isdir(root):
            msgs, meta = digest.sessions(exports.transcript_lines(p.spark, root, a.match, cfg.head), kind, cfg)
            df = digest.digests(msgs, meta, kind, cfg)
            every = df if every is None else every.unionByName(df)
    if every is None:
        print("no transcripts", file=sys.stderr)
        return 2
    every = every.cache()
    write_pages(every.select(F.concat_ws("/", "bucket", "file").alias("rel"), "text"), a.out)
    _say(digest.bucket_stats(every), lambda r: f"{r.bucket:<18}{r.sessions:>10}{r.kb:>10}")
    return 0


def run_report(p: Place, a: argparse.Namespace) -> int:
    rows = evalstats.select_traps(exports.results(p.spark, a.results).withColumn("ord", F.monotonically_increasing_id()))
    text = render.full_report(rows)
    _write(a.out, text) if a.out else print(text)
    return 0


def run_plan(p: Place, a: argparse.Namespace) -> int:
    """Offered files against local ones: shown with --check, applied with --yes or after a question each."""
    read = lambda root: exports.tracked_files(p.spark, root).select(F.col("path").alias("name"), "content")
    plan = kit.update_plan(read(a.kit), read(a.local)).where("action <> 'same'").orderBy("name")
    todo = [(r.name, r.action) for r in plan.collect()]  # scripts that a person looks at
    for name, action in todo:
        print(f"  [{action}] {name}")
    if a.check or not todo:
        if not todo and not a.check:
            _write(os.path.join(a.local, ".version"), a.version + "\n")
        return int(bool(todo))
    done, every = 0, a.yes
    for name, _ in todo:
        if not every:
            try:
                answer = input(f"  apply {name}? [y]es / [n]o / [a]ll / [q]uit > ").strip().lower()[:1]
            except EOFError:
                return 3
            if answer == "q":
                break
            every = answer == "a"
            if answer not in ("y", "a"):
                continue
        with open(os.path.join(a.kit, name), "rb") as f:
            content = f.read()
        os.makedirs(os.path.dirname(os.path.join(a.local, name)) or ".", exist_ok=True)
        with open(os.path.join(a.local, name), "wb") as f:
            f.write(content)
        done += 1
    print(f"applied {done} of {len(todo)}")
    if done == len(todo):
        _write(os.path.join(a.local, ".version"), a.version + "\n")
    return 0


def run_maintain(p: Place, a: argparse.Namespace) -> int:
    tools = {"sync": run_sync, "fix": run_fix, "lint": run_lint, "links": run_links, "staleness": run_staleness}
    codes = {}
    for stage in gate.MAINTENANCE:
        print(f"{stage}:")
        codes[stage] = tools[stage](p, a)
    return max(codes["lint"], codes["links"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shardwright")
    sub = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, run, *flags: str, **options) -> None:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for f in flags:
            s.add_argument(f"--{f}", action="store_true")
        for k, v in options.items():
            s.add_argument(f"--{k}", default=v, type=int if isinstance(v, int) else str, required=v is ...)

    tool("lint", run_lint, "strict")
    tool("fix", run_fix, "check", "dry-run")
    tool("links", run_links, "urls", timeout=8)
    tool("staleness", run_staleness, "age-only", "fail-on-stale")
    tool("sync", run_sync, "check")
    tool("scan", run_scan, tracked=None, commits=None, patches=None, staged=None, denylist=None)
    tool("prefilter", run_prefilter, match=..., out="./digests", codex=os.path.expanduser("~/.codex/sessions"), claude=os.path.expanduser("~/.claude/projects"), cap=4000, buckets="")
    tool("report", run_report, results=..., out=None)
    tool("plan", run_plan, "check", "yes", kit=..., local=..., version="unknown")
    tool("maintain", run_maintain, "strict", "check", "dry-run", "urls", "age-only", "fail-on-stale", timeout=8)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, env: Mapping[str, str] = os.environ) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"shardwright {a.tool}").getOrCreate()
    try:
        return a.run(Place(spark, env), a)
    except (MissingVault, FileNotFoundError) as e:
        print(f"{a.tool}: no such input: {e}", file=sys.stderr)
        return 2
    except PythonException as e:  # a task couldn't read or write a file: nothing may pass for clean then
        print(f"{a.tool}: failed: {str(e).strip().splitlines()[-1]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
