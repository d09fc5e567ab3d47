"""Gates: repair, lint, links and drift over a whole vault, and which commits a push has to be scanned for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.config import LintConfig, StaleConfig
from shardwright.functions.frontmatter import repaired
from shardwright.operators import leaks, links, lint, nav, staleness

#: Order of a maintenance run.
MAINTENANCE = ("sync", "fix", "lint", "links", "staleness")


@dataclass
class GateResult:
    stage: str
    findings: DataFrame | None
    exit_code: int
    blocking: bool
    files: DataFrame | None = None


def repair(files: DataFrame) -> DataFrame:
    """(rel, text, changed): files with their frontmatter repaired."""
    df = files.withColumn("new", repaired(F.col("text")))
    return df.withColumn("changed", ~F.col("new").eqNullSafe(F.col("text"))).drop("text").withColumnRenamed("new", "text")


def run_gate(files: DataFrame, paths: DataFrame, rendered: DataFrame | None = None, current: DataFrame | None = None, cfg: LintConfig = LintConfig(), block: bool = True, skip: tuple[str, ...] = ()) -> list[GateResult]:
    """Stages in order, ended by the first that blocks. files: (rel, collection, ord, text); paths: (path) of what exists;
    rendered and current: pages (path, body). What a stage finds is a DataFrame, its exit code one small aggregate."""
    out: list[GateResult] = []
    fixed = repair(files)
    out.append(GateResult("fix", fixed.where("changed").select("rel"), 0, False, fixed))
    if "lint" not in skip:
        found = lint.lint(lint.shards(fixed), cfg)
        code = lint.gate(found, cfg.strict).first()["exit_code"]
        out.append(GateResult("lint", found, code, block and code > 0))
        if out[-1].blocking:
            return out
    if "links" not in skip:
        own = fixed.where(F.regexp_extract("rel", r"([^/]*)\z", 1) != "_SHARD_TEMPLATE.md")
        every = links.links(own)
        bad = links.broken_wiki(every, links.known_names(own)).unionByName(links.broken_paths(every, paths))
        code = int(not bad.isEmpty())
        out.append(GateResult("links", bad, code, block and code > 0))
        if out[-1].blocking:
            return out
    if rendered is not None and current is not None:
        drift = nav.compare(rendered, current).where(F.col("state").isin("new", "stale"))
        out.append(GateResult("sync", drift, int(not drift.isEmpty()), False))
    return out


def maintenance(files: DataFrame, paths: DataFrame, rendered: DataFrame | None = None, current: DataFrame | None = None, code: DataFrame | None = None, cfg: LintConfig = LintConfig(), clock: StaleConfig = StaleConfig()) -> list[GateResult]:
    """The stages of MAINTENANCE, all of them whatever they find. code: (path) of source files for the citations."""
    every = {r.stage: r for r in run_gate(files, paths, rendered, current, cfg, block=False)}
    records = lint.shards(every["fix"].files if every["fix"].files is not None else files)
    due = staleness.queue(records, clock).select("rel", F.lit("overdue").alias("kind"), F.col("age_days").cast("string").alias("what"))
    due = due.unionByName(staleness.undated(records).select("rel", F.lit("undated").alias("kind"), F.col("updated").alias("what")))
    if code is not None:
        gone = staleness.missing_anchors(staleness.anchors(staleness.volatile(records), clock), staleness.code_index(code, clock))
        due = due.unionByName(gone.select("rel", F.lit("anchor").alias("kind"), F.col("cited").alias("what")))
    every["staleness"] = GateResult("staleness", due, 0, False)
    return [every[s] for s in MAINTENANCE if s in every]


def restage(changed: DataFrame, staged: DataFrame) -> DataFrame:
    """Repaired files that were staged."""
    return changed.join(staged.select(F.col("path").alias("rel")), "rel", "left_semi")


def push_range(local: str, remote: str | None, unseen: list[str], root: bool = False) -> str | None:
    """The range of commits to scan: from the remote's on, for a new branch from before the oldest unseen one, all of
    the ancestry if that is a root commit. None if there is nothing to scan."""
    if set(local) == {"0"}:
        return None
    if remote and set(remote) != {"0"}:
        return f"{remote}..{local}"
    if not unseen:
        return None
    return local if root else f"{unseen[-1]}^..{local}"


def scan_range(commits: DataFrame, diff: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Leaks in commit messages and in lines that any commit of a range adds, even if a later one takes them away.
    commits: (sha, message); diff: (sha, path, line)."""
    rules = leaks.RULES if rules is None else rules
    said = commits.select(F.concat(F.lit("commit "), "sha").alias("where"), F.col("message").alias("text"))
    added = leaks.added_lines(diff).select(F.concat_ws(":", "sha", "path").alias("where"), F.col("line").alias("text"))
    return leaks.hits(said.unionByName(added), rules=rules)
