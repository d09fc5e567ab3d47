"""Rows to markdown pages. The driver writes them; operators never do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.config import CorpusConfig
from shardwright.operators import evalstats, nav


def header(kind: str, title: str, today: str, cfg: CorpusConfig) -> str:
    return f"---\ntype: {kind}\ntitle: {title}\nupdated: {today}\n---\n\n<!-- {cfg.marker}: edit records, then run it again -->\n\n# {title}\n"


def collection_page(records: DataFrame, title: str, path: str, today: str, cfg: CorpusConfig = CorpusConfig(), by_area: bool = False, live_by: str | None = None) -> DataFrame:
    """One row (path, body). The records of one collection are a page that people read, so they meet in one row."""
    rows = records.withColumn("line", nav.entry_line())
    if by_area:
        parts = nav.grouped(rows, cfg.areas, name="line").select("place", F.concat(F.lit("## "), "area", F.lit(" ("), "n", F.lit(")\n"), F.array_join("names", "\n")).alias("part"))
    elif live_by:
        side = F.when(nav.is_live(live_by), F.lit(1)).otherwise(2)
        own = rows.groupBy(side.alias("place")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x"))
        both = records.sparkSession.createDataFrame([(1, "Live"), (2, "Rest")], "place int, label string")
        parts = both.join(own, "place", "left").select("place", F.concat(F.lit("## "), "label", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("_none_"))).alias("part"))
    else:
        parts = rows.select(F.col("ord").alias("place"), F.col("line").alias("part"))
    body = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "\n\n" if by_area or live_by else "\n").alias("b"))
    return body.select(F.lit(path).alias("path"), F.concat(F.lit(header("moc", title, today, cfg) + "\n"), "b", F.lit("\n")).alias("body"))


def index_page(counts: dict[str, int], references: list[str], today: str, architecture: bool = False, cfg: CorpusConfig = CorpusConfig()) -> str:
    """The page of all collections with their counts and the total, the architecture page included."""
    out = [header("index", f"{cfg.project} knowledge", today, cfg), "| Page | Records |", "|---|--:|"]
    out += [f"| [[{c}]] | {counts.get(c, 0)} |" for c in cfg.collections] + (["| [[architecture]] | 1 |"] if architecture else [])
    out += ["", "## Reference", *([f"- `reference/{r}`" for r in sorted(references)] or ["- _(none yet)_"])]
    return "\n".join([*out, "", f"*{sum(counts.get(c, 0) for c in cfg.collections) + architecture} records in all.*", ""])


def live_page(records: DataFrame, title: str, path: str, notes: list[str] = [], cfg: CorpusConfig = CorpusConfig()) -> DataFrame:  # noqa: B006
    """One row (path, body): saved notes, open findings and open work. It is what a session always loads."""
    rows = nav.live_rows(records).groupBy("section").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("x"))
    labels = records.sparkSession.createDataFrame([(1, "live-security", "Open findings"), (2, "open-work", "Open work")], "place int, section string, label string")
    part = F.concat(F.lit("## "), "label", F.lit(" ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(")\n"), F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("- _none open_")))
    both = labels.join(rows, "section", "left").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("b"))
    top = f"# {title}\n\n<!-- {cfg.marker}: edit records, then run it again -->\n\n## Saved notes\n" + ("\n".join(f"- [{n}]({n}.md)" for n in sorted(notes)) or "- _(none yet)_") + "\n\n"
    return both.select(F.lit(path).alias("path"), F.concat(F.lit(top), "b", F.lit("\n")).alias("body"))


def eval_report(headline: dict, by_type: list, verdicts: list) -> str:
    """Rows of the evaluation statistics as a markdown report."""
    pct = lambda x: "n/a" if x is None else f"{x:.0f}%"
    out = ["# Paired evaluation", "", "| | on | off |", "|---|--:|--:|", f"| surfaced | {pct(headline['on_rate'])} | {pct(headline['off_rate'])} |", "", "| type | n | on | off | delta |", "|---|--:|--:|--:|--:|"]
    out += [f"| {r['type']} | {r['n']} | {pct(r['on_rate'])} | {pct(r['off_rate'])} | {'—' if r['delta'] is None else format(r['delta'], '+.0f')} |" for r in by_type]
    out += ["", "| verdict | n |", "|---|--:|", *(f"| {r['verdict']} | {r['n']} |" for r in verdicts)]
    return "\n".join(out) + "\n"


def full_report(results: DataFrame) -> str:
    """The whole report of stored results (id, project, type, on, off): rates, means by arm, types, verdicts, and each
    trap in the order of `ord`. A report is for people to read, so its rows are on the driver."""
    arms = results.select("ord", "id", "project", F.col("type"), F.col("on.applied").alias("on_applied"), F.col("off.applied").alias("off_applied"))
    head, means = evalstats.headline(arms).first().asDict(), evalstats.mean_metrics(results).first().asDict()
    kinds = [r.asDict() for r in evalstats.by_type(arms).collect()]
    told = [r.asDict() for r in evalstats.verdicts(arms).orderBy("verdict").collect()]
    out = [eval_report(head, kinds, told), "| mean | on | off |", "|---|--:|--:|"]
    out += [f"| {k} | {means[f'on_{k}']:.{d}f} | {means[f'off_{k}']:.{d}f} |" for k, d in zip(evalstats.METRICS, (0, 0, 1, 4))]
    mark = lambda x: "-" if x is None else "yes" if x else "no"
    out += ["", "| trap | project | type | on | off | verdict |", "|---|---|---|:-:|:-:|---|"]
    rows = arms.withColumn("verdict", evalstats.verdict(F.col("on_applied"), F.col("off_applied"))).orderBy("ord").collect()
    out += [f"| `{r.id}` | {r.project} | {r.type or 'single-fact'} | {mark(r.on_applied)} | {mark(r.off_applied)} | {r.verdict} |" for r in rows]
    bad = sum(r.verdict == "n/a" for r in rows)
    return "\n".join([*out, *(["", f"_{bad} trap(s) failed to run or to be graded; the rates leave them out._"] if bad else [])]) + "\n"
