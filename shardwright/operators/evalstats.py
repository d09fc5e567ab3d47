"""Statistics of paired evaluations: rows with two arms, each graded true, false or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.functions.text import strip

METRICS = ("input_tokens", "output_tokens", "num_turns", "cost_usd")
RESULTS = (
    "id string, project string, type string, prompt string, criterion string, "
    + ", ".join(f"{a} struct<m: struct<result: string, input_tokens: bigint, output_tokens: bigint, cache_read: bigint, num_turns: int, cost_usd: double, duration_ms: bigint, is_error: boolean, error: string>, applied: boolean>" for a in ("on", "off"))
)


def metrics(v: Column) -> Column:
    """What is kept of a run's envelope, a variant: absent token counts are 0, other absent figures null."""
    get = lambda p, t: F.try_variant_get(v, p, t)
    zero = lambda p: F.coalesce(get(p, "bigint"), F.lit(0))
    return F.struct(
        F.coalesce(get("$.result", "string"), F.lit("")).alias("result"), zero("$.usage.input_tokens").alias("input_tokens"), zero("$.usage.output_tokens").alias("output_tokens"),
        zero("$.usage.cache_read_input_tokens").alias("cache_read"), get("$.num_turns", "int").alias("num_turns"), get("$.total_cost_usd", "double").alias("cost_usd"),
        get("$.duration_ms", "bigint").alias("duration_ms"), F.coalesce(get("$.is_error", "boolean"), F.lit(False)).alias("is_error"), get("$._error", "string").alias("error"))


def envelope(stdout: Column) -> Column:
    """A run's envelope from its output: the whole of it as JSON, else its last line that is a JSON object, else an
    object that says what went wrong."""
    t = strip(F.coalesce(stdout, F.lit("")))
    rows = F.filter(F.transform(F.reverse(F.split(t, "\n")), strip), lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull())
    return F.coalesce(F.when(t == "", F.parse_json(F.lit('{"_error": "empty stdout"}'))), F.try_parse_json(t), F.try_parse_json(F.try_element_at(rows, F.lit(1))), F.parse_json(F.lit('{"_error": "unparseable json"}')))


def verdict_text(text: Column) -> Column:
    """(applied, evidence) of a grader's answer: its JSON, else the JSON from its first to its last brace, else its key
    words. An object that doesn't say counts as false; nothing usable is null."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    inner = F.when((first > 0) & (last >= first), text.substr(first, last - first + 1))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    own = [F.when(is_object(F.try_parse_json(x)), F.try_parse_json(x)) for x in (text, inner)]
    v = F.coalesce(*own)
    applied = F.coalesce(F.try_variant_get(v, "$.applied", "boolean"), F.lit(False))
    low = F.lower(text)
    word = F.when(low.rlike('"applied": ?true'), True).when(low.rlike('"applied": ?false'), False)
    return F.struct(
        F.when(v.isNotNull(), applied).otherwise(word).alias("applied"),
        F.when(v.isNotNull(), F.left(F.coalesce(F.try_variant_get(v, "$.evidence", "string"), F.lit("")), F.lit(160))).when(word.isNotNull(), "kw-fallback").otherwise("grader-parse-fail").alias("evidence"),
    )


def gradeable(m: Column) -> Column:
    """A run with an answer and no error. A failed run is no evidence and is left out, not counted as a miss."""
    return (F.coalesce(m["result"], F.lit("")) != "") & (F.coalesce(m["error"], F.lit("")) == "") & ~F.coalesce(m["is_error"], F.lit(False))


def rate(applied: Column) -> Column:
    """Percentage of true among the graded; null if nothing is graded."""
    return F.avg(applied.cast("int")) * 100


def headline(rows: DataFrame, on: str = "on_applied", off: str = "off_applied") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.coalesce(rate(F.col(on)), F.lit(0.0)).alias("on_rate"), F.coalesce(rate(F.col(off)), F.lit(0.0)).alias("off_rate"))


def mean_metrics(results: DataFrame) -> DataFrame:
    """Means by arm, nulls left out, 0 where there is nothing."""
    return results.agg(*(F.coalesce(F.avg(f"{a}.m.{k}"), F.lit(0.0)).alias(f"{a}_{k}") for a in ("on", "off") for k in METRICS))


def by_type(rows: DataFrame, on: str = "on_applied", off: str = "off_applied", kind: str = "type") -> DataFrame:
    out = rows.groupBy(F.coalesce(kind, F.lit("single-fact")).alias("type")).agg(F.count("*").alias("n"), rate(F.col(on)).alias("on_rate"), rate(F.col(off)).alias("off_rate"))
    return out.withColumn("delta", F.col("on_rate") - F.col("off_rate")).orderBy("type")


def verdict(on: Column, off: Column) -> Column:
    return F.when(on.isNull() | off.isNull(), "n/a").when(on & ~off, "on only").when(on & off, "both").when(~on & ~off, "neither").otherwise("off only")


def verdicts(rows: DataFrame, on: str = "on_applied", off: str = "off_applied") -> DataFrame:
    return rows.groupBy(verdict(F.col(on), F.col(off)).alias("verdict")).agg(F.count("*").alias("n"))


def paired(long: DataFrame) -> DataFrame:
    """(id, arm, applied) to one row per id."""
    return long.groupBy("id").pivot("arm", ["on", "off"]).agg(F.first("applied")).select("id", F.col("on").alias("on_applied"), F.col("off").alias("off_applied"))


def select_traps(traps: DataFrame, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """By id, then the first few in file order."""
    df = traps.where(F.col("id").isin(*ids)) if ids else traps
    return df.orderBy("ord").limit(limit) if limit else df


def judge_warning(agent: str, judge: str) -> str | None:
    return "the judge is the agent's model: it may prefer its own answers" if agent == judge else None
