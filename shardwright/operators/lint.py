"""Validation rules over parsed records; every finding has rule, severity, rel, subject and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardwright.config import LintConfig
from shardwright.functions import frontmatter as fm

_FINDING = "array<struct<rule: string, severity: string, subject: string, message: string>>"


def shards(files: DataFrame, dialect: str = "D2") -> DataFrame:
    """files (rel, text, ...) with fm (a map), body, stem and the common fields as columns; absent fields are empty."""
    df = files.withColumn("fm", fm.parse(F.col("text"), dialect)).withColumn("body", fm.body(F.col("text")))
    df = df.withColumn("stem", F.regexp_extract("rel", r"([^/]*?)(?:\.md)?\z", 1))
    get = lambda k: F.coalesce(F.try_element_at("fm", F.lit(k)), F.lit(""))
    return df.withColumns({k: get(k) for k in ("name", "type", "title", "status", "updated", "volatility", "provenance", "area", "tags", "verify", "live_summary")})


def _one(rule: str, severity: str, when: Column, subject: Column | str, message: Column) -> Column:
    subject = F.lit(subject) if isinstance(subject, str) else subject
    one = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.alias("subject"), message.alias("message"))
    return F.when(when, F.array(one)).otherwise(F.array().cast(_FINDING))


def _each(rule: str, severity: str, items: Column, message) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), x.alias("subject"), message(x).alias("message")))


def is_scaffold() -> Column:
    """An architecture page that nobody has filled in yet."""
    todo = (F.col("updated") == "TODO") | (F.col("provenance") == "TODO") | F.contains(F.concat_ws(" ", "body", "title"), F.lit("{PROJECT}"))
    return (F.col("stem") == "architecture") & (F.col("collection") == "") & todo


def findings(records: DataFrame, cfg: LintConfig = LintConfig()) -> DataFrame:
    """(rel, rule, severity, subject, message) of all rules but the one on duplicate names. records: shards with a
    collection, empty for pages at the root."""
    arch = (F.col("stem") == "architecture") & (F.col("collection") == "")
    missing = lambda keys: F.filter(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(F.col("fm"), k), F.lit("")) == "")
    off = lambda c, allowed: (F.col(c) != "") & ~F.col(c).isin(*allowed)
    values = F.filter(F.map_entries("fm"), lambda e: fm.needs_quote(e["value"]))
    hay = F.concat(F.col("body"), F.lit("\n"), F.array_join(F.transform(F.map_entries("fm"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))
    n_lines = F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit("")))
    rules = [
        _each("LR2", "error", missing(cfg.required), lambda k: F.concat(F.lit("missing required field "), k)),
        _each("LR3", "warn", missing(cfg.recommended), lambda k: F.concat(F.lit("missing recommended field "), k)),
        _one("LR4", "error", (F.col("name") != "") & ~fm.is_kebab(F.col("name")), F.col("name"), F.lit("name is not kebab-case")),
        _one("LR5", "warn", (F.col("name") != "") & (F.col("name") != F.col("stem")) & ~arch, F.col("name"), F.concat(F.lit("name is not the file's: "), "stem")),
        _one("LR6", "error", off("type", cfg.types), F.col("type"), F.lit("type is off the schema")),
        _one("LR7", "error", off("status", cfg.status), F.col("status"), F.lit("status is off the schema")),
        _one("LR8", "error", off("volatility", cfg.volatility), F.col("volatility"), F.lit("volatility is off the schema")),
        _one("LR9", "error", (F.col("updated") != "") & ~fm.is_lint_date(F.col("updated")), F.col("updated"), F.concat(F.lit("updated is no date"), F.when(F.contains("updated", F.lit("YYYY")), " (placeholder)").otherwise(""))),
        _each("LR10", "error", F.transform(values, lambda e: e["key"]), lambda k: F.concat(F.lit("value needs quotes: "), k)),
        _each("LR11", "error", F.filter(F.array(*map(F.lit, cfg.placeholders)), lambda p: F.contains(hay, p)), lambda p: F.lit("template placeholder left")),
        _one("LR12", "warn", (n_lines > cfg.max_lines) if cfg.max_lines else F.lit(False), n_lines.cast("string"), F.lit("body is long: probably several records")),
    ]
    none = _one("LR1", "error", F.lit(True), "", F.lit("no frontmatter"))
    scaffold = _one("FL11", "warn", F.lit(True), "", F.lit("architecture page not filled in; skipped"))
    found = F.when(is_scaffold(), scaffold).when(F.size("fm") == 0, none).otherwise(F.concat(*rules))
    return records.select("rel", F.explode(found).alias("x")).select("rel", "x.rule", "x.severity", "x.subject", "x.message")


def duplicates(records: DataFrame, key: str = "name", place: str = "rel", order: str = "ord") -> DataFrame:
    """Keys of several records, with all their places in order."""
    out = records.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, place))).alias("at"))
    return out.where(F.size("at") > 1).select(key, F.transform("at", lambda x: x[place]).alias("places"))


def lint(records: DataFrame, cfg: LintConfig = LintConfig()) -> DataFrame:
    real = records.where(~is_scaffold())
    twice = duplicates(real).select(F.array_join("places", ", ").alias("rel"), F.lit("LR13").alias("rule"), F.lit("error").alias("severity"), F.col("name").alias("subject"), F.lit("duplicate name").alias("message"))
    return findings(records, cfg).unionByName(twice)


def gate(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row: errors, warnings and the exit code."""
    out = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    return out.withColumn("exit_code", ((F.col("errors") + F.when(F.lit(strict), F.col("warnings")).otherwise(0)) > 0).cast("int"))


def per_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))
