"""Users' own rules: tables of patterns for lines, and the text functions by name in SQL.

A rule is a row (label, pattern, word). Where `word` is given, a run of letters, digits and `_` that every match's line
holds, in lower case, lines meet their rules in an equi-join on words. A table of SMALL characters at most is broadcast, a
larger one is shuffled and merged, where adaptive execution splits a word that most lines hold. Rules without a word are asked of every line: they become one projection,
and more than PLAIN of them are an error, which asks for words, never a silent cut.

Defined cases: a null or empty text has no lines; rules with a null label or pattern are left out, repeated ones count
once; a pattern that isn't valid ends the scan; a word in capitals is taken in lower case; no rules, no findings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.functions.text import snippet
from shardwright.operators.leaks import numbered_lines

WORD = r"[\p{L}\p{N}_]+"
PLAIN = 256
SMALL = 4_000_000
#: Names in SQL and what they are, over `x`.
FUNCTIONS: dict[str, tuple[str, str]] = {
    "sw_words": ("ARRAY<STRING>", f"regexp_extract_all(lower(coalesce(x, '')), r'{WORD}', 0)"),
    "sw_stem": ("STRING", r"regexp_replace(regexp_replace(x, r'^.*/', ''), r'\.md\z', '')"),
    "sw_slug_ok": ("BOOLEAN", r"coalesce(x, '') rlike r'^[a-z0-9]+(-[a-z0-9]+)*\z'"),
    "sw_wikilinks": ("ARRAY<STRING>", r"regexp_extract_all(coalesce(x, ''), r'\[\[([^\]\n]+)\]\]', 1)"),
    "sw_day": ("DATE", "try_to_date(x, 'yyyy-MM-dd')"),
}


def with_rules(lines: DataFrame, rules: DataFrame, line: str = "line", small: int = SMALL) -> DataFrame:
    """The columns of `lines` but for `line`, with label and snippet: a row for each rule that a line matches, its first
    match. Lines with a word of a rule only meet the rules of that word."""
    keep = [c for c in lines.columns if c != line]
    rules = rules.where("label is not null and pattern is not null").select("label", "pattern", F.nullif(F.lower(F.trim("word")), F.lit("")).alias("word")).distinct()
    plain = [tuple(r) for r in rules.where("word is null").select("label", "pattern").limit(PLAIN + 1).collect()]
    if len(plain) > PLAIN:
        raise ValueError(f"more than {PLAIN} rules have no word: give each of them a word that its matches' lines hold")
    own = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_own")
    text = lines.select(own, F.col(f"`{line}`").alias("_line"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("_line"), F.lit(WORD), F.lit(0)))
    by_word = rules.where("word is not null").select(F.col("word").alias("_word"), "label", "pattern")
    size = by_word.agg(F.coalesce(F.sum(F.length("_word") + F.length("label") + F.length("pattern") + 16), F.lit(0))).first()[0]
    # the planner takes exploded lines for as small as their file, so the way is always named
    met = text.withColumn("_word", F.explode(words)).join(F.broadcast(by_word) if size <= small else by_word.hint("merge"), "_word")
    met = met.where("regexp_like(_line, pattern)").select("_own", "label", F.regexp_substr("_line", F.col("pattern")).alias("_m"))
    if plain:
        first = lambda p: F.regexp_substr(F.col("_line"), F.lit(p))
        found = F.filter(F.array(*(F.struct(F.lit(a).alias("label"), first(p).alias("m")) for a, p in sorted(plain))), lambda x: x["m"].isNotNull())
        asked = text.select("_own", F.explode(found).alias("_x"))
        met = met.unionByName(asked.select("_own", F.col("_x.label").alias("label"), F.col("_x.m").alias("_m")))
    return met.select("_own.*", "label", snippet(F.col("_m")).alias("snippet"))


def scan(docs: DataFrame, rules: DataFrame, text: str = "text", small: int = SMALL) -> DataFrame:
    """The rules over all lines of whole texts: docs' other columns, line_no from 1, label, snippet."""
    return with_rules(numbered_lines(docs, text), rules, small=small)


@F.udtf(returnType="line_no bigint, line string", useArrow=True)
class text_lines:
    """A text's lines, numbered from 1, as a table function: `SELECT ... FROM docs, LATERAL sw_lines(text)`. Lines end as
    in Python; a line end at the end of a text starts no line. Rows go to and from Python in Arrow batches."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").splitlines(), 1)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions above known to the session's SQL and returns their names. All but sw_lines are SQL that
    Catalyst inlines."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("sw_lines", text_lines)
    return [*FUNCTIONS, "sw_lines"]
