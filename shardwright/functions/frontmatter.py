"""Frontmatter: four dialects of reading, scalar checks, quoting and repair, as expressions.

Dialects: D1 and D2 read `key:value` lines (word characters) between `---` lines, D2 keeps the body; D3 wants a line end
after the closing `---`, allows hyphens in keys and wants white space before the value; D4 takes the first `key:` line
anywhere in the file. A repeated key is the last one's in D1 and D2, the first one's in D4.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardwright.functions.text import newlines, strip

# Fixed patterns: the blocks and key lines of the dialects.
BLOCK = {"D1": r"(?s)\A---\n(.*?)\n---", "D2": r"(?s)\A---\n(.*?)\n---\n?(.*)\z", "D3": r"(?s)\A---\n(.*?)\n---\n"}
LINE = {"D1": r"(?U)^(\w+):\s*(.*)$", "D2": r"(?U)^(\w+):\s*(.*)$", "D3": r"(?U)^(\w[\w-]*):[ \t]+(.*?)[ \t]*$"}
#: Possessive and unrolled: a group that repeats and backtracks takes a stack frame for each character.
QUOTED = r"""(?s)^(?:"[^"\\]*+(?:\\(?!"\z).[^"\\]*+)*+\\?"|'[^']*+(?:''[^']*+)*+')\z"""
# Fixed value: characters that a plain YAML scalar can't begin with.
RESERVED = "!&*?|>%@`,[]{}#\"'"


def entries(text: Column, dialect: str = "D2") -> Column:
    """The key lines of a file's block, in order, as array<struct<key, value>>."""
    text = newlines(F.coalesce(text, F.lit("")))
    block = F.regexp_extract(text, BLOCK[dialect], 1)
    keys = F.filter(F.split(block, "\n"), lambda x: x.rlike(LINE[dialect]))
    return F.transform(keys, lambda x: F.struct(F.regexp_extract(x, LINE[dialect], 1).alias("key"), strip(F.regexp_extract(x, LINE[dialect], 2)).alias("value")))


def folded(items: Column, first: bool = False) -> Column:
    """Entries as a map, the last value of a key (or the first)."""
    items = F.reverse(items) if first else items

    def put(acc: Column, x: Column) -> Column:
        return F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.create_map(x["key"], x["value"]))

    return F.aggregate(items, F.create_map().cast("map<string,string>"), put)


def parse(text: Column, dialect: str = "D2") -> Column:
    return folded(entries(text, dialect))


def body(text: Column) -> Column:
    """What follows the block; the whole text where there is none."""
    t = newlines(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(BLOCK["D2"]), F.regexp_extract(t, BLOCK["D2"], 2)).otherwise(t)


def line_value(text: Column, key: str) -> Column:
    """Dialect D4: the value of the first line of that key, anywhere; empty where there is none."""
    return F.regexp_extract(newlines(text), rf"(?m)^{key}:(?: *)(.*)$", 1)


def is_kebab(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9]++(?:-[a-z0-9]++)*+\z")


def is_lint_date(c: Column) -> Column:
    """Shaped like a date, with a month up to 12 and a day up to 31."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.substring(c, 6, 2).cast("int").between(1, 12) & F.substring(c, 9, 2).cast("int").between(1, 31)).otherwise(False)


def as_date(c: Column) -> Column:
    """A date, null for other shapes and for days that no month has."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def needs_quote(c: Column) -> Column:
    """Whether a YAML reader would choke on the plain scalar."""
    flow = (c.startswith("[") & c.endswith("]")) | (c.startswith("{") & c.endswith("}"))
    bad = F.contains(c, F.lit(": ")) | c.endswith(":") | F.contains(c, F.lit(" #")) | F.contains(F.lit(RESERVED), F.left(c, F.lit(1))) | F.contains(c, F.lit("\t"))
    return F.coalesce((c != "") & ~c.rlike(QUOTED) & ~flow & bad, F.lit(False))


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def repaired(text: Column) -> Column:
    """The text with its block's unsafe values quoted. Tabs in lines without a key become two spaces, but only where a
    value changed; other texts stay as they are, byte for byte."""
    block = F.regexp_extract(text, BLOCK["D3"], 1)
    rows = F.transform(F.split(block, "\n"), lambda x: F.struct(x.alias("line"), x.rlike(LINE["D3"]).alias("key"), F.regexp_extract(x, LINE["D3"], 1).alias("k"), F.regexp_extract(x, LINE["D3"], 2).alias("v")))
    unsafe = lambda x: x["key"] & needs_quote(x["v"])
    new = F.transform(rows, lambda x: F.when(unsafe(x), F.concat(x["k"], F.lit(": "), quote(x["v"]))).when(~x["key"], F.replace(x["line"], F.lit("\t"), F.lit("  "))).otherwise(x["line"]))
    rest = text.substr(F.length(block) + 5, F.length(text))
    return F.when(text.rlike(BLOCK["D3"]) & F.exists(rows, unsafe), F.concat(F.lit("---\n"), F.array_join(new, "\n"), rest)).otherwise(text)
