"""Scalar text functions with Python's notions of white space, lines and code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space at either end; the look-behind keeps long runs inside a text from being tried at each of their places.
_EDGE = r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z"
#: Line ends as str.splitlines has them.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
TEXT_BLOCKS = ("text", "input_text", "output_text")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


@F.pandas_udf(StringType())
def _lenient(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def decoded(raw: Column) -> Column:
    """Bytes as text, those that are no UTF-8 left out. Only rows that have such bytes go through Python."""
    plain = raw.cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(plain), plain), _lenient(F.when(~F.is_valid_utf8(plain), raw)))


def file_path(url: Column) -> Column:
    """The path of a file's URL as Spark's metadata gives it: no scheme file:, percent escapes undone."""
    return F.url_decode(F.replace(F.regexp_replace(url, "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def newlines(c: Column) -> Column:
    """Text as read in text mode: every line end is \\n."""
    return F.regexp_replace(c, "\r\n?", "\n")


def lines(c: Column) -> Column:
    """The lines of a text; the piece after a final line end is none."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_code(c: Column) -> Column:
    """Without fenced code, then HTML comments, then inline code."""
    c = F.regexp_replace(c, r"(?s)```.*?```|~~~.*?~~~", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(c, r"`[^`\n]*`", "")


def clean_message(c: Column, cap: int = 4000) -> Column:
    """A chat message stripped, emptied if a tool wrote it, white space before line ends dropped, cut at cap."""
    t = strip(F.coalesce(c, F.lit("")))
    t = F.when(t.startswith("<environment_context>") | t.startswith("<command-") | t.startswith("Caveat:"), "").otherwise(F.regexp_replace(t, r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]+\n", "\n"))
    return F.when(F.length(t) > cap, F.concat(F.left(t, F.lit(cap)), F.lit("\n…[truncated "), (F.length(t) - cap).cast("string"), F.lit(" chars]"))).otherwise(t)


def content_text(v: Column) -> Column:
    """The text of a message's content, a variant: a string as it is, or the text blocks of a list, one a line."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    text = lambda b: F.try_variant_get(b, "$.text", "string")
    kept = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(*TEXT_BLOCKS) & (F.coalesce(text(b), F.lit("")) != ""))
    shape = F.schema_of_variant(v)
    return F.when(shape == "STRING", F.try_variant_get(v, "$", "string")).when(shape.startswith("ARRAY"), F.coalesce(F.array_join(F.transform(kept, text), "\n"), F.lit(""))).otherwise("")


def mask(c: Column, allowed: tuple[str, ...]) -> Column:
    """Each allowed part as spaces of the same length, in order, so that places stay."""
    for a in allowed:
        c = F.replace(c, F.lit(a), F.lit(" " * len(a)))
    return c


def snippet(c: Column, most: int = 60) -> Column:
    t = strip(c)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most - 3)), F.lit("…"))).otherwise(t)


def content_key(c: Column) -> Column:
    """A page without its dates, for comparing what it says."""
    return F.regexp_replace(c, r"(?m)^updated:.*$", "updated:")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)\z", 1)


def normal_path(c: Column) -> Column:
    """posixpath.normpath as an expression: empty and `.` segments go, `..` takes the one before."""
    rooted = c.startswith("/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(x.isin("", "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).when((x == "..") & rooted, acc).otherwise(F.concat(acc, F.array(x)))

    out = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(F.split(c, "/"), empty, step), "/"))
    return F.when(out == "", ".").otherwise(out)


def version_key(tag: Column) -> Column:
    """`v0.10` as [0, 10]; null for what isn't a plain version."""
    own = F.regexp_extract(tag, r"^v?(\d++(?:\.\d++)*+)$", 1)
    return F.when(own != "", F.transform(F.split(own, r"\."), lambda x: x.cast("bigint")))


def source_version(source: Column, pin: Column | None = None) -> Column:
    """The version a program states: the pin first, then its VERSION line, else `unknown`."""
    found = F.regexp_extract(source, r"(?m)^VERSION\s*=\s*[\"']([^\"']+)", 1)
    return F.coalesce(*([F.nullif(strip(pin), F.lit(""))] if pin is not None else []), F.nullif(found, F.lit("")), F.lit("unknown"))


def rate_text(c: Column) -> Column:
    """A percentage without decimals, halves to even; null: n/a."""
    return F.when(c.isNull(), "n/a").otherwise(F.concat(F.bround(c, 0).cast("bigint").cast("string"), F.lit("%")))


def first_rule(text: Column, rules: tuple[tuple[str, Column | str], ...], default: Column | str) -> Column:
    """The name of the first rule whose part the lower-cased text holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, part in reversed(rules):
        out = F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part)), name).otherwise(out)
    return out
