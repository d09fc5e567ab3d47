"""Secret scans with corpus-wide ownership.

Patterns give candidates with their places; each candidate value is hashed, and the corpus is asked by how many distinct
owners and repositories a value is held. A value of more than MAX_OWNERS owners, or of more than MAX_REPOSITORIES
repositories whatever their owners, is a widely copied example; others are live-looking credentials of their owner.
Repositories that hold it in copies of one text are one. BASE patterns are findings whatever the corpus says; MORE patterns, and BARE
(long tokens of lower case, upper case and digits), are so only for live-looking values: a documentation key that
everybody copies is no finding, the same shape held by one owner is.

All of it is SQL expressions; the text is read by one scan, behind a cheap test, and what follows handles candidates
only: places are running sums over the matches of one text, which meet in a task and in no array that grows match by
match. Sums over a hot value are partial aggregates; its spans meet their verdict in a plain equi-join that adaptive
execution splits.

Defined cases: null text counts as empty; a null owner or repository counts as one; repeated rows are rows of their own,
of one repository; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.shared import written

MAX_OWNERS = 2
MAX_REPOSITORIES = 10
# Fixed patterns: kind, pattern, group that holds the value, least length of the value, cheap test.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, r"(?i)password|passwd|secret|token|api_?key"),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
]
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, r"xox[abprs]-"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, r"AIza[A-Za-z0-9_-]{35}"),
    ("sk", r"sk-[A-Za-z0-9_-]{20,}", 0, 23, r"sk-[A-Za-z0-9_-]{20}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 30, r"eyJ[A-Za-z0-9_-]{10}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----", 0, 60, r"PRIVATE KEY-----"),
    ("bare", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}", 0, 24, r"[A-Za-z0-9+/_=-]{24}"),
]
# What a start without a match proves to be without one, and is passed over at once: the rest of the text (no end mark
# comes), the rest of the run (what follows it stays the same). Else each start in it would look as far in vain.
VAIN = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*)",
    "jwt": r"eyJ[A-Za-z0-9_-]*+",
}
KINDS = [k for k, *_ in BASE + MORE]
_BARE = len(KINDS) - 1
_SPAN = "array<struct<start: bigint, rank: int, end: bigint, value: string, live: boolean>>"
#: Texts are cut out of pieces of so many code points, so that a place far into a text costs no walk from its start.
PIECE = 4096


def matches(text: Column, rank: int, pattern: str, group: int, least: int, test: str) -> Column:
    """Leftmost non-overlapping matches of one kind, in order, as (rank, gap, length, value): the code points between
    the match and the one before, and of the match itself. What VAIN passes over stands among them, its value empty."""
    vain = VAIN.get(KINDS[rank])
    some = f"{pattern}|{vain}" if vain else pattern
    found = F.regexp_extract_all(text, F.lit(f"({some})"), F.lit(1))
    gaps = F.split(text, some)
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    if vain:
        value = lambda m: F.regexp_extract(m, rf"\A(?:{pattern})\z", 0)
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")), lambda x: F.struct(F.lit(rank).alias("rank"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("length"), value(x["m"]).alias("value")))
    return F.when(text.rlike(test), rows).otherwise(F.array().cast("array<struct<rank: int, gap: int, length: int, value: string>>"))


def candidates(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", *more: Column) -> DataFrame:
    """One row per document, written: row (its number, fixed by that), owner, repository, mark (a hash of its text), hits
    (the matches of all kinds), and more."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*(matches(t, i, p, g, n, test) for i, (_, p, g, n, test) in enumerate(BASE + MORE)))
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return written(docs.select(F.monotonically_increasing_id().alias("row"), held(owner).alias("owner"), held(repository).alias("repository"), F.xxhash64(t).alias("mark"), every.alias("hits"), *more), "secret-candidates")


def spans(found: DataFrame) -> DataFrame:
    """(row, owner, repository, mark, start, rank, end, value, hash) of every candidate, written. Bare ones that begin
    within another kind's are left out. All windows are over the matches of one text."""
    df = found.where("size(hits) > 0").select("row", "owner", "repository", "mark", F.posexplode("hits").alias("k", "x")).select("row", "owner", "repository", "mark", "k", "x.*").repartition("row")
    kind = Window.partitionBy("row", "rank").orderBy("k")
    df = df.withColumn("end", F.sum((F.col("gap") + F.col("length")).cast("long")).over(kind)).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*(F.lit(n) for *_, n, _ in BASE + MORE)), F.col("rank") + 1)
    df = df.where(F.length("value") >= least)
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("covered", F.max(F.when(F.col("rank") != _BARE, F.col("end"))).over(before))
    df = df.where((F.col("rank") != _BARE) | F.col("covered").isNull() | (F.col("start") >= F.col("covered")))
    return written(df.select("row", "owner", "repository", "mark", "start", "rank", "end", "value", F.sha2("value", 256).alias("hash")), "secret-spans")


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of every candidate value; each distinct pair is summed up before the next step.
    A text counts for the least of its repositories."""
    owners = rows.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    texts = rows.groupBy("hash", "mark").agg(F.min("repository").alias("repository"))
    repositories = texts.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_repositories"))
    return owners.join(repositories, "hash")


def judged(rows: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """The spans that are findings, with live."""
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    return rows.join(ownership(rows).select("hash", live.alias("live")), "hash").where((F.col("rank") < len(BASE)) | F.col("live"))


def scanned(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: doc_id, row, findings (start, rank, end, value, live), in order of start and kind."""
    found = candidates(docs, text, owner, repository, F.col("doc_id"))
    rows = judged(spans(found), max_owners, max_repositories)
    per_row = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "value", "live"))).alias("findings"))  # of one text
    return found.select("doc_id", "row").join(per_row, "row", "left").select("doc_id", "row", F.coalesce("findings", F.array().cast(_SPAN)).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text that stands in pieces of PIECE."""
    first = F.floor(start / PIECE).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(part, (start - first * PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def redacted(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with every live-looking finding in its text replaced by `[kind]`, overlapping ones by that of the first;
    n_chars follows where there is one."""
    own = docs.columns
    found = candidates(docs, text, owner, repository, F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"))
    rows = judged(spans(found), max_owners, max_repositories).where("live")
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.max("end").over(before), F.lit(0).cast("long")))
    per_row = rows.groupBy("row").agg(F.max("end").alias("last"), F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("at"), F.struct("start", "at", "rank")))).alias("gone"))  # of one text
    src, kinds = F.col(f"doc.`{text}`"), F.array(*map(F.lit, KINDS))
    df = found.select("row", "doc").join(per_row, "row", "left")
    df = df.withColumn("pieces", F.when(F.col("last").isNotNull(), F.regexp_extract_all(src, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    kept = F.transform("gone", lambda x: F.concat(cut(F.col("pieces"), x["at"], x["start"]), F.lit("["), F.element_at(kinds, x["rank"] + 1), F.lit("]")))
    clean = F.concat(F.array_join(kept, ""), cut(F.col("pieces"), F.col("last"), F.length(src)))
    df = df.withColumn("clean", F.when(F.col("last").isNull(), src).otherwise(clean))
    size = lambda c: F.when(F.col("last").isNull(), F.col("doc.n_chars")).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c)
    return df.select(*(F.col("clean").alias(c) if c == text else size(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in own))
