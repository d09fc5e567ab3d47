"""The queries of this subpackage, (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.llm import chat_format, forest, lang_id, mixing, secrets, url_filter, whitening
from shardwright.llm.decontaminate import contaminated
from shardwright.llm.fingerprint import fingerprints
from shardwright.llm.license_scan import license_scan
from shardwright.llm.ngram_join import ngram_join
from shardwright.llm.ppm import ppm_scores
from shardwright.llm.shared import fold, table
from shardwright.llm.token_align import aligned


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = lang_id.fit(docs.where(~held))
    return lang_id.predict(docs, model, "doc_id", held.alias("held_out"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = "</s>[INST] ok [/INST]"
    record = spark.createDataFrame([(-7, f'{{"messages": [{{"role": "user", "content": "{text}"}}, {{"role": "assistant", "content": "{text}"}}]}}')], "conv_id long, payload string")
    turns = chat_format.turns_of_rows(rows, ["conv_id", "turn", "role", "text"]).unionByName(chat_format.turns_of_payloads(record))
    out = chat_format.formatted(turns).withColumn("t", chat_format.read_back(F.col("formatted"), F.col("mask")))
    every = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: x["masked"]), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secrets.scanned(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["rank"] < len(secrets.BASE))
    count = lambda f: F.size(F.filter("findings", f)).cast("long")
    of_kind = lambda k: lambda x: x["rank"] == k
    return df.select(
        "doc_id",
        *(count(of_kind(k)).alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.BASE)),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("findings")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_example"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_language_id, op2_chat_format, op3_decontamination, op4_license_scan, op5_lm_scores, op6_source_mix, op7_fingerprints, op8_secret_scan, op9_url_filter, op10_ngram_join, op11_nearest_neighbours, op12_embedding_whitening, op13_token_alignment)
    return {f.__name__: f for f in every}


_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, length(regexp_replace(replace(replace(role, '&', '&a'), chr(10), '&n'), '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g'))
    + length(regexp_replace(text, '<\|(\\*)(im_start|im_end)\|>', '<|\\\1\2|>', 'g')) + 24 AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s0 AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY no_source, source_key) AS rank FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2, 1][((rank - 1) % 3 + 1)::BIGINT] AS weight, (3 * source_size)::DOUBLE AS most FROM s1),
s3 AS (SELECT *, row_number() OVER o AS place,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s2 WINDOW o AS (ORDER BY most / weight, rank), b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT no_source, source_key, source_size,
    CASE WHEN most <= weight * level THEN most ELSE weight * (min_by(level, place) FILTER (WHERE most > weight * level) OVER ()) END AS target FROM s3),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY no_source, source_key ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin,
    row_number() OVER () AS uid, sum(size) OVER () AS budget FROM d JOIN s USING (no_source, source_key)),
e AS (SELECT *, CASE WHEN target = 0 THEN 0 ELSE (begin + i * source_size + size)::DOUBLE / target END AS finish, greatest(0, least(size, round(target)::BIGINT - begin - i * source_size)) AS sent
  FROM (SELECT *, unnest([0, 1, 2]) AS i FROM q)),
c AS (SELECT *, coalesce(sum(sent) OVER (ORDER BY finish, no_source, source_key, i, draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(sent, budget - before)))::BIGINT AS taken FROM c GROUP BY uid, doc_id, size, source_size, target
"""

_URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url, html FROM pages),
u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, url, html FROM p),
l AS (SELECT host, path, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^\s"''>]+)', 1)) AS link FROM u),
e0 AS (SELECT host || path AS a, translate(regexp_extract(substr(link, strpos(link, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(substr(link, strpos(link, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS b FROM l WHERE strpos(link, '://') > 0),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
m AS (SELECT r.a, max((f.verdict = 'allow')::INT) AS allow FROM reach r JOIN f ON f.host || f.path = r.b GROUP BY r.a)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE m.allow WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN f USING (host, path) LEFT JOIN m ON m.a = host || path
"""




def _secret_sql() -> str:
    """DuckDB has no look-around: bare tokens are its runs of 24 characters or more that hold all three kinds of
    characters; and its case folding goes beyond ASCII, so names of either case are spelt out."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    parts = []
    for i, (kind, pattern, group, least, _) in enumerate(secrets.BASE + secrets.MORE):
        more = ""
        if kind == "assign":
            pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{names})")
        if kind == "bare":
            pattern, more = "[A-Za-z0-9+/_=-]{24,}", " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')"
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT rid, {i} AS rank, '{kind}' AS kind, v, stop - length(m) AS start, stop FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY k) AS stop FROM (
  SELECT rid, unnest(f) AS m, unnest(x) AS v, unnest(string_split_regex(t, '{pattern}')[:len(f)]) AS g, unnest(range(len(f))) AS k FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS f, regexp_extract_all(t, '{pattern}', {group}) AS x FROM d)))
  WHERE length(v) >= {least}{more}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
a AS ({' UNION ALL '.join(parts)}),
b AS (SELECT *, max(CASE WHEN kind <> 'bare' THEN stop END) OVER (PARTITION BY rid ORDER BY start, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cover FROM a),
c AS (SELECT b.*, owner, t, doc_id FROM b JOIN d USING (rid) WHERE kind <> 'bare' OR cover IS NULL OR start >= cover),
o AS (SELECT v, count(DISTINCT owner) AS n_owners FROM c GROUP BY v),
r AS (SELECT v, count(DISTINCT least) AS n_repositories FROM (SELECT v, t, min(coalesce(doc_id::VARCHAR, '')) AS least FROM c GROUP BY v, t) GROUP BY v),
f AS (SELECT c.*, n_owners <= {secrets.MAX_OWNERS} AND n_repositories <= {secrets.MAX_REPOSITORIES} AS live, concat_ws(':', kind, start, stop) AS shown FROM c JOIN o USING (v) JOIN r USING (v)),
g AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(shown, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example
  FROM f WHERE rank < 3 OR live GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _CHAT_SQL, "op6_source_mix": _MIX_SQL, "op8_secret_scan": _secret_sql(), "op9_url_filter": _URL_SQL}
