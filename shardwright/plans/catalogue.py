"""The catalogue of queries: each runs an operator over whole driver tables, which stand in for vaults, transcripts and
exports, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardwright.config import DigestConfig, StaleConfig
from shardwright.functions import frontmatter, text
from shardwright.operators import digest, evalstats, history, kit, leaks, lint, links, nav, staleness

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- leaks
_MASKED = "line"
for _a in leaks.ALLOW:
    _MASKED = f"replace({_MASKED}, {_q(_a)}, {_q(' ' * len(_a))})"
_LINES = r"""lines AS (SELECT doc_id, source, unnest(CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END) AS line, unnest(range(1, len(l) + 1 - (l[len(l)] = '')::INT)) AS line_no
  FROM (SELECT doc_id, source, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS l FROM documents))"""
_HITS = f"""{_LINES},
masked AS (SELECT doc_id, source, line_no, {_MASKED} AS m FROM lines),
found AS ({' UNION ALL '.join(f"SELECT doc_id, source, line_no, {_q(label)} AS label, trim(regexp_extract(m, {_q(p)}), ' ' || chr(9)) AS s FROM masked WHERE regexp_matches(m, {_q(p)})" for label, p in leaks.RULES)}),
hits AS (SELECT doc_id, source, line_no::BIGINT AS line_no, label, CASE WHEN length(s) > 60 THEN substr(s, 1, 57) || '…' ELSE s END AS snippet FROM found)"""


def _doc_hits(spark, sf_dir):
    return leaks.hits(t(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query(f"WITH {_HITS} SELECT doc_id, line_no, label, snippet FROM hits")
def q01_leak_hits(spark, sf_dir):
    return _doc_hits(spark, sf_dir).select("doc_id", "line_no", "label", "snippet")


@query(f"WITH {_HITS} SELECT label, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY label")
def q02_leak_summary(spark, sf_dir):
    return leaks.summary(_doc_hits(spark, sf_dir))


@query(f"WITH {_HITS} SELECT source, label, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY source, label")
def q03_leak_by_source(spark, sf_dir):
    return leaks.summary(_doc_hits(spark, sf_dir), "source")


# ---- transcripts
_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = rf"""msgs AS (SELECT conv_id, turn, role, CASE WHEN length(c) > 4000 THEN substr(c, 1, 4000) || chr(10) || '…[truncated ' || (length(c) - 4000) || ' chars]' ELSE c END AS text
  FROM (SELECT conv_id, turn, role, CASE WHEN starts_with(s, '<environment_context>') OR starts_with(s, '<command-') OR starts_with(s, 'Caveat:') THEN '' ELSE regexp_replace(s, '{_WS}+\n', chr(10), 'g') END AS c
    FROM (SELECT *, regexp_replace(coalesce(text, ''), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM conversations WHERE role IN ('user', 'assistant'))) WHERE length(c) >= 12)"""


def _messages(spark, sf_dir):
    return digest.messages(t(spark, sf_dir, "conversations"))


@query(f"WITH {_CLEAN} SELECT conv_id, turn, role, text FROM msgs")
def q05_messages_clean(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", "role", "text")


@query(f"WITH {_CLEAN} SELECT conv_id, count(*) AS n_messages, string_agg('## ' || role || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn, role, text) AS body, sum(strlen('## ' || role || chr(10) || text || chr(10) || chr(10)))::BIGINT AS n_bytes FROM msgs GROUP BY conv_id")
def q06_session_digest(spark, sf_dir):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"], F.lit("\n\n"))), "")
    df = _messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_messages"), body.alias("body"))
    return df.withColumn("n_bytes", F.octet_length("body").cast("long"))


_BUCKETS = DigestConfig(match="src", buckets=DigestConfig.rules("tens=src1,Twos=SRC2,bad,zero=src0"))


@query("""WITH b AS (SELECT CASE WHEN contains(lower(coalesce(source, '')), 'src1') THEN 'tens' WHEN contains(lower(coalesce(source, '')), 'src2') THEN 'Twos' WHEN contains(lower(coalesce(source, '')), 'src0') THEN 'zero'
  WHEN contains(lower(coalesce(source, '')), 'src') THEN 'main' ELSE 'other' END AS bucket, doc_id, strlen(text) AS n FROM documents)
SELECT bucket, count(*) AS sessions, sum(n)::BIGINT AS bytes, min(doc_id) AS first_seen, (sum(n) // 1024)::BIGINT AS kb FROM b GROUP BY bucket""")
def q07_bucket_stats(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", digest.bucket(F.col("source"), _BUCKETS).alias("bucket"), F.octet_length("text").cast("long").alias("n_bytes"))
    return digest.bucket_stats(df, order="doc_id")


@query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def q08_session_meta(spark, sf_dir):
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT doc_id FROM documents WHERE contains(lower(substr(text, 1, 200000)), 'license')")
def q09_candidates(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(digest.mentions(F.col("text"), "License")).select("doc_id")


# ---- lint
@query("""WITH r AS (SELECT d.doc_id, d.lang, d.source, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, 'error' AS severity, 'lang' AS field FROM r WHERE coalesce(lang, '') = ''
UNION ALL SELECT doc_id, 'error', 'quality' FROM r WHERE coalesce(quality, '') = ''
UNION ALL SELECT doc_id, 'warn', 'toxic' FROM r WHERE coalesce(toxic, '') = ''""")
def q10_lint_required(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    absent = lambda names, severity: F.transform(F.filter(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("v")) for n in names)), lambda x: F.coalesce(x["v"], F.lit("")) == ""), lambda x: F.struct(F.lit(severity).alias("severity"), x["field"].alias("field")))
    return df.select("doc_id", F.explode(F.concat(absent(("lang", "quality"), "error"), absent(("toxic",), "warn"))).alias("x")).select("doc_id", "x.severity", "x.field")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def q11_lint_enum(spark, sf_dir):
    return t(spark, sf_dir, "events").where(~F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("SELECT md5(text) AS name, array_to_string(list(doc_id ORDER BY doc_id), ',') AS places FROM documents WHERE text <> '' GROUP BY md5(text) HAVING count(*) > 1")
def q12_lint_duplicates(spark, sf_dir):
    df = t(spark, sf_dir, "documents").where("text <> ''").select(F.md5("text").alias("name"), "doc_id", F.col("doc_id").alias("ord"))
    return lint.duplicates(df, place="doc_id").select("name", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


@query("SELECT p_partkey, regexp_matches(lower(replace(p_type, ' ', '-')), '^[a-z0-9]+(-[a-z0-9]+)*$') AS type_ok, regexp_matches(p_name, '^[a-z0-9]+(-[a-z0-9]+)*$') AS name_ok FROM part")
def q13_lint_kebab(spark, sf_dir):
    kebab = frontmatter.is_kebab
    return t(spark, sf_dir, "part").select("p_partkey", kebab(F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))).alias("type_ok"), kebab(F.col("p_name")).alias("name_ok"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines FROM documents WHERE length(text) - length(replace(text, chr(10), '')) > 20")
def q14_lint_length(spark, sf_dir):
    n = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long")
    return t(spark, sf_dir, "documents").select("doc_id", n.alias("n_lines")).where("n_lines > 20")


@query("""WITH f AS (SELECT 'error' AS severity FROM documents WHERE coalesce(lang, '') = '' UNION ALL SELECT 'warn' FROM documents WHERE length(text) - length(replace(text, chr(10), '')) > 20
  UNION ALL SELECT 'error' FROM (SELECT 1 FROM documents WHERE text <> '' GROUP BY md5(text) HAVING count(*) > 1)),
g AS (SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warn') AS warnings FROM f)
SELECT errors, warnings, (errors > 0)::INT AS exit_code, (errors + warnings > 0)::INT AS strict_exit_code FROM g""")
def q15_lint_gate(spark, sf_dir):
    one = lambda s: F.lit(s).alias("severity")
    found = t(spark, sf_dir, "documents").where(F.coalesce("lang", F.lit("")) == "").select(one("error"))
    found = found.unionByName(q14_lint_length(spark, sf_dir).select(one("warn"))).unionByName(q12_lint_duplicates(spark, sf_dir).select(one("error")))
    return lint.gate(found).withColumn("strict_exit_code", (F.col("errors") + F.col("warnings") > 0).cast("int"))


# ---- links
_HREFS = "hrefs AS (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS ord FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))"


def _hrefs(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href")).select("page_id", "href", F.col("ord").cast("long").alias("ord"))


_TARGET = r"regexp_replace(regexp_extract(trim(split_part(split_part(href, '|', 1), '#', 1)), '([^/]*)$', 1), '\.md$', '')"


@query(f"WITH {_HREFS} SELECT page_id, href, ord, {_TARGET} AS target FROM hrefs")
def q16_links_extract(spark, sf_dir):
    return _hrefs(spark, sf_dir).withColumn("target", links.wiki_target(F.col("href")))


@query(f"WITH {_HREFS}, x AS (SELECT *, {_TARGET} AS target FROM hrefs), n AS (SELECT target FROM x WHERE regexp_matches(target, '^[a-mA-M]')) SELECT page_id AS rel, target, ord FROM x WHERE target <> '' AND target NOT IN (SELECT target FROM n)")
def q17_links_broken(spark, sf_dir):
    """Names of the first half of the alphabet exist."""
    found = q16_links_extract(spark, sf_dir).select(F.col("page_id").alias("rel"), F.lit("wiki").alias("kind"), "target", "ord").where("target <> ''")
    return links.broken_wiki(found, found.where(F.col("target").rlike("^[a-mA-M]")).select("target").distinct())


@query(f"WITH {_HREFS}, n AS (SELECT href, count(*) AS n_uses, count(DISTINCT page_id) AS n_pages FROM hrefs GROUP BY href) SELECT page_id, ord, href, n_uses, n_pages FROM hrefs JOIN n USING (href)")
def q18_links_domains(spark, sf_dir):
    df = _hrefs(spark, sf_dir)
    per = df.groupBy("href").agg(F.count("*").alias("n_uses"), F.count_distinct("page_id").alias("n_pages"))
    return df.join(per, "href").select("page_id", "ord", "href", "n_uses", "n_pages")


# ---- staleness
_CLOCK = StaleConfig(days=14, today="2024-02-01")


@query("SELECT date_diff('day', d, DATE '2024-02-01') AS age_days, user_id FROM (SELECT user_id, max(ts)::DATE AS d FROM events GROUP BY user_id) WHERE date_diff('day', d, DATE '2024-02-01') > 2")
def q19_stale_queue(spark, sf_dir):
    df = t(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("d"))
    return df.select(staleness.ages(F.col("d"), _CLOCK).alias("age_days"), "user_id").where("age_days > 2").orderBy(F.desc("age_days"), F.desc("user_id"))


@query(f"""WITH {_HREFS}, c AS (SELECT DISTINCT page_id AS rel, href AS cited, regexp_extract(href, '([^/]*)$', 1) AS base FROM hrefs),
i AS (SELECT '/site' || href AS path, regexp_extract(href, '([^/]*)$', 1) AS base FROM hrefs WHERE regexp_matches(href, '^/[a-mA-M]'))
SELECT rel, cited FROM c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.base = c.base AND ends_with(i.path, c.cited))""")
def q21_anchor_missing(spark, sf_dir):
    """Paths of the first half of the alphabet exist."""
    df = _hrefs(spark, sf_dir).withColumn("base", text.basename(F.col("href")))
    cited = df.select(F.col("page_id").alias("rel"), F.col("href").alias("cited"), "base").distinct()
    index = df.where(F.col("href").rlike("^/[a-mA-M]")).select("href", "base").distinct().select(F.concat(F.lit("/site"), "href").alias("path"), "base")
    return staleness.missing_anchors(cited, index)


# ---- navigation
@query("""WITH g AS (SELECT coalesce(r_name, 'other') AS area, count(*) AS n, array_to_string(list(s_name ORDER BY s_suppkey, s_name), ',') AS names, min(s_suppkey) AS f,
  CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 0 END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT area, n, names, row_number() OVER (ORDER BY k = 0, k, f) AS place FROM g""")
def q22_moc_grouped(spark, sf_dir):
    df = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = nav.grouped(df.select(F.col("r_name").alias("area"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")), ("EUROPE", "ASIA"))
    return out.withColumn("names", F.array_join("names", ","))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS live, count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM 'O') AS rest FROM orders")
def q23_moc_split(spark, sf_dir):
    return nav.split_counts(t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "active").otherwise("resolved").alias("status")))


@query("SELECT source AS collection, count(*) AS n FROM documents GROUP BY ROLLUP (source)")
def q24_index_counts(spark, sf_dir):
    return nav.collection_counts(t(spark, sf_dir, "documents"), "source").withColumnRenamed("source", "collection")


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_returnflag = 'N'")
def q25_live_open(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "active").otherwise("resolved").alias("status"))
    x = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", nav.DECAYS).otherwise("durable").alias("volatility"))
    return o.join(x, F.col("o_orderkey") == F.col("l_orderkey")).where(nav.is_open_finding()).select("o_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT o_orderkey AS path, 'total ' || (o_orderkey % 7) AS k FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS path, 'total ' || CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_orderkey % 7 END AS k FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'extra' WHEN a.k = b.k THEN 'current' ELSE 'stale' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def q26_drift(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").cast("string").alias("d"))
    page = lambda k, day: F.concat(F.lit("updated: "), day, F.lit("\ntotal "), k.cast("string"))
    new = o.where("path % 5 <> 0").select("path", page(F.col("path") % 7, F.col("d")).alias("body"))
    old = o.where("path % 4 <> 0").select("path", page(F.when(F.col("path") % 3 == 0, 9).otherwise(F.col("path") % 7), F.lit("2020-01-01")).alias("body"))
    return nav.compare(new, old)


@query("SELECT r_name AS platform, r_name || '.md' AS path FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE') AND r_regionkey IN (SELECT n_regionkey FROM nation)")
def q27_orphans(spark, sf_dir):
    region = t(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("platform"), F.concat("r_name", F.lit(".md")).alias("path"))
    used = region.join(t(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    current = used.select("path", F.lit("# page\n\n<!-- generated by shardwright -->\n").alias("body"))
    return nav.orphans(current, region.select("platform", "path"), ("ASIA", "EUROPE"))


# ---- evaluation
_ARMS = "arms AS (SELECT doc_id, lang AS type, (quality = 1) AS on_applied, (toxic = 1) AS off_applied FROM documents LEFT JOIN labels USING (doc_id))"


def _arms(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", F.col("lang").alias("type"), (F.col("quality") == 1).alias("on_applied"), (F.col("toxic") == 1).alias("off_applied"))


@query(f"WITH {_ARMS} SELECT count(*) AS n, coalesce(avg(on_applied::INT) * 100, 0) AS on_rate, coalesce(avg(off_applied::INT) * 100, 0) AS off_rate FROM arms")
def q28_eval_headline(spark, sf_dir):
    return evalstats.headline(_arms(spark, sf_dir))


@query(f"WITH {_ARMS} SELECT coalesce(type, 'single-fact') AS type, count(*) AS n, avg(on_applied::INT) * 100 AS on_rate, avg(off_applied::INT) * 100 AS off_rate, avg(on_applied::INT) * 100 - avg(off_applied::INT) * 100 AS delta FROM arms GROUP BY 1")
def q29_eval_by_type(spark, sf_dir):
    return evalstats.by_type(_arms(spark, sf_dir))


@query(f"WITH {_ARMS} SELECT CASE WHEN on_applied IS NULL OR off_applied IS NULL THEN 'n/a' WHEN on_applied AND NOT off_applied THEN 'on only' WHEN on_applied AND off_applied THEN 'both' WHEN NOT on_applied AND NOT off_applied THEN 'neither' ELSE 'off only' END AS verdict, count(*) AS n FROM arms GROUP BY 1")
def q30_eval_verdicts(spark, sf_dir):
    return evalstats.verdicts(_arms(spark, sf_dir))


@query("SELECT CASE WHEN coalesce(text, '') <> '' AND coalesce(toxic, 0) = 0 THEN 'graded' ELSE 'excluded' END AS state, count(*) AS n FROM documents FULL JOIN labels USING (doc_id) GROUP BY 1")
def q31_eval_gradeable(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", "text").join(t(spark, sf_dir, "labels"), "doc_id", "full")
    m = F.struct(F.col("text").alias("result"), F.lit(None).cast("string").alias("error"), (F.coalesce("toxic", F.lit(0)) == 1).alias("is_error"))
    return df.select(F.when(evalstats.gradeable(m), "graded").otherwise("excluded").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


# ---- kit and history
@query("""SELECT coalesce(max_by(tag, [x::BIGINT for x in string_split(regexp_extract(tag, '^v?(\\d+(?:\\.\\d+)*)$', 1), '.')]), '') AS newest FROM (
  SELECT 'v' || n_regionkey || '.' || n_nationkey || CASE WHEN n_nationkey % 5 = 0 THEN '-rc1' ELSE '' END AS tag FROM nation) WHERE regexp_matches(tag, '^v?(\\d+(?:\\.\\d+)*)$')""".replace("\\\\", "\\"))
def q32_newest_version(spark, sf_dir):
    tag = F.concat(F.lit("v"), "n_regionkey", F.lit("."), "n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "-rc1").otherwise(""))
    return kit.newest(t(spark, sf_dir, "nation").select(tag.alias("tag")))


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 'NEW' WHEN p_partkey % 6 = 1 THEN 'UPD' ELSE 'same' END AS action FROM part WHERE p_partkey % 5 <> 0")
def q33_update_plan(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.col("p_name").alias("content"))
    local = p.where("name % 4 <> 0").withColumn("content", F.when(F.col("name") % 6 == 1, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    return kit.update_plan(p.where("name % 5 <> 0"), local)


@query("SELECT l_partkey AS path, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, path LIMIT 30")
def q34_hot_files(spark, sf_dir):
    return history.hot_files(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path")))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def q36_active_null_safe(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return df.where(nav.active(F.when(F.col("toxic") == 1, "resolved"))).select("doc_id")


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Gotchas' WHEN '2-HIGH' THEN 'Decisions' ELSE 'Tasks' END AS view, o_orderkey AS name, o_orderstatus AS area FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def q37_views(spark, sf_dir):
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "gotcha").when(F.col("o_orderpriority") == "2-HIGH", "decision").when(F.col("o_orderpriority") == "3-MEDIUM", "task").otherwise("none")
    rows = t(spark, sf_dir, "orders").select(kind.alias("type"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("area"), F.col("o_orderstatus").alias("status"), F.lit("durable").alias("volatility"), F.col("o_orderdate").alias("updated"))
    out = [history.view(rows, v).select(F.lit(v).alias("view"), "name", "area") for v in ("Gotchas", "Decisions", "Tasks")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- frontmatter
@query("SELECT doc_id, coalesce(source, '') AS last_value, coalesce(lang, '') AS first_value, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS n_keys FROM documents")
def q38_frontmatter_last_wins(spark, sf_dir):
    lang, src = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    page = F.concat(F.lit("---\nkey: "), lang, F.when(F.col("doc_id") % 3 == 0, "\nother:x").otherwise(""), F.lit("\nkey:  "), src, F.lit(" \nmy-key: no\n---\nbody: text"))
    df = t(spark, sf_dir, "documents").select("doc_id", frontmatter.entries(page).alias("e"))
    last, first = frontmatter.folded(F.col("e")), frontmatter.folded(F.col("e"), first=True)
    return df.select("doc_id", last["key"].alias("last_value"), first["key"].alias("first_value"), F.size(last).alias("n_keys"))


_VALUE = "CASE doc_id % 6 WHEN 0 THEN lang || ': x' WHEN 1 THEN lang || ' #' || doc_id WHEN 2 THEN lang WHEN 3 THEN '[' || lang || ']' WHEN 4 THEN '@' || lang || '\\\"' ELSE '\"' || lang || '\"' END"


@query("WITH v AS (SELECT doc_id, " + _VALUE.replace('\\\\\\"', '\\"').replace('\\"', '"').replace('"""', '"') + " AS v FROM documents WHERE lang IS NOT NULL) SELECT doc_id, v AS before, CASE WHEN doc_id % 6 IN (0, 1, 4) THEN '\"' || replace(replace(v, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE v END AS after FROM v")
def q39_repair(spark, sf_dir):
    k = F.col("doc_id") % 6
    v = F.when(k == 0, F.concat("lang", F.lit(": x"))).when(k == 1, F.concat("lang", F.lit(" #"), "doc_id")).when(k == 2, F.col("lang")).when(k == 3, F.concat(F.lit("["), "lang", F.lit("]"))).when(k == 4, F.concat(F.lit("@"), "lang", F.lit('"'))).otherwise(F.concat(F.lit('"'), "lang", F.lit('"')))
    df = t(spark, sf_dir, "documents").where("lang is not null").select("doc_id", v.alias("before"))
    fixed = frontmatter.repaired(F.concat(F.lit("---\nkey: "), "before", F.lit("\n---\nbody\n")))
    return df.select("doc_id", "before", F.regexp_extract(fixed, "(?s)^---\nkey: (.*)\n---\nbody\n$", 1).alias("after"))


@query()
def q40_text_diff(spark, sf_dir):
    new = F.regexp_replace("text", r"\bthe\b", "a")
    return t(spark, sf_dir, "documents").select("doc_id", kit.unified_diff(F.col("text"), new).alias("diff"))


# ---- prose methods
@query("SELECT bucket, doc_id, floor(coalesce(sum(n) OVER (PARTITION BY bucket ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 350000)::BIGINT AS chunk FROM (SELECT source AS bucket, doc_id, strlen(text) AS n FROM documents)")
def q41_digest_chunks(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return digest.chunks(df, order="doc_id").select("bucket", "doc_id", "chunk")


@query(f"WITH {_HREFS}, x AS (SELECT page_id, {_TARGET} AS target FROM hrefs) SELECT target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM x WHERE target <> '' GROUP BY target")
def q42_backlinks(spark, sf_dir):
    return links.backlinks(q16_links_extract(spark, sf_dir).where("target <> ''").select(F.col("page_id").alias("rel"), F.lit("wiki").alias("kind"), "target"))


@query("SELECT count(*) AS pages, floor(sum(length(text)) / 4)::BIGINT AS tokens_estimate, count(*) FILTER (WHERE n_chars > 10000) AS core_items, (count(*) > 200 OR floor(sum(length(text)) / 4) > 100000 OR count(*) FILTER (WHERE n_chars > 10000) > 30) AS over FROM documents")
def q43_size_test(spark, sf_dir):
    return history.size_test(t(spark, sf_dir, "documents").withColumn("core", F.col("n_chars") > 10000))
