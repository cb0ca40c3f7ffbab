"""Search and token queries over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import domain_hits, english_terms, extension_weight, hunk_tokens, identifiers, is_specific, short_name, split_clauses, stable_id, stem, topic_tokens
from stratalens.operators import evidence, search, units

from .registry import query

TERMS = [(t, f"en:{t}") for t in ("that", "with", "heat", "from", "this", "loser")]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"))


def doc_matches(spark: SparkSession, d: str) -> DataFrame:
    return search.matches(search.lines(doc_files(spark, d)), TERMS)


_LINES = r"""
f AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, text FROM documents),
l AS (SELECT path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS text, unnest(range(1, len(regexp_split_to_array(text, '\r\n|\r|\n')) + 1)) AS line_no FROM f),
t(ord, term) AS (VALUES (0, 'that'), (1, 'with'), (2, 'heat'), (3, 'from'), (4, 'this'), (5, 'loser')),
a AS (SELECT path, line_no, text, term, row_number() OVER (PARTITION BY path, line_no ORDER BY ord) AS r FROM l JOIN t ON regexp_matches(l.text, '(?i)\b' || term || '\b')),
m AS (SELECT path, line_no, text, term, length(regexp_extract(text, '(?is)^(.*?)\b' || term || '\b', 1)) AS col FROM a WHERE r = 1),
"""
_KIND = r"""
k AS (SELECT *, CASE WHEN regexp_matches(ltrim(text), '^(//|\*|/\*|#)') THEN 'comment'
  WHEN regexp_matches(substr(text, 1, col), '[''"`][^''"`]*$') AND regexp_matches(substr(text, col + length(term) + 1), '^[^''"`]*[''"`]') THEN 'string'
  WHEN regexp_matches(substr(text, col + length(term) + 1), '^[\p{L}\p{N}_$]') OR regexp_matches(substr(text, 1, col), '[\p{L}\p{N}_$]$') THEN 'identifier' ELSE 'plain' END AS kind FROM m),
"""


@query("line_scan", r"WITH " + _LINES.split("t(ord")[0].rstrip().rstrip(",") + " SELECT path, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM l GROUP BY 1")
def line_scan(spark, d):
    return search.lines(doc_files(spark, d)).groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("term_matches", "WITH " + _LINES + " z AS (SELECT 1) SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, term FROM m")
def term_matches(spark, d):
    return doc_matches(spark, d).select("path", "line_no", "col", "term")


@query("hit_classify", "WITH " + _LINES + _KIND + " z AS (SELECT 1) SELECT kind, term, CAST(count(*) AS BIGINT) AS n, CAST(min(CASE kind WHEN 'comment' THEN 1.2 WHEN 'string' THEN 4.0 WHEN 'identifier' THEN 3.0 ELSE 2.0 END) AS DOUBLE) AS weight FROM k GROUP BY 1, 2")
def hit_classify(spark, d):
    m = doc_matches(spark, d).withColumn("kind", search.hit_kind(F.col("text"), F.col("col"), F.col("term")))
    return m.groupBy("kind", "term").agg(F.count("*").alias("n"), F.min(search.kind_weight(F.col("kind"))).alias("weight"))


_GROUPS = """
g AS (SELECT *, CASE kind WHEN 'comment' THEN 1.2::DOUBLE WHEN 'string' THEN 4 WHEN 'identifier' THEN 3 ELSE 2 END AS w, sum(s) OVER (PARTITION BY path ORDER BY line_no, col, term ROWS UNBOUNDED PRECEDING) AS grp
  FROM (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no, col, term) > 3 THEN 1 ELSE 0 END AS s FROM k)),
"""


@query("merge_window", "WITH " + _LINES + _KIND + _GROUPS + " z AS (SELECT 1) SELECT path, CAST(grp AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS n, CAST(min(line_no) AS INTEGER) AS line_start, CAST(max(line_no) AS INTEGER) AS line_end FROM g GROUP BY 1, 2")
def merge_window(spark, d):
    m = search.islands(doc_matches(spark, d), ["path"], ["line_no", "col", "term"], "line_no")
    return m.groupBy("path", "grp").agg(F.count("*").alias("n"), F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))


@query("locate_topk", "WITH " + _LINES + _KIND + _GROUPS + """
s AS (SELECT path, grp, count(*) AS n, min(line_no) AS line_start, max(line_no) AS line_end FROM g GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, grp) AS r FROM s) WHERE r <= 3),
sh AS (SELECT path, grp, line_no, count(DISTINCT term) AS terms FROM g GROUP BY 1, 2, 3),
b AS (SELECT path, grp, term, w, line_no FROM (SELECT *, row_number() OVER (PARTITION BY path, grp, term ORDER BY w DESC, line_no, col) AS r FROM g) WHERE r = 1),
p AS (SELECT b.path, b.grp, sum(w * CASE WHEN terms >= 2 THEN 1.3::DOUBLE ELSE 1 END) + sum(least(0.25::DOUBLE, w / 16)) AS x FROM b JOIN sh USING (path, grp, line_no) GROUP BY 1, 2)
SELECT path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, round(x * 0.6::DOUBLE, 3) AS score, CAST(n AS BIGINT) AS n_hits FROM top JOIN p USING (path, grp) ORDER BY score DESC, path, line_start LIMIT 20""")
def locate_topk(spark, d):
    return search.top_k(search.locate_groups(doc_matches(spark, d), TERMS), 20)


@query("filename_bonus", r"""SELECT url, CAST(CASE WHEN contains(st, 'page') THEN 6 WHEN contains(p, 'page') THEN 3 ELSE 0 END + CASE WHEN contains(st, 'en') THEN 6 WHEN contains(p, 'en') THEN 3 ELSE 0 END + CASE WHEN contains(st, '1') THEN 6 WHEN contains(p, '1') THEN 3 ELSE 0 END AS DOUBLE) AS bonus, st AS stem
FROM (SELECT url, lower(url) AS p, lower(regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1)) AS st FROM pages)""")
def filename_bonus(spark, d):
    return table(spark, d, "pages").select("url", search.filename_bonus(F.col("url"), [("page", ""), ("en", ""), ("1", "")]).alias("bonus"), F.lower(stem("url")).alias("stem"))


@query("route_extract", r"""SELECT route, CAST(count(*) AS BIGINT) AS n FROM (SELECT '/' || array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '')[1:2], '/') AS route FROM pages) GROUP BY 1""")
def route_extract(spark, d):
    parts = F.filter(F.split(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/"), lambda x: x != "")
    return table(spark, d, "pages").select(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


@query("extension_weight", "SELECT p_type, CAST(CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS weight, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def extension_weights(spark, d):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("a/b.tsx", "q.sql", "x/y.Json", "m.css", "none")]), (F.pmod("p_size", F.lit(5)) + 1).cast("int"))
    return table(spark, d, "part").select("p_type", extension_weight(kinds).alias("weight")).groupBy("p_type", "weight").agg(F.count("*").alias("n"))


@query("identifier_tokens", r"SELECT item_id, CAST(len(x) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(x)), ' ') AS tokens FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS x FROM benchmark)")
def identifier_tokens(spark, d):
    t = table(spark, d, "benchmark").select("item_id", identifiers("text").alias("x"))
    return t.select("item_id", F.size("x").cast("bigint").alias("n"), F.array_join(F.array_sort(F.array_distinct("x")), " ").alias("tokens"))


_STOPS = ", ".join(f"'{w}'" for w in fixed.HUNK_STOP)
_TOPIC = ", ".join(f"'{w}'" for w in fixed.TOPIC_STOP)


@query("hunk_tokens", rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{{2,}}'), lambda x: lower(x)), lambda x: NOT list_contains([{_STOPS}], x)))), ' ') AS tokens FROM benchmark")
def hunk_token_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(hunk_tokens("text"), " ").alias("tokens"))


_TOPICS = rf"list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: NOT list_contains([{_TOPIC}], x) AND NOT regexp_full_match(x, '[0-9a-f]{{6,}}'))))"


@query("topic_tokens", f"SELECT item_id, array_to_string({_TOPICS}, ' ') AS topics FROM benchmark")
def topic_token_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(topic_tokens("text"), " ").alias("topics"))


@query("conflict_pairs", f"""WITH t AS (SELECT item_id, {_TOPICS} AS tokens FROM benchmark),
s AS (SELECT item_id, tokens, unnest(list_filter(tokens, lambda x: regexp_matches(x, '[A-Z_0-9]'))) AS k FROM t)
SELECT a.item_id AS a, b.item_id AS b, string_agg(DISTINCT a.k, ' ' ORDER BY a.k) AS topic FROM s a JOIN s b ON a.k = b.k AND a.item_id < b.item_id AND a.tokens <> b.tokens GROUP BY 1, 2""")
def conflict_pairs(spark, d):
    return evidence.conflicts(table(spark, d, "benchmark").select(F.col("item_id").alias("finding_id"), F.col("text").alias("statement")))


@query("specific_tokens", f"SELECT item_id, CAST(len(list_filter({_TOPICS}, lambda x: regexp_matches(x, '[A-Z_0-9]'))) AS BIGINT) AS n FROM benchmark")
def specific_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(F.filter(topic_tokens("text"), is_specific)).cast("bigint").alias("n"))


@query("camel_tokens")
def camel_tokens(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(english_terms("text"), " ").alias("terms"))


@query("stable_id")
def stable_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", stable_id("p_name", "p_brand", F.col("p_partkey").cast("string")).alias("id"))


@query("short_names", "SELECT p_partkey, string_split(p_brand || '::' || p_type || '::' || p_name, '::')[-1] AS short FROM part")
def short_name_query(spark, d):
    return table(spark, d, "part").select("p_partkey", short_name(F.concat_ws("::", "p_brand", "p_type", "p_name")).alias("short"))


@query("quoted_strings", r"""SELECT page_id, CAST(len(x) AS BIGINT) AS n, array_to_string(x[1:5], '|') AS firsts FROM (SELECT page_id, regexp_extract_all(html, '"([^"]*)"', 1) AS x FROM pages)""")
def quoted_strings(spark, d):
    x = F.regexp_extract_all("html", F.lit('"([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(x).cast("bigint").alias("n"), F.array_join(F.slice(x, 1, 5), "|").alias("firsts"))


@query("split_clauses", """SELECT conv_id, turn, CASE WHEN p = 0 THEN text ELSE substr(text, 1, p - 1) END AS problem, CASE WHEN p = 0 THEN '' ELSE substr(text, p + 4) END AS keep FROM (SELECT conv_id, turn, text, instr(text, 'keep') AS p FROM conversations)""")
def split_clause_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", split_clauses("text").alias("c")).select("conv_id", "turn", "c.problem", "c.keep")


def _domain_rows() -> str:
    return ", ".join(f"('{dom}', {i}, '{t}')" for i, (dom, ts) in enumerate(fixed.DOMAINS.items()) for t in ts)


@query("domain_strength", f"WITH t(domain, ord, trig) AS (VALUES {_domain_rows()}) SELECT page_id, domain, CAST(count(*) AS INTEGER) AS hits FROM pages JOIN t ON contains(lower(html), trig) GROUP BY 1, 2")
def domain_strength(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(domain_hits("html")).alias("domain", "hits"))


@query("unit_label", f"""WITH t(domain, ord, trig) AS (VALUES {_domain_rows()}), s AS (SELECT page_id, domain, ord, count(*) AS n FROM pages JOIN t ON contains(lower(html), trig) GROUP BY 1, 2, 3)
SELECT page_id, coalesce(label, 'mixed') AS label FROM pages LEFT JOIN (SELECT page_id, domain AS label FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, ord) AS r FROM s) WHERE r = 1) USING (page_id)""")
def unit_label(spark, d):
    order = F.create_map(*[x for i, k in enumerate(fixed.DOMAINS) for x in (F.lit(k), F.lit(i))])
    pages = table(spark, d, "pages")
    s = pages.select("page_id", F.explode(domain_hits("html")).alias("domain", "n")).withColumn("ord", F.element_at(order, F.col("domain")))
    return pages.select("page_id").join(units.label_by_domain(s, ["page_id"], "domain", "n", "ord"), "page_id", "left").select("page_id", F.coalesce("label", F.lit("mixed")).alias("label"))


@query("context_budget", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(max(used) AS BIGINT) AS used FROM (SELECT source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 24000 GROUP BY 1")
def context_budget(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return search.context_budget(docs, "n_chars", ["doc_id"], 24000, ["source"]).groupBy("source").agg(F.count("*").alias("n"), F.max("used").alias("used"))


@query("content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
