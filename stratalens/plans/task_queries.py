"""Queries over tables of tasks: benchmark items ask for their long words in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import batch_search, lifecycle, metrics, search
from stratalens.operators.scratch import dealt, written

from .registry import query
from .search_queries import doc_files, table

_TASKS = r"""
f AS MATERIALIZED (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, text FROM documents),
l AS MATERIALIZED (SELECT path, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS text, unnest(range(1, len(regexp_split_to_array(text, '\r\n|\r|\n')) + 1)) AS line_no FROM f),
tm AS MATERIALIZED (SELECT item_id AS task_id, term, min(ord) AS ord FROM (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS ord FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{9,}') AS w FROM benchmark)) GROUP BY 1, 2),
tok AS (SELECT DISTINCT path, line_no, text, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+')) AS k FROM l),
a AS (SELECT task_id, path, line_no, text, term, row_number() OVER (PARTITION BY task_id, path, line_no ORDER BY ord) AS r FROM tok JOIN tm ON tok.k = lower(tm.term)),
m AS MATERIALIZED (SELECT task_id, path, line_no, text, term, length(regexp_extract(text, '(?is)^(.*?)\b' || term || '\b', 1)) AS col FROM a WHERE r = 1)
"""


def item_terms(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]{9,})"))).alias("ord", "term"))
    return batch_search.keyed(words.groupBy("task_id", "term").agg(F.min("ord").alias("ord")).withColumn("origin", F.concat(F.lit("en:"), "term")))


def _matches(spark, d) -> DataFrame:
    return batch_search.matches(search.lines(doc_files(spark, d)), item_terms(spark, d), places=batch_search.token_places)


@query("task_matches", f"WITH {_TASKS} SELECT task_id, path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, term FROM m")
def task_matches(spark, d):
    return _matches(spark, d).select("task_id", "path", "line_no", "col", "term")


_LOCATED = _TASKS + r""",
k AS (SELECT *, CASE WHEN regexp_matches(ltrim(text), '^(//|\*|/\*|#)') THEN 1.2::DOUBLE
  WHEN regexp_matches(substr(text, 1, col), '[''"`][^''"`]*$') AND regexp_matches(substr(text, col + length(term) + 1), '^[^''"`]*[''"`]') THEN 4
  WHEN regexp_matches(substr(text, col + length(term) + 1), '^[\p{L}\p{N}_$]') OR regexp_matches(substr(text, 1, col), '[\p{L}\p{N}_$]$') THEN 3 ELSE 2 END AS w FROM m),
g AS (SELECT *, sum(s) OVER (PARTITION BY task_id, path ORDER BY line_no, col, term ROWS UNBOUNDED PRECEDING) AS grp
  FROM (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY task_id, path ORDER BY line_no, col, term) > 3 THEN 1 ELSE 0 END AS s FROM k)),
s AS (SELECT task_id, path, grp, count(*) AS n, min(line_no) AS line_start, max(line_no) AS line_end FROM g GROUP BY 1, 2, 3),
top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task_id, path ORDER BY n DESC, grp) <= 3),
b AS (SELECT task_id, path, grp, term, w FROM g QUALIFY row_number() OVER (PARTITION BY task_id, path, grp, term ORDER BY w DESC, line_no, col) = 1),
p AS (SELECT task_id, path, grp, sum(w) + sum(least(0.25::DOUBLE, w / 16)) AS x FROM b GROUP BY 1, 2, 3),
c AS (SELECT task_id, path, line_start, line_end, round(x * 0.6::DOUBLE, 3) AS score, n FROM top JOIN p USING (task_id, path, grp)),
located AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path, line_start) AS rank FROM c QUALIFY rank <= 10)
"""


def _located(spark, d) -> DataFrame:
    terms = item_terms(spark, d)
    return batch_search.top_k(batch_search.groups(_matches(spark, d), terms), 10)


@query("task_locate", f"WITH {_LOCATED} SELECT task_id, path, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, score, CAST(n AS BIGINT) AS n_hits, CAST(rank AS INTEGER) AS rank FROM located")
def task_locate(spark, d):
    return _located(spark, d).select("task_id", "path", "line_start", "line_end", "score", "n_hits", "rank")


@query("task_scores", f"""WITH {_LOCATED}, gold AS (SELECT DISTINCT item_id AS task_id, path FROM benchmark JOIN f ON contains(f.text, substr(benchmark.text, 1, 50))), pred AS (SELECT DISTINCT task_id, path FROM located),
c AS (SELECT item_id AS task_id, (SELECT count(*) FROM pred WHERE pred.task_id = item_id) AS n_pred, (SELECT count(*) FROM gold WHERE gold.task_id = item_id) AS n_gold, (SELECT count(*) FROM pred JOIN gold USING (task_id, path) WHERE task_id = item_id) AS tp FROM benchmark)
SELECT task_id, round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 4) AS "precision", round(CASE WHEN n_gold > 0 THEN tp / n_gold ELSE 0 END, 4) AS recall FROM c WHERE n_pred + n_gold > 0""".replace(", c AS (SELECT item_id", ", cc AS (SELECT item_id").replace("\nc AS (SELECT item_id", "\ncc AS (SELECT item_id").replace("FROM c WHERE n_pred", "FROM cc WHERE n_pred"))
def task_scores(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), F.substring("text", 1, 50).alias("word"))
    gold = batch_search.holding(doc_files(spark, d), "content", items.select("word")).join(items, "word").select("task_id", "path")
    return metrics.prf(metrics.set_counts(_located(spark, d), gold, ["task_id"], ["path"])).select("task_id", "precision", "recall")


_VERIFIED = """
WITH l AS (SELECT l_orderkey AS o, n, n || ':' || l_partkey AS t FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)),
c AS (SELECT o, count(*) AS m, o % 8 AS k FROM l GROUP BY 1),
p AS (SELECT o, n, t FROM l WHERE n > 1),
a AS (SELECT l.o, n, CASE WHEN k = 3 AND n = 2 THEN 'edited' ELSE t END AS t FROM l JOIN c USING (o) WHERE (n > 1 OR k IN (1, 2)) AND NOT (k = 4 AND n = m AND m > 1)),
gone AS (SELECT o, t FROM (SELECT o, t FROM l EXCEPT ALL SELECT o, t FROM a)),
come AS (SELECT o, t FROM a EXCEPT ALL SELECT o, t FROM l),
f AS (SELECT c.o, k, m, EXISTS (SELECT 1 FROM gone WHERE gone.o = c.o) OR EXISTS (SELECT 1 FROM come WHERE come.o = c.o) AS touched, EXISTS (SELECT 1 FROM gone JOIN l ON l.o = c.o AND l.n = 1 AND l.t = gone.t WHERE gone.o = c.o) AS undone, m > 1 AND EXISTS (SELECT 1 FROM gone JOIN l ON l.o = c.o AND l.n = m AND l.t = gone.t WHERE gone.o = c.o) AS broken,
  EXISTS (SELECT 1 FROM (SELECT t FROM p WHERE p.o = c.o EXCEPT ALL SELECT t FROM a WHERE a.o = c.o)) OR EXISTS (SELECT 1 FROM (SELECT t FROM a WHERE a.o = c.o EXCEPT ALL SELECT t FROM p WHERE p.o = c.o)) AS drift FROM c),
g AS (SELECT o, undone AND k <> 2 AS expected, NOT broken AS preservation, NOT (touched AND (drift OR k = 5)) AS scope, k = 2 AS conflict, k <> 6 AS tests, k <> 7 AS evidence FROM f)
SELECT o AS sha, expected, preservation, scope, conflict, tests, evidence, CASE WHEN NOT (expected AND preservation AND scope) THEN 'FAILED' WHEN tests AND evidence THEN 'VERIFIED' ELSE 'PARTIAL' END AS overall FROM g
"""


@query("verified_patches", _VERIFIED)
def verified_patches(spark, d):
    """Orders are commits of one file, line items its lines: the first line was added and is taken back, the last is kept.
    What a sandbox is left with differs by order: 1 nothing done, 2 a conflict, 3 an edited line, 4 the kept line gone, 5 a
    file outside the plan, 6 without tests, 7 without evidence."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    whole = Window.partitionBy("l_orderkey")
    numbered = dealt(li, li.count(), "l_orderkey").select(F.col("l_orderkey").alias("path"), F.row_number().over(whole.orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("line_no"), F.count("*").over(whole).alias("m"), "l_partkey")
    all_lines = written(numbered.select("path", "line_no", "m", (F.col("path") % 8).alias("k"), F.concat_ws(":", F.col("line_no").cast("string"), F.col("l_partkey").cast("string")).alias("text")), "lines")
    lines, files = all_lines.select("path", "line_no", "text"), all_lines.where("line_no = 1")
    hunk = F.array(F.struct(F.lit("+").alias("tag"), F.col("text").alias("text"))).alias("lines")
    rolled = files.select(F.col("path").alias("sha"), F.col("path").alias("file"), hunk)
    kept = all_lines.where("m > 1 AND line_no = m").select(F.col("path").alias("sha"), F.col("path").alias("file"), hunk)
    after = all_lines.where("(line_no > 1 OR k IN (1, 2)) AND NOT (k = 4 AND line_no = m AND m > 1)").select("path", "line_no", F.when((F.col("k") == 3) & (F.col("line_no") == 2), "edited").otherwise(F.col("text")).alias("text"))
    status = files.select("path", F.when(F.col("k") == 2, "CONFLICT").otherwise("APPLIED_SANDBOX").alias("status"))
    plan = files.where("k <> 5").select(F.col("path").alias("sha"), F.col("path").alias("file"))
    proof = files.select(F.col("path").alias("sha"), (F.col("k") != 6).alias("tests"), (F.col("k") != 7).alias("evidence"))
    got = lifecycle.verify(lines, lines.where("line_no > 1"), after, status, rolled, kept, plan, proof)
    return got.select("sha", "expected", "preservation", "scope", (F.size("conflict") > 0).alias("conflict"), "tests", "evidence", "overall")
