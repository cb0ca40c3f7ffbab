"""The op queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .decontaminate import benchmark_hits
from .hard_negatives import hard_negatives
from .minhash import near_duplicates
from .mixing import mixed
from .passages import without_passages
from .quality_crf import quality_scores
from .quality_rules import rule_quality
from .secrets import scan_secrets
from .spelling import spelling_variants
from .suffix_dedup import without_repeats
from .token_counts import token_counts
from .token_store import read_store, write_store
from .toxicity import toxicity_scores

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM wins),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM pos p JOIN wins x ON x.k = p.k AND x.s = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_key", F.octet_length("text").cast("bigint").alias("n_bytes"))


OP4_SQL = r"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT sum(sqrt(n)) AS w, sum(n) AS n FROM s),
r AS (SELECT s.source, sqrt(s.n) * t.n * 1.0 / (t.w * s.n) AS rate FROM s, t),
q AS (SELECT source, greatest(ceil(rate / 16), 1) AS m, rate / greatest(ceil(rate / 16), 1) AS rate FROM r),
c(source, m, rate, k, p, cdf) AS (
  SELECT source, m, rate, 0, exp(-rate), exp(-rate) FROM q
  UNION ALL SELECT source, m, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < 63),
u AS (SELECT doc_id, text, documents.source, unnest(range(1, CAST(m AS BIGINT) + 1)) AS i FROM documents JOIN q USING (source)),
h AS (SELECT doc_id, text, source, i, CAST(CAST('0x' || substr(md5('mix|' || doc_id || '|' || i), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM u),
x AS (SELECT h.doc_id, any_value(h.text) AS text, h.source, h.i, count(c.k) AS n FROM h LEFT JOIN c ON c.source = h.source AND c.cdf <= h.u GROUP BY h.doc_id, h.source, h.i),
y AS (SELECT doc_id, any_value(text) AS text, source, sum(n) AS n FROM x GROUP BY doc_id, source),
z AS (SELECT doc_id, text, source, CAST(unnest(range(0, CAST(n AS BIGINT))) AS INTEGER) AS copy FROM y WHERE n > 0)
SELECT doc_id, source, copy, substr(md5('mix|' || doc_id || '|' || copy || '|order'), 1, 16) AS mix_key, CAST(strlen(text) AS BIGINT) AS n_bytes FROM z
"""


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer=TOKENIZER)
    return read_store(spark, path, tokenizer=TOKENIZER)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x.rank < 3)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")

    def number(kind):
        return F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer=TOKENIZER).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rule_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, y.b FROM r JOIN both_ways y ON r.b = y.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), one_in=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS UINTEGER) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UINTEGER)) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY 1, 2),
u AS (SELECT w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM r WHERE len(w) >= 5),
h AS (SELECT w, n, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), list_transform(b, lambda x: CAST(x AS UINTEGER))), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UINTEGER)) AS BIGINT) AS h FROM u, crc),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE len(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS s FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS k FROM v)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.s = b.s AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON c.s = v.word
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON c.s = v.word),
best AS (SELECT word, n, form, form_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY form_n DESC, form) = 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, here, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY 1) USING (word)
"""


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
hit AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM word ANTI JOIN hit USING (doc_id, j) GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_suffix_dedup": op1_suffix_dedup, "op2_quality_crf": op2_quality_crf, "op3_decontaminate": op3_decontaminate, "op4_mix_sources": op4_mix_sources, "op5_token_store": op5_token_store, "op6_secret_scan": op6_secret_scan, "op7_token_counts": op7_token_counts, "op8_quality_rules": op8_quality_rules, "op9_minhash_dedup": op9_minhash_dedup, "op10_toxicity": op10_toxicity, "op11_hard_negatives": op11_hard_negatives, "op12_spelling_variants": op12_spelling_variants, "op13_passage_dedup": op13_passage_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op4_mix_sources": OP4_SQL, "op9_minhash_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_passage_dedup": OP13_SQL}
