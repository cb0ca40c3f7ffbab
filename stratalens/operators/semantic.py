"""Features: seeding them from code facts, and mapping queries to them and to symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import camel_name, camel_parts, query_terms, short_name, stem


def seed_features(endpoints: DataFrame, symbols: DataFrame, files: DataFrame, source_dirs: list[str] | None = None) -> DataFrame:
    """id, name, symbol, seeded_by: features of routes, components, root layouts and exported symbols; the first seed of a
    name stays."""
    r = endpoints.select(camel_name("route_path").alias("name"), F.concat(F.lit("api:"), F.col("file")).alias("symbol"), F.lit("route").alias("seeded_by"), F.lit(0).alias("p"))
    c = symbols.where("kind = 'component'").select("name", F.concat(F.lit("sym:"), F.col("qualified")).alias("symbol"), F.lit("component").alias("seeded_by"), F.lit(1).alias("p"))
    b = files.where(F.col("path").rlike(r"(^|/)app/layout\.tsx$")).select(F.lit("SystemBranding").alias("name"), F.concat(F.lit("file:"), F.col("path")).alias("symbol"), F.lit("layout").alias("seeded_by"), F.lit(2).alias("p"))
    s = symbols.where("exported").where(F.split("file", "/")[0].isin(source_dirs or ["src", "lib", "source"])).select("name", F.concat(F.lit("sym:"), F.col("qualified")).alias("symbol"), F.lit("symbol").alias("seeded_by"), F.lit(3).alias("p"))
    w = Window.partitionBy("name", "symbol").orderBy("p")
    seeds = r.union(c).union(b).union(s).where("name <> ''")
    return seeds.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.concat(F.lit("feature:"), F.col("name")).alias("id"), "name", "symbol", "seeded_by")


def map_query(features: DataFrame, query: str, top: int = fixed.FEATURE_TOP) -> DataFrame:
    """id, name, score, method: the best features for a query: by name, by a part of the name, or by alias."""
    terms = [t.lower() for t, _ in query_terms(query)] or [query.lower()]
    aliases = [n for n, words in fixed.FEATURE_ALIASES.items() if any(w.lower() in query.lower() for w in words)]
    low, words = F.lower("name"), F.array(*[F.lit(t) for t in terms])
    parts = F.transform(camel_parts("name"), lambda p: F.lower(p))
    sub = F.when(F.exists(words, lambda t: F.contains(low, t) | F.contains(t, low)), fixed.FEATURE_SCORES["substring"]).otherwise(0.0)
    word = F.when(F.arrays_overlap(parts, words), fixed.FEATURE_SCORES["subword"]).otherwise(0.0)
    alias = F.when(F.col("name").isin(aliases), fixed.FEATURE_SCORES["alias"]).otherwise(0.0) if aliases else F.lit(0.0)
    score = F.greatest(sub, word, alias)
    method = F.when(score == alias, "alias").when(score == sub, "substring").otherwise("subword")
    return features.select("id", "name").distinct().withColumn("score", score).withColumn("method", method).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def related_symbols(edges: DataFrame) -> DataFrame:
    """feature, symbol over IMPLEMENTS, REPRESENTS and RELATED_TO."""
    return edges.where(F.col("type").isin("IMPLEMENTS", "REPRESENTS", "RELATED_TO")).select(F.col("src").alias("feature"), F.col("dst").alias("symbol"))


def resolve_target(symbols: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """id, how: symbols named in the query, else files whose name or stem it holds. A blank query is an error."""
    if not query.strip():
        raise ValueError("the query is empty")
    names = [t for t, o in query_terms(query) if o.startswith("en:")]
    by_name = symbols.where(F.col("name").isin(names)).select(F.concat(F.lit("sym:"), F.col("qualified")).alias("id"), F.lit("symbol").alias("how"), F.lit(0).alias("p"))
    q = F.lit(query.lower())
    held = F.contains(q, F.lower(F.element_at(F.split("path", "/"), -1))) | ((F.length(stem("path")) > 2) & F.contains(q, F.lower(stem("path"))))
    by_file = files.where(held).select(F.concat(F.lit("file:"), F.col("path")).alias("id"), F.lit("file").alias("how"), F.lit(1).alias("p"))
    named = by_name.agg((F.count("*") > 0).alias("_named"))
    return by_name.union(by_file).crossJoin(F.broadcast(named)).where("p = 0 OR NOT _named").select("id", "how")  # one row


def short_names(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, short_name(column))
