"""Change units: hunks of a commit that belong together, their labels, matches, risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import domain_hits, hunk_tokens, short_name

from .components import connected_components
from .scratch import dealt, written


def hunk_features(hunks: DataFrame) -> DataFrame:
    """hunks (sha, file, idx, lines array<struct<tag, text>>, symbols) with tokens, cjk, ui_strings and domains.

    domains counts each domain's triggers in the lower-case text of symbols, file, tokens and CJK, and exact tokens once
    more. bind counts without CJK and exact tokens, as binding does.
    """
    text = F.array_join(F.transform(F.filter("lines", lambda x: x.tag.isin("+", "-")), lambda x: x.text), "\n")
    h = hunks.withColumn("_text", text).withColumn("tokens", hunk_tokens("_text")).withColumn("cjk", F.array_sort(F.array_distinct(F.regexp_extract_all("_text", F.lit("([一-鿿]+)")))))
    ui = F.slice(F.regexp_extract_all("_text", F.lit("""['"`]([^'"`\\n]*[一-鿿][^'"`\\n]*)['"`]"""), F.lit(1)), 1, 10)
    base = F.concat_ws(" ", F.array_join("symbols", " "), F.col("file"), F.array_join("tokens", " "))
    return h.withColumn("ui_strings", ui).withColumn("domains", domain_hits(F.concat_ws(" ", base, F.array_join("cjk", " ")), F.col("tokens"))).withColumn("bind", domain_hits(base)).drop("_text")


def bind_edges(features: DataFrame, file_calls: DataFrame | None = None) -> DataFrame:
    """sha, a, b: links that hold the hunks of a commit together which belong together (a < b by ord).

    Hunks belong together by a shared symbol, by a shared domain (two hits in all, which any two hunks of a domain have),
    or by a call from one's file to the other's. What shares a reason is linked to the first hunk that has it, so a
    reason of n hunks gives n - 1 links instead of all pairs, and components stay the same.
    """
    f = features.withColumn("ord", F.row_number().over(Window.partitionBy("sha").orderBy("file", "idx")))

    def stars(df: DataFrame, by: list[str]) -> DataFrame:
        first = df.groupBy("sha", *by).agg(F.min("ord").alias("a"))
        return df.join(first, ["sha", *by]).where("ord > a").select("sha", "a", F.col("ord").alias("b"))

    out = stars(f.select("sha", "ord", F.explode("symbols").alias("s")), ["s"]).union(stars(f.select("sha", "ord", F.explode(F.map_keys("bind")).alias("d")), ["d"]))
    if file_calls is not None:
        calls = file_calls.select("caller_file", "callee_file").distinct()
        firsts = f.groupBy("sha", "file").agg(F.min("ord").alias("first"))
        pairs = firsts.select("sha", F.col("file").alias("caller_file"), F.col("first").alias("x")).join(calls, "caller_file").join(firsts.select("sha", F.col("file").alias("callee_file"), F.col("first").alias("y")), ["sha", "callee_file"]).where("x <> y")
        # all hunks of two files that a call joins are linked through the first hunk of either
        ends = pairs.select("sha", F.col("caller_file").alias("file"), F.col("y").alias("other")).union(pairs.select("sha", "callee_file", "x")).distinct()
        linked = f.select("sha", "file", "ord").join(ends, ["sha", "file"])
        out = out.union(linked.select("sha", F.least("ord", "other").alias("a"), F.greatest("ord", "other").alias("b")))
    return out.distinct()


def change_units(features: DataFrame, file_calls: DataFrame | None = None) -> DataFrame:
    """sha, unit_id, label, summary, files, symbols, ui_strings, cohesion, hunks: components of bound hunks.

    Units of a commit are numbered by their first hunk. The label is the domain with the most hits, the earlier one in
    the catalogue of equals, else ``mixed``. Cohesion is hunks over distinct files.
    """
    f = features.withColumn("ord", F.row_number().over(Window.partitionBy("sha").orderBy("file", "idx")))
    node = lambda c: F.struct(F.col("sha"), F.col(c).alias("ord"))
    edges = bind_edges(features, file_calls).select(node("a").alias("src"), node("b").alias("dst"))
    comp = connected_components(edges).select(F.col("node.sha").alias("sha"), F.col("node.ord").alias("ord"), F.col("component.ord").alias("root"))
    h = f.join(comp, ["sha", "ord"], "left").withColumn("root", F.coalesce("root", "ord"))
    h = h.withColumn("k", F.dense_rank().over(Window.partitionBy("sha").orderBy("root")))
    order = F.create_map(*[x for i, d in enumerate(fixed.DOMAINS) for x in (F.lit(d), F.lit(i))])
    strength = h.select("sha", "k", F.explode("domains").alias("d", "n")).groupBy("sha", "k", "d").agg(F.sum("n").alias("n"))
    label = strength.groupBy("sha", "k").agg(F.max_by("d", F.struct(F.col("n"), -F.element_at(order, F.col("d")))).alias("label"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    units = h.groupBy("sha", "k").agg(
        F.array_sort(F.collect_set("file")).alias("files"), flat("symbols").alias("symbols"), F.slice(flat("ui_strings"), 1, 10).alias("ui_strings"),
        F.round(F.count("*") / F.greatest(F.count_distinct("file"), F.lit(1)), 2).alias("cohesion"), F.array_sort(F.collect_list(F.struct("file", "idx"))).alias("hunks"),
    )
    out = units.join(label, ["sha", "k"], "left").withColumn("label", F.coalesce("label", F.lit("mixed"))).withColumn("unit_id", F.concat(F.left("sha", F.lit(8)), F.lit("-U"), F.col("k").cast("string")))
    return out.withColumn("summary", unit_summary()).select("sha", "unit_id", "label", "summary", "files", "symbols", "ui_strings", "cohesion", "hunks")


def unit_summary() -> Column:
    """Label, up to two UI strings, four symbols and four files, joined by bars."""
    part = lambda c, n: F.nullif(F.array_join(F.slice(c, 1, n), ", "), F.lit(""))
    return F.concat_ws(" | ", "label", part("ui_strings", 2), part(F.transform("symbols", short_name), 4), part("files", 4))


def unit_scores(units: DataFrame, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """units that match, with score and matched terms: label, UI strings, symbols and files, summed over terms."""
    w = fixed.UNIT_SCORES | (weights or {})
    low = [t.lower() for t in terms if t]
    held = lambda c, t: F.exists(F.col(c), lambda x: F.contains(F.lower(x), F.lit(t)))
    total, why = F.lit(0.0), []
    for t in low:
        one = F.when(F.lower("label") == t, w["label"]).when(F.contains(F.lower("label"), F.lit(t)), w["label"] * w["label_partial"]).otherwise(0.0)
        one = one + F.when(held("ui_strings", t), w["ui"]).otherwise(0.0)
        one = one + F.when(F.exists("symbols", _mentions(t)), w["symbol"]).otherwise(0.0)
        one = one + F.when(held("files", t), w["file"]).otherwise(0.0)
        total = total + one
        why.append(F.when(one > 0, F.lit(t)))
    return units.withColumn("score", F.round(total, 4)).withColumn("matched", F.array_compact(F.array(*why)) if why else F.array().cast("array<string>")).where("score > 0")


def _mentions(term: str):
    return lambda s: F.contains(F.lower(short_name(s)), F.lit(term))


def arbitrate(problem: DataFrame, keep: DataFrame, prefer_problem: bool = True) -> DataFrame:
    """unit_id, commit, side, score: which matched units are rolled back and which kept.

    A unit on both sides goes to the better score; ties to the problem side if preferred. Commits of kept units pin the
    rest: problem units of other commits drop out while there is any.
    """
    p, k = problem.select("unit_id", "commit", F.col("score").alias("p")), keep.select("unit_id", F.col("commit").alias("k_commit"), F.col("score").alias("k"))
    both = p.join(k, "unit_id", "full_outer")
    wins = F.col("k").isNotNull() & (F.col("p").isNull() | (F.col("k") > F.col("p") if prefer_problem else F.col("k") >= F.col("p")))
    side = both.select("unit_id", F.coalesce("k_commit", "commit").alias("commit"), F.when(wins, "keep").otherwise("problem").alias("side"), F.when(wins, F.col("k")).otherwise(F.col("p")).alias("score"))
    pins = side.where("side = 'keep' AND commit <> ''").select("commit").distinct()
    any_pin = pins.agg((F.count("*") > 0).alias("_pinned"))
    marked = side.join(pins.withColumn("_pin", F.lit(True)), "commit", "left").crossJoin(F.broadcast(any_pin))  # one row
    return marked.where((F.col("side") == "keep") | ~F.col("_pinned") | F.coalesce("_pin", F.lit(False))).select("unit_id", "commit", "side", "score")


def classify_units(units: DataFrame, problem: list[str], keep: list[str]) -> DataFrame:
    """units with action: ROLLBACK if a problem domain is among the unit's and no keep domain is, else KEEP.

    Units that match neither clause are kept; without a problem clause nothing is rolled back.
    """
    blob = F.concat_ws(" ", F.array_join("files", " "), F.array_join("symbols", " "), F.array_join("ui_strings", " "))
    own = F.array_union(F.map_keys(domain_hits(blob)), F.filter(F.array("label"), lambda x: x != "mixed"))
    bad, good = (F.arrays_overlap(own, F.array(*[F.lit(d) for d in ds])) if ds else F.lit(False) for ds in (problem, keep))
    label_bad, label_good = (F.col("label").isin(ds) if ds else F.lit(False) for ds in (problem, keep))
    action = F.when(label_bad & ~label_good, "ROLLBACK").when(label_good, "KEEP").when(bad & ~good, "ROLLBACK").otherwise("KEEP")
    return units.withColumn("action", action).withColumn("matched", bad | good)


def collateral_risk(units: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """sha, risk, shared_files: 0.35 for a file on both sides, 0.15 for each kept file's call of a rolled-back symbol, 0.2 if
    nothing is rolled back; at most 1, rounded to three places."""
    rows = units.agg(F.sum(F.greatest(F.lit(1), *[F.size(c) for c in ("files", *(("symbols",) if calls is not None else ()))]))).first()[0] or 0
    # files and symbols are dealt one a row, and the action as a flag: a scan's rows wait in memory to be dealt. What follows
    # groups and joins where the rows lie
    each = units.select("sha", (F.col("action") == "ROLLBACK").alias("_back"), F.explode_outer("files").alias("file"))
    sides = dealt(each, rows, "sha").groupBy("sha", "file").agg(F.bool_or("_back").alias("_problem"), F.bool_or(~F.col("_back")).alias("_kept"))
    both = F.col("_problem") & F.col("_kept") & F.col("sha").isNotNull()
    out = sides.groupBy("sha").agg(F.coalesce(F.bool_or("_problem"), F.lit(False)).alias("_problem"), F.array_sort(F.collect_list(F.when(both, F.col("file")))).alias("shared_files"))
    if calls is not None:
        called = written(calls.select("callee_short", "caller_file").distinct(), "called")
        names = dealt(units.where("action = 'ROLLBACK'").select("sha", F.explode("symbols").alias("symbol")), rows, "sha").distinct().select("sha", "symbol", F.substring_index(short_name("symbol"), ".", 1).alias("callee_short"))
        kept = sides.where("_kept").select("sha", F.col("file").alias("caller_file"))
        # a commit's symbols meet its own files first: a name's callers are far more
        hits = names.join(kept, "sha").join(called, ["callee_short", "caller_file"], "left_semi").groupBy("sha").agg(F.count_distinct("symbol").alias("n_calls"))
        out = out.join(hits, "sha", "left")
    else:
        out = out.withColumn("n_calls", F.lit(0))
    risk = F.when(F.size("shared_files") > 0, fixed.RISK_SHARED_FILE).otherwise(0.0) + fixed.RISK_CALLER * F.coalesce("n_calls", F.lit(0)) + F.when(~F.col("_problem"), fixed.RISK_NO_PROBLEM).otherwise(0.0)
    return out.select("sha", F.round(F.least(F.lit(1.0), risk), 3).alias("risk"), "shared_files")


def label_by_domain(strengths: DataFrame, key: list[str], domain: str, n: str, order: str) -> DataFrame:
    """The strongest domain of each key; the lower order of equals."""
    return strengths.groupBy(*key).agg(F.max_by(domain, F.struct(F.col(n), -F.col(order))).alias("label"))


def text_domains(text: str) -> list[str]:
    """Domains that a short text (a query's clause) triggers, through its search terms as well."""
    from stratalens.functions.text import query_terms

    if not text.strip():
        return []
    blob = " ".join([text, *(t for t, _ in query_terms(text))]).lower()
    return [d for d, triggers in fixed.DOMAINS.items() if any(t in blob for t in triggers)]


def held_terms(column: str, terms: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(F.col(column)), F.lit(t.lower())) for t in terms], F.lit(False))
