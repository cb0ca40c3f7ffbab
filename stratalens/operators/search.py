"""Lexical search: lines, matches, hit classes, and the locate score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import extension_weight, has_cjk, stem


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, line_no (from 1), text: lines end at CR LF, CR or LF. Null content has none; an empty one has one line."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content), r"\r\n|\r|\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text")


def _place(term: str, text: Column) -> Column:
    """0-based place of a term in a text, or null: CJK anywhere, other terms as whole words in any case."""
    if re.search("[一-鿿]", term):
        return F.nullif(F.instr(text, term), F.lit(0)) - 1
    pattern = r"(?iU)\b" + re.escape(term) + r"\b"
    return F.when(text.rlike(pattern), F.length(F.element_at(F.split(text, pattern, 2), 1)))


def matches(line_table: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """path, line_no, col, term, origin, text: on each line the first CJK term and the first other term that it holds.

    The terms of a query are few and known before the plan is made, so they become expressions over each line: one scan,
    no join, and lines without any are filtered where they are read.
    """
    def firsts(cjk: bool) -> list[Column]:
        own = [(k, t, o) for k, (t, o) in enumerate(terms) if bool(re.search("[一-鿿]", t)) == cjk]
        return [F.struct(_place(t, F.col("text")).alias("col"), F.lit(t).alias("term"), F.lit(o).alias("origin")) for _, t, o in own]

    groups = [g for g in (firsts(True), firsts(False)) if g]
    if not groups:
        return line_table.where(F.lit(False)).select("path", "line_no", F.lit(0).alias("col"), F.lit("").alias("term"), F.lit("").alias("origin"), "text")
    hits = F.filter(F.array(*[F.get(F.filter(F.array(*g), lambda x: x.col.isNotNull()), 0) for g in groups]), lambda x: x.isNotNull())
    return line_table.select("path", "line_no", "text", F.explode(hits).alias("m")).select("path", "line_no", "m.col", "m.term", "m.origin", "text")


def hit_kind(text: Column, col: Column, term: Column) -> Column:
    """comment, string, ui_text, identifier or plain: the first that applies."""
    before, after = F.substring(text, F.lit(1), col), F.substring(text, col + F.length(term) + 1, F.length(text))
    word = r"[\p{L}\p{N}_$]"
    return (
        F.when(text.rlike(r"^\p{Zs}*(//|\*|/\*|#)"), "comment")  # any kind of space may stand before it
        .when(before.rlike("""['"`][^'"`]*\\z""") & after.rlike("""^[^'"`]*['"`]"""), "string")
        .when(has_cjk(term), "ui_text")
        .when(after.rlike(f"^{word}") | before.rlike(word + r"\z"), "identifier")
        .otherwise("plain")
    )


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.WEIGHTS.items() for x in kv])
    return F.element_at(table, kind)


def filename_bonus(path: Column, terms: list[tuple[str, str]]) -> Column:
    """6 for each term in the file's stem, 3 for one elsewhere in the path; CJK terms don't count."""
    total = F.lit(0.0)
    low_stem, low_path = F.lower(stem(path)), F.lower(path)
    for t, _ in terms:
        if not re.search("[一-鿿]", t):
            total = total + F.when(F.contains(low_stem, F.lit(t.lower())), fixed.WEIGHTS["filename"]).when(F.contains(low_path, F.lit(t.lower())), fixed.WEIGHTS["filename"] / 2).otherwise(0.0)
    return total


def islands(df: DataFrame, by: list[str], order: list[str], value: str, gap: int = fixed.MERGE_LINES, name: str = "grp") -> DataFrame:
    """df with a group number: rows in order whose value is within gap of the row before share one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def group_scores(found: DataFrame, by: list[str]) -> DataFrame:
    """by, line_start, line_end, n_hits, hits, credit of the densest groups of matches: one scan, one shuffle.

    Groups, their terms and their lines share the partitioning of the window that numbers them; a group's few terms and
    the lines of each are held in arrays.
    """
    m = found.withColumn("kind", hit_kind(F.col("text"), F.col("col"), F.col("term"))).withColumn("w", kind_weight(F.col("kind")))
    m = islands(m, by, ["line_no", "col", "term"], "line_no")
    best = F.max_by(F.struct("w", "line_no"), F.struct(F.col("w"), -F.col("line_no"), -F.col("col")))
    each = m.groupBy(*by, "grp", "term").agg(best.alias("b"), F.count("*").alias("n"), F.collect_set("line_no").alias("lines"))
    terms = F.array_sort(F.collect_list(F.struct("term", "b.w", "b.line_no", "lines"))).alias("t")  # sums of doubles in one order
    whole = each.groupBy(*by, "grp").agg(F.sum("n").alias("n_hits"), F.min(F.array_min("lines")).alias("line_start"), F.max(F.array_max("lines")).alias("line_end"), terms)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_hits"), "grp"))
    top = whole.withColumn("rank", rank).where(F.col("rank") <= fixed.GROUPS_PER_FILE)
    shared = lambda x: F.exists("t", lambda y: (y.term != x.term) & F.array_contains(y.lines, x.line_no))
    zero = F.lit(0.0).cast("double")
    hits = F.aggregate("t", zero, lambda n, x: n + x.w * F.when(shared(x), fixed.SAME_LINE_BOOST).otherwise(1.0))
    credit = F.aggregate("t", zero, lambda n, x: n + F.least(F.lit(fixed.REPEAT_CREDIT), x.w / fixed.REPEAT_DIVISOR))
    return top.select(*by, "line_start", "line_end", "n_hits", hits.alias("hits"), credit.alias("credit"))


def locate_groups(found: DataFrame, terms: list[tuple[str, str]], weigh: bool = True) -> DataFrame:
    """path, line_start, line_end, score, n_hits: scored groups of matches, the three densest of each file.

    A group's score sums, over its distinct terms, the weight of the best hit (the first of equal ones; half as much
    again of 0.6 if its line holds another term) and a small credit, adds the file name's bonus, and is scaled by the
    file's extension.
    """
    ext = extension_weight("path") if weigh else F.lit(1.0)
    score = F.round((F.col("hits") + F.col("credit") + filename_bonus(F.col("path"), terms)) * ext, 3)
    return group_scores(found, ["path"]).select("path", "line_start", "line_end", score.alias("score"), "n_hits")


def top_k(candidates: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """The k best by score; ties by path and first line."""
    return candidates.orderBy(F.desc("score"), "path", "line_start").limit(k)


def file_name_candidates(files: DataFrame, found: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """Files without a matching line whose name alone earns enough."""
    bonus, ext = filename_bonus(F.col("path"), terms), extension_weight("path")
    named = files.select("path").where((bonus >= fixed.FILE_ONLY_BONUS) & (ext >= fixed.FILE_ONLY_EXTENSION)).join(found.select("path"), "path", "left_anti")
    return named.select("path", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.round(bonus * ext, 3).alias("score"), F.lit(0).cast("bigint").alias("n_hits"))


def context_budget(items: DataFrame, length: str, order: list[str], most: int, by: list[str] | None = None) -> DataFrame:
    """Items in order until their running length passes the budget; all after the first that doesn't fit are left out."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= most)
