"""A table of tasks in one plan: every query of it, under every mode, with rows for those that fail.

Terms, symbols and commits of all tasks are rows, so the number of scans doesn't follow the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import domain_hits, split_clauses, symbol_pick
from stratalens.operators import batch_search as batch
from stratalens.operators import codegraph, metrics, search
from stratalens.operators.scratch import written

from .tasks import MODES, Repository, _mode

TASK_TYPES = ["locate", "impact", "rollback"]
_CANDIDATE = ["task_id", "path", "line_start", "line_end", "score", "n_hits", "symbol"]


def locate_all(repo: Repository, tasks: DataFrame, modes: list[str] = MODES, k: int = fixed.TOP_K) -> DataFrame:
    """task_id, mode, rank, path, line_start, line_end, symbol, score: ``locate`` for each query (task_id, query) and mode.

    All terms are matched in one scan of the files; modes are stacked on the same candidates, each a join wider.
    """
    terms = written(batch.task_terms(tasks))
    found = written(batch.matches(search.lines(repo.files), terms))
    none = F.lit(None).cast("string").alias("symbol")
    lexical = batch.groups(found, terms).unionByName(batch.named_files(repo.files, found, terms)).withColumn("symbol", none)
    stages = {"lexical": written(lexical.select(_CANDIDATE))}
    out = None
    for mode in MODES[: max(MODES.index(m) for m in modes) + 1]:
        if mode == "structural":
            stages[mode] = written(_structural(repo, stages["lexical"], terms))
        elif mode == "structural_git":
            stages[mode] = written(_with_history(repo, stages["structural"], terms)) if repo.commits is not None else stages["structural"]
        elif mode == "graph":
            stages[mode] = _with_graph(repo, stages["structural_git"], terms)
        if mode in modes:
            own = batch.top_k(stages[mode], k).select("task_id", F.lit(mode).alias("mode"), "rank", "path", "line_start", "line_end", "symbol", "score")
            out = own if out is None else out.unionByName(own)
    return out


def _structural(repo: Repository, c: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates widened to the symbol they lie in, boosts for symbols and titles that the query names, definitions."""
    s = repo.facts["symbols"]
    places = c.where("line_start IS NOT NULL").select("path", "line_start").distinct()
    own = s.select(F.col("file").alias("path"), F.col("name").alias("s_name"), F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"), F.col("ord").alias("s_ord"))
    w = Window.partitionBy("path", "line_start").orderBy(F.col("s_end") - F.col("s_start"), "s_ord")
    inside = places.join(own, "path").where(F.col("line_start").between(F.col("s_start"), F.col("s_end"))).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "s_ord")
    words = terms.select("task_id", F.lower("term").alias("word")).distinct()
    titles = words.where(F.col("word").isin([*fixed.DICTIONARY["标题"], "标题"])).select("task_id", F.lit(True).alias("_title")).distinct()
    c = c.join(inside, ["path", "line_start"], "left").withColumn("word", F.lower("s_name"))
    c = c.join(words.withColumn("_same", F.lit(fixed.SAME_SYMBOL_BOOST)), ["task_id", "word"], "left").join(titles, "task_id", "left")
    title = F.when(F.col("_title") & F.col("path").rlike(r"(^|/)app/layout\.tsx$"), fixed.ROOT_LAYOUT_BOOST).otherwise(0.0)
    score = F.round(F.col("score") + F.coalesce("_same", F.lit(0.0)) + title, 3)
    c = c.select("task_id", "path", F.coalesce("s_start", "line_start").alias("line_start"), F.coalesce("s_end", "line_end").alias("line_end"), score.alias("score"), "n_hits", F.coalesce("symbol", "s_name").alias("symbol"))
    named = terms.select("task_id", F.col("term").alias("name")).distinct()
    exact = s.join(named, "name").select("task_id", F.col("file").alias("path"), "line_start", "line_end", F.round(fixed.DEFINITION_BOOST + (F.col("line_end") - F.col("line_start") + 1), 3).alias("score"), F.lit(0).cast("bigint").alias("n_hits"), F.col("name").alias("symbol"))
    return c.unionByName(exact)


def _with_history(repo: Repository, c: DataFrame, terms: DataFrame) -> DataFrame:
    """Votes of commits whose message holds a term, and files that change together with voted ones."""
    message = "message" if "message" in repo.commits.columns else "subject"
    words = terms.select("task_id", F.lower("term").alias("word")).distinct()
    said = batch.holding(repo.commits.select("sha", F.lower(message).alias("low")), "low", words.select("word"))
    voters = said.join(words, "word").select("task_id", "sha").distinct()
    votes = voters.join(repo.commit_files.select("sha", "file").distinct(), "sha").groupBy("task_id", F.col("file").alias("path")).agg(F.count("*").alias("votes"))
    votes = votes.select("task_id", "path", (fixed.COMMIT_VOTE + fixed.COMMIT_VOTE_MORE * (F.col("votes") - 1)).alias("_v"))
    both = repo.pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).union(repo.pairs.select("b", "a"))
    near = votes.select("task_id", F.col("path").alias("other")).join(both, "other").select("task_id", "path").distinct().withColumn("_n", F.lit(fixed.COCHANGE_BOOST))
    c = c.join(votes, ["task_id", "path"], "left").join(near, ["task_id", "path"], "left")
    return c.withColumn("score", F.round(F.col("score") + F.coalesce("_v", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0)), 3)).select(_CANDIDATE)


def _with_graph(repo: Repository, c: DataFrame, terms: DataFrame) -> DataFrame:
    """Factors for files that matched ones import or change with, and for shown strings; files only the graph knows."""
    matched = c.select("task_id", "path").distinct()
    links = [(repo.facts["imports"].where("source_file <> ''").select(F.col("source_file").alias("path"), F.col("importer").alias("other")), fixed.IMPORTER_BOOST)]
    if repo.commit_files is not None:
        links.append((repo.pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).union(repo.pairs.select("b", "a")), fixed.COCHANGED_BOOST))

    def scaled(c: DataFrame, hit: DataFrame, factor: float) -> DataFrame:
        return c.join(hit.withColumn("_f", F.lit(factor)), ["task_id", "path"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("_f", F.lit(1.0)), 3)).drop("_f")

    for table, factor in links:
        c = scaled(c, matched.withColumnRenamed("path", "other").join(table.distinct(), "other").select("task_id", "path").distinct(), factor)
    shown_words = terms.where(F.startswith("origin", F.lit("cjk"))).select("task_id", F.col("term").alias("word")).distinct()
    ui = repo.facts["ui_strings"].select(F.col("file").alias("path"), "text")
    shown = batch.holding(ui, "text", shown_words.select("word")).join(shown_words, "word").select("task_id", "path").distinct()
    c = scaled(c, shown, fixed.GRAPH_UI_BOOST)
    nothing = F.lit(0).cast("bigint").alias("n_hits")
    named = terms.where((F.length("term") >= 4) & F.col("term").rlike(r"^\p{L}")).select("task_id", F.col("term").alias("name")).distinct()
    by_symbol = repo.facts["symbols"].join(named, "name").groupBy("task_id", F.col("file").alias("path")).agg(F.min_by(F.struct("name", "line_start"), "line_start").alias("s"))
    by_symbol = by_symbol.select("task_id", "path", F.col("s.line_start").alias("line_start"), F.col("s.line_start").alias("line_end"), F.lit(fixed.GRAPH_ONLY_SYMBOL).alias("score"), nothing, F.col("s.name").alias("symbol")).join(matched, ["task_id", "path"], "left_anti")
    taken = matched.union(by_symbol.select("task_id", "path"))
    by_string = shown.join(taken, ["task_id", "path"], "left_anti").select("task_id", "path", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(round(fixed.GRAPH_ONLY_SYMBOL * fixed.GRAPH_ONLY_UI, 3)).alias("score"), nothing, F.lit(None).cast("string").alias("symbol"))
    return c.select(_CANDIDATE).unionByName(by_symbol).unionByName(by_string)


def impact_all(repo: Repository, tasks: DataFrame) -> DataFrame:
    """task_id, bucket, file, name, line: callers, importing_files, indirectly_affected and routes of the symbol that each
    query names; a symbol without a definition has its lexical hits in the buckets definition, call and mention."""
    f = repo.facts
    wanted = written(tasks.select("task_id", symbol_pick("query").alias("symbol")).where("symbol IS NOT NULL"))
    s = wanted.join(f["symbols"].select(F.col("name").alias("symbol"), "qualified", "file"), "symbol")
    q, nothing = s.select("task_id", "qualified"), (F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"))
    direct = codegraph.callers(f["calls"], f["symbols"], f["imports"]).join(q, "qualified")
    jsx = codegraph.jsx_callers(f["jsx_refs"], f["symbols"], f["imports"]).join(q, "qualified")
    starts = s.select("task_id", F.col("symbol").alias("start")).distinct()
    chains = written(codegraph.indirect_callers(f["calls"], f["symbols"], f["imports"], starts.select("start").distinct()))
    reached = codegraph.routes_reaching(repo.endpoints, f["symbols"], chains).join(starts, "start")
    home = s.select("task_id", F.col("file").alias("source_file")).distinct()
    lone = wanted.join(f["symbols"].select(F.col("name").alias("symbol")), "symbol", "left_anti")
    terms = batch.keyed(lone.select("task_id", F.lit(0).alias("ord"), F.col("symbol").alias("term"), F.concat(F.lit("en:"), "symbol").alias("origin")))
    hits = batch.matches(search.lines(repo.files), terms)
    rows = [
        direct.select("task_id", F.lit("callers").alias("bucket"), F.col("caller_file").alias("file"), F.col("caller").alias("name"), "line"),
        jsx.select("task_id", F.lit("callers"), "file", F.lit("<jsx>"), "line"),
        codegraph.importers(f["imports"]).join(home, "source_file").select("task_id", F.lit("importing_files"), "importer", *nothing),
        chains.where("depth > 1").join(starts, "start").select("task_id", F.lit("indirectly_affected"), F.substring_index("caller", "::", 1), "caller", F.lit(None).cast("int")),
        reached.select("task_id", F.lit("routes"), "route_path", *nothing),
        codegraph.lexical_roles(hits, F.col("term")).select("task_id", F.col("role"), "path", "term", "line_no"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def rollback_all(repo: Repository, tasks: DataFrame) -> DataFrame:
    """task_id, unit_id, action, files: each task's commit in units, judged by the two clauses of its query."""
    sides = tasks.select("task_id", F.col("commit").alias("sha"), split_clauses("query").alias("c"))
    domains = lambda c: F.map_keys(domain_hits(c))
    terms = written(batch.task_terms(sides.select("task_id", F.col("c.problem").alias("query"))).select("task_id", "term", F.lit("problem").alias("side")).union(batch.task_terms(sides.select("task_id", F.col("c.keep").alias("query"))).select("task_id", "term", F.lit("keep"))))
    more = terms.groupBy("task_id").pivot("side", ["problem", "keep"]).agg(F.array_join(F.collect_list("term"), " ")).withColumnsRenamed({"problem": "p_terms", "keep": "k_terms"})
    asked = sides.join(more, "task_id", "left").select("task_id", "sha", domains(F.concat_ws(" ", "c.problem", "p_terms")).alias("bad"), domains(F.concat_ws(" ", "c.keep", "k_terms")).alias("good"))
    u = repo.units.join(asked, "sha")
    blob = F.concat_ws(" ", F.array_join("files", " "), F.array_join("symbols", " "), F.array_join("ui_strings", " "))
    own = F.array_union(F.map_keys(domain_hits(blob)), F.filter(F.array("label"), lambda x: x != "mixed"))
    held = lambda side: F.array_contains(F.col(side), F.col("label"))
    action = F.when(held("bad") & ~held("good"), "ROLLBACK").when(held("good"), "KEEP").when(F.arrays_overlap(own, F.col("bad")) & ~F.arrays_overlap(own, F.col("good")), "ROLLBACK").otherwise("KEEP")
    return u.select("task_id", "unit_id", action.alias("action"), "files")


def _error(repo: Repository) -> Column:
    """What keeps a task from running, or null."""
    no_terms = F.coalesce(F.length(F.trim("query")), F.lit(0)) == 0
    history = F.lit(repo.hunks is None)
    return (
        F.when(~F.coalesce(F.col("task_type"), F.lit("")).isin(TASK_TYPES), F.concat(F.lit("unknown task type: "), F.coalesce("task_type", F.lit("none"))))
        .when(no_terms, "the query is empty")
        .when((F.col("task_type") == "impact") & symbol_pick("query").isNull(), "the query names no symbol")
        .when((F.col("task_type") == "rollback") & (history | (F.coalesce("commit", F.lit("")) == "")), "a rollback needs a commit and its history")
    )


def run_tasks(repo: Repository, tasks: DataFrame, modes: list[str] = MODES, k: int = fixed.TOP_K) -> dict[str, DataFrame]:
    """Every task (task_id, task_type, query, commit) under every mode: runs (task_id, task_type, mode, error) and predictions
    (task_id, mode, item, rank): files in order for locate, affected files for impact, files to roll back for rollback.

    A task that can't run has a row with its error for each mode and no predictions; one whose query finds nothing has
    none either, without an error. Modes change what locate finds; impact and rollback are the same in all of them.
    """
    asked = written(tasks.select("task_id", "task_type", "query", "commit").withColumn("error", _error(repo)))
    each = asked.select("task_id", "task_type", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), "error")
    of = lambda t: asked.where((F.col("task_type") == t) & F.col("error").isNull())
    first = Window.partitionBy("task_id", "mode", "item").orderBy("rank")
    found = locate_all(repo, of("locate"), modes, k).select("task_id", "mode", F.col("path").alias("item"), "rank").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    listed = lambda df: df.distinct().crossJoin(F.broadcast(each.sparkSession.createDataFrame([(m,) for m in modes], "mode string"))).select("task_id", "mode", "item", F.lit(None).cast("int").alias("rank"))  # noqa: E731  a row for each mode
    predictions = found.unionByName(listed(impact_all(repo, of("impact")).where("bucket NOT IN ('definition', 'routes')").select("task_id", F.col("file").alias("item"))))
    if repo.hunks is not None:
        predictions = predictions.unionByName(listed(rollback_all(repo, of("rollback")).where("action = 'ROLLBACK'").select("task_id", F.explode("files").alias("item"))))
    return {"runs": each, "predictions": predictions}


def scored_runs(done: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """task_id, task_type, mode, error, precision, recall, f1: a row for each run; null scores where a task has no gold.

    gold: task_id, item. A run that failed, or found nothing, scores zero against its gold.
    """
    runs = done["runs"]
    want = runs.select("task_id", "mode").join(gold.select("task_id", "item").distinct(), "task_id")
    scores = metrics.prf(metrics.set_counts(done["predictions"], want, ["task_id", "mode"], ["item"])).join(want.select("task_id", "mode").distinct(), ["task_id", "mode"], "left_semi")
    return runs.join(scores.select("task_id", "mode", "precision", "recall", "f1"), ["task_id", "mode"], "left")


def report(scored: DataFrame) -> DataFrame:
    """task_type, mode, runs, scored, errors, precision, recall, f1: means over the runs that have gold."""
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return scored.groupBy("task_type", "mode").agg(F.count("*").alias("runs"), F.count("f1").alias("scored"), F.count("error").alias("errors"), mean("precision"), mean("recall"), mean("f1"))
