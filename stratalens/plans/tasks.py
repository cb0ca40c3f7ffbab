"""User-facing questions as one plan each: locate, impact, rollback, history, orchestrate, evaluate.

A Repository holds fact tables; modes stack optional joins: lexical, then structural, then history, then graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import query_terms, query_vocabulary, symbol_pick
from stratalens.operators import cochange, codegraph, evidence, graph, ledger, lifecycle, metrics, policy, ranges, search, semantic, units
from stratalens.operators.scratch import written
from stratalens.sources.script_facts import fact_tables, facts

MODES = ["lexical", "structural", "structural_git", "graph"]


@dataclass
class Repository:
    """Fact tables of one code base: files (path, content), and where there is history commits, commit_files, hunks.

    What every question asks for (facts, units, pairs, the graph) is written once to the shared folder and read from there.
    """

    spark: SparkSession
    files: DataFrame
    commits: DataFrame | None = None
    commit_files: DataFrame | None = None
    hunks: DataFrame | None = None
    name: str = "repo"
    extra: dict = field(default_factory=dict)

    @cached_property
    def facts(self) -> dict[str, DataFrame]:
        code = self.files.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$"))
        found = fact_tables(written(facts(code)))
        found["imports"] = written(codegraph.resolve_imports(found["imports"], self.files))
        return found

    @cached_property
    def endpoints(self) -> DataFrame:
        return codegraph.api_endpoints(self.facts["symbols"], self.files)

    @cached_property
    def pairs(self) -> DataFrame:
        return written(cochange.cochange_pairs(self.commit_files, support=2))

    @cached_property
    def units(self) -> DataFrame:
        h = ranges.hunk_symbols(self.hunks, self.facts["symbols"], ["sha", "file", "idx"]) if self.hunks is not None else None
        named = self.hunks.join(h, ["sha", "file", "idx"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
        f = self.facts
        file_calls = codegraph.callers(f["calls"], f["symbols"], f["imports"]).select("caller_file", F.substring_index("qualified", "::", 1).alias("callee_file")).where("caller_file <> callee_file").distinct()
        return written(units.change_units(units.hunk_features(named), file_calls))

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        f = self.facts
        none = self.spark.createDataFrame([], "sha string, file string")
        cf = self.commit_files if self.commit_files is not None else none
        n, e = graph.code_graph(self.files, f["symbols"], f["imports"], f["calls"], self.endpoints, f["ui_strings"], self.commits if self.commits is not None else none, cf, cochange.cochange_pairs(cf, support=2), self.name)
        return written(n), written(e)


def _mode(mode: str, needs: str) -> bool:
    return MODES.index(mode) >= MODES.index(needs)


def locate(repo: Repository, query: str, mode: str = "lexical", k: int = fixed.TOP_K) -> DataFrame:
    """path, line_start, line_end, symbol, score of the best places for a query."""
    terms = query_terms(query)
    found = search.matches(search.lines(repo.files), terms)
    c = search.locate_groups(found, terms).unionByName(search.file_name_candidates(repo.files, found, terms)).withColumn("symbol", F.lit(None).cast("string"))
    if _mode(mode, "structural"):
        s = repo.facts["symbols"]
        w = Window.partitionBy("path", "line_start").orderBy(F.col("s_end") - F.col("s_start"), "s_ord")
        inside = c.join(s.select(F.col("file").alias("path"), F.col("name").alias("s_name"), F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"), F.col("ord").alias("s_ord")), "path").where(F.col("line_start").between(F.col("s_start"), F.col("s_end")))
        inside = inside.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("path", "line_start", "s_name", "s_start", "s_end")
        words = [t.lower() for t, _ in terms]
        c = c.join(inside, ["path", "line_start"], "left")
        boost = F.when(F.lower("s_name").isin(words), fixed.SAME_SYMBOL_BOOST).otherwise(0.0)
        if set(words) & set(fixed.DICTIONARY["标题"]) | set(words) & {"标题"}:
            boost = boost + F.when(F.col("path").rlike(r"(^|/)app/layout\.tsx$"), fixed.ROOT_LAYOUT_BOOST).otherwise(0.0)
        c = c.select("path", F.coalesce("s_start", "line_start").alias("line_start"), F.coalesce("s_end", "line_end").alias("line_end"), F.round(F.col("score") + boost, 3).alias("score"), "n_hits", F.coalesce("symbol", "s_name").alias("symbol"))
        exact = s.where(F.col("name").isin([t for t, _ in terms])).select(F.col("file").alias("path"), "line_start", "line_end", F.round(fixed.DEFINITION_BOOST + (F.col("line_end") - F.col("line_start") + 1), 3).alias("score"), F.lit(0).cast("bigint").alias("n_hits"), F.col("name").alias("symbol"))
        c = c.unionByName(exact)
    if _mode(mode, "structural_git") and repo.commits is not None:
        votes = cochange.commit_votes(repo.commits.withColumnRenamed("subject", "message") if "message" not in repo.commits.columns else repo.commits, repo.commit_files, [t for t, _ in terms])
        near = cochange.cochange_boost(c.select(F.col("path").alias("file")).distinct(), repo.pairs, votes)
        c = c.join(votes.select(F.col("file").alias("path"), F.col("boost").alias("_v")), "path", "left").join(near.select(F.col("file").alias("path"), F.col("boost").alias("_n")), "path", "left")
        c = c.withColumn("score", F.round(F.col("score") + F.coalesce("_v", F.lit(0.0)) + F.coalesce("_n", F.lit(0.0)), 3)).drop("_v", "_n")
    if _mode(mode, "graph"):
        matched = c.select("path").distinct()
        imports = repo.facts["imports"].where("source_file <> ''").select(F.col("source_file").alias("path"), F.col("importer").alias("other"))
        factor = [(imports, fixed.IMPORTER_BOOST)]
        if repo.commit_files is not None:
            both = repo.pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).union(repo.pairs.select("b", "a"))
            factor.append((both, fixed.COCHANGED_BOOST))
        for i, (links, f) in enumerate(factor):
            hit = links.join(matched.withColumnRenamed("path", "other"), "other", "left_semi").select("path").distinct().withColumn(f"_g{i}", F.lit(f))
            c = c.join(hit, "path", "left").withColumn("score", F.round(F.col("score") * F.coalesce(f"_g{i}", F.lit(1.0)), 3)).drop(f"_g{i}")
        ui = repo.facts["ui_strings"]
        held = F.lit(False)
        for t, o in terms:
            if o.startswith("cjk"):
                held = held | F.contains("text", F.lit(t))
        shown = ui.where(held).select(F.col("file").alias("path")).distinct().withColumn("_ui", F.lit(fixed.GRAPH_UI_BOOST))
        c = c.join(shown, "path", "left").withColumn("score", F.round(F.col("score") * F.coalesce("_ui", F.lit(1.0)), 3)).drop("_ui")
        named = [t for t, _ in terms if len(t) >= 4 and t[0].isalpha()]
        by_symbol = repo.facts["symbols"].where(F.col("name").isin(named)).groupBy(F.col("file").alias("path")).agg(F.min_by(F.struct("name", "line_start"), "line_start").alias("s")).select("path", F.col("s.line_start").alias("line_start"), F.col("s.line_start").alias("line_end"), F.lit(fixed.GRAPH_ONLY_SYMBOL).alias("score"), F.lit(0).cast("bigint").alias("n_hits"), F.col("s.name").alias("symbol"))
        by_symbol = by_symbol.join(matched, "path", "left_anti")
        by_string = shown.select("path").join(matched.union(by_symbol.select("path")), "path", "left_anti").select("path", F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit(round(fixed.GRAPH_ONLY_SYMBOL * fixed.GRAPH_ONLY_UI, 3)).alias("score"), F.lit(0).cast("bigint").alias("n_hits"), F.lit(None).cast("string").alias("symbol"))
        c = c.select("path", "line_start", "line_end", "score", "n_hits", "symbol").unionByName(by_symbol).unionByName(by_string)
    return search.top_k(c, k)


def _scopes(caller: str) -> Column:
    """A scope and the scopes it lies in: what comes before each of its dots."""
    parts = F.split(caller, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def impact(repo: Repository, symbol: str, mode: str = "graph", partners: int = 5) -> DataFrame:
    """bucket, file, name, line for a symbol: callers, callees, importing_files, indirectly_affected and routes; with history
    cochanged (files that change together with its file) and blamed (commits of its lines); with the graph path (how a
    route reaches it).

    A symbol without a definition falls back on its lexical matches, in the buckets definition, call and mention.
    """
    f = repo.facts
    s = f["symbols"].where(F.col("name") == symbol)
    nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    if s.isEmpty():
        found = codegraph.lexical_impact(search.matches(search.lines(repo.files), [(symbol, "en:" + symbol)]), symbol)
        return found.select(F.col("role").alias("bucket"), F.col("path").alias("file"), F.lit(symbol).alias("name"), F.col("line_no").alias("line"))
    q = s.select("qualified")
    direct = codegraph.callers(f["calls"], f["symbols"], f["imports"]).join(q, "qualified", "left_semi")
    jsx = codegraph.jsx_callers(f["jsx_refs"], f["symbols"], f["imports"]).join(q, "qualified", "left_semi")
    chains = codegraph.indirect_callers(f["calls"], f["symbols"], f["imports"], s.select(F.col("name").alias("start")).distinct())
    own = f["calls"].withColumn("qualified", F.explode(_scopes("caller"))).join(q, "qualified", "left_semi")
    reached = codegraph.routes_reaching(repo.endpoints, f["symbols"], chains)
    home = s.select("file").distinct()
    rows = [
        direct.select(F.lit("callers").alias("bucket"), F.col("caller_file").alias("file"), F.col("caller").alias("name"), "line"),
        jsx.select(F.lit("callers"), "file", F.lit("<jsx>"), "line"),
        own.select(F.lit("callees"), F.col("caller_file"), F.col("callee"), "line"),
        codegraph.importers(f["imports"]).join(home.withColumnRenamed("file", "source_file"), "source_file", "left_semi").select(F.lit("importing_files"), "importer", *nothing),
        chains.where("depth > 1").select(F.lit("indirectly_affected"), F.substring_index("caller", "::", 1), "caller", F.lit(None).cast("int")),
        reached.select(F.lit("routes"), F.col("route_path"), *nothing),
    ]
    if _mode(mode, "structural_git") and repo.commit_files is not None:
        near = cochange.partners(repo.pairs, partners).join(home, "file", "left_semi")
        rows.append(near.select(F.lit("cochanged"), F.col("partner"), F.lit(None).cast("string"), F.col("n").cast("int")))
    if _mode(mode, "structural_git") and "blame" in repo.extra:  # file, line_no, sha
        lines = repo.extra["blame"].join(s.select("file", "line_start", "line_end"), "file").where(F.col("line_no").between(F.col("line_start"), F.col("line_end")))
        rows.append(lines.groupBy("file", "sha").agg(F.min("line_no").alias("line")).select(F.lit("blamed"), "file", F.col("sha"), F.col("line").cast("int")))
    if _mode(mode, "graph"):
        starts = f["calls"].select("caller", F.col("caller_file").alias("file")).distinct().join(repo.endpoints.join(reached, "route_path", "left_semi").select("file"), "file", "left_semi").select(F.concat(F.lit("scope:"), "caller").alias("start"))
        ends = starts.crossJoin(F.broadcast(q.select(F.concat(F.lit("sym:"), "qualified").alias("end"))))  # a symbol's few definitions
        found = graph.shortest_paths(repo.graph[1], ends, 6, ["CALLS", "REFERENCES", "DEFINES"])
        rows.append(found.select(F.lit("path"), ledger.file_of(F.regexp_replace("start", "^scope:", "sym:")), F.array_join(F.filter("path", lambda n: ~F.startswith(n, F.lit("callname:"))), " -> "), F.col("hops").cast("int")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def impact_of_query(repo: Repository, query: str) -> DataFrame:
    """impact for the symbol that a query names."""
    name = repo.spark.range(1).select(symbol_pick(F.lit(query)).alias("s")).first().s
    if name is None:
        raise ValueError("the query names no symbol")
    return impact(repo, name)


def rollback(repo: Repository, query: str, sha: str) -> dict[str, DataFrame]:
    """units (with action), risk, contract, hints, couplings and coupling_check for one commit: what to roll back and what to
    keep, what the query says of either side, and imports between them, of which "none" is an answer too."""
    marks = [(query.find(m), len(m)) for m in fixed.KEEP_MARKERS if m in query]
    at, n = min(marks) if marks else (len(query), 0)
    problem, keep = units.text_domains(query[:at]), units.text_domains(query[at + n :])
    own = repo.units.where(F.col("sha") == sha)
    judged = units.classify_units(own, problem, keep)
    sides = judged.select("action", F.explode("files").alias("node")).distinct()
    imports = repo.facts["imports"].where("source_file <> ''").select(F.col("importer").alias("src"), F.col("source_file").alias("dst"))
    back, kept = sides.where("action = 'ROLLBACK'").select("node"), sides.where("action = 'KEEP'").select("node")
    coupled = codegraph.couplings(imports, back, kept)
    check = sides.agg(F.count_if(F.col("action") == "ROLLBACK").alias("rollback_files"), F.count_if(F.col("action") == "KEEP").alias("keep_files")).crossJoin(coupled.agg(F.count("*").alias("couplings")))  # one row each
    hints = repo.spark.createDataFrame([("problem", problem), ("keep", keep)], "side string, domains array<string>")
    return {"units": judged, "risk": units.collateral_risk(judged, repo.facts["calls"]), "contract": lifecycle.plan_contract(judged), "hints": hints, "couplings": coupled, "coupling_check": check}


def history(repo: Repository, terms: list[str]) -> DataFrame:
    """sha, files: commits with a change unit that matches."""
    hit = units.unit_scores(repo.units, terms)
    return hit.groupBy("sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.max("score").alias("score"))


def compound(repo: Repository, query: str, keep_hint: str = "", findings: DataFrame | None = None, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything about a request: where it is, which commits bear on it, both sides and the policy's word, and what share of
    the findings is supported by registered evidence."""
    terms = query_vocabulary(query, "")
    done = orchestrate(repo, query, keep_hint, findings, rows)
    out = {"places": locate(repo, query, "graph"), "commits": history(repo, terms).orderBy(F.desc("score"), "sha"), **done}
    if findings is not None and rows is not None:
        judged = check_findings(findings, rows)
        out["verdicts"] = judged["verdicts"]
        out["verified_fraction"] = judged["verdicts"].agg(F.round(F.coalesce(F.avg((F.col("deterministic") == "SUPPORTED").cast("double")), F.lit(0.0)), 3).alias("verified_fraction"))
    return out


def orchestrate(repo: Repository, query: str, keep_hint: str = "", findings: DataFrame | None = None, rows: DataFrame | None = None, results: DataFrame | None = None) -> dict[str, DataFrame]:
    """Feature, matched units on both sides, arbitration, couplings, task view, gate and recommendation for a request.

    findings and rows (evidence), results (of commands): what the gate counts as unsupported findings and failed tests.
    Edges of the graph whose ends it doesn't hold count as invalid paths.
    """
    f = repo.facts
    features = semantic.seed_features(repo.endpoints, f["symbols"], repo.files)
    mapped = semantic.map_query(features, query)
    best = mapped.first()  # one row
    words = query_vocabulary(query, best.name if best else "")
    problem = units.unit_scores(repo.units, words).withColumnRenamed("sha", "commit")
    kept = units.unit_scores(repo.units, query_vocabulary(keep_hint, "")).withColumnRenamed("sha", "commit") if keep_hint else problem.limit(0)
    sides = units.arbitrate(problem, kept)
    full = repo.units.join(sides.select("unit_id", "side"), "unit_id")
    files = full.select("side", F.explode("files").alias("node")).distinct()
    imports = f["imports"].where("source_file <> ''").select(F.col("importer").alias("src"), F.col("source_file").alias("dst"))
    coupled = codegraph.couplings(imports, files.where("side = 'problem'"), files.where("side = 'keep'"))
    sym = lambda s: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("side") == s, F.transform("symbols", lambda x: F.element_at(F.split(x, "::"), -1))))))
    routes = repo.endpoints.join(files.where("side = 'problem'").select(F.col("node").alias("file")), "file", "left_semi").agg(F.collect_set("route_path").alias("affected_routes"))
    ctx = full.agg(sym("problem").alias("rollback_symbols"), sym("keep").alias("keep_symbols"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("side") == "problem", F.col("files"))))).alias("changed_files"))
    nodes, edges = repo.graph
    ids = nodes.select("id").distinct()
    loose = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti")
    counts = [loose.agg(F.count("*").alias("invalid_graph_paths"))]
    registered = evidence.register_evidence(rows) if rows is not None else None
    counts.append(evidence.unsupported(findings, registered).agg(F.count("*").alias("unsupported_findings")) if findings is not None and registered is not None else repo.spark.range(1).select(F.lit(0).alias("unsupported_findings")))
    counts.append(results.agg(F.count_if(F.coalesce("result", F.lit("PASSED")) != "PASSED").alias("unresolved_test_failures")) if results is not None else repo.spark.range(1).select(F.lit(0).alias("unresolved_test_failures")))
    for c in (routes, *counts):
        ctx = ctx.crossJoin(c)  # one row each
    gate = policy.analysis_gate(ctx)
    advice = gate.withColumn("recommendation", policy.recommendation(F.col("action"), F.lit(not coupled.isEmpty()), F.lit(True)))
    targets = mapped.select(F.lit("request").alias("task_id"), F.col("id").alias("feature")).join(features.select(F.col("id").alias("feature"), F.col("symbol").alias("target")), "feature").select("task_id", "target")
    view = graph.task_view(nodes, edges, targets)
    return {"features": mapped, "sides": sides, "couplings": coupled, "gate": advice, "decisions": policy.gate_decisions(gate.withColumn("_key", F.lit(query)), "_key"), "view_nodes": view[0], "view_edges": view[1]}


def execute(repo: Repository, judged: DataFrame, results: DataFrame | None = None, snapshot: DataFrame | None = None, cited: DataFrame | None = None, registered: DataFrame | None = None, after: DataFrame | None = None) -> dict[str, DataFrame]:
    """The patch that undoes the rolled-back hunks, tried on the files' lines and checked: nothing is written to a repository.

    judged: units with action. results: execution_id, result of validation commands, as an input table. snapshot (path,
    hash, see ``lifecycle.content_hashes``): the files as the plan was made on them; cited (sha, id): the evidence that
    the plan names, registered (id): what there is. Without these there is no evidence. after: the line table that a
    sandbox was left with; without it that of the patch.

    ``status`` is a commit's PATCH_BUILT, STALE_PLAN (a planned file is no longer what the snapshot says) or CONFLICT (a
    hunk is missing or doesn't fit), ``applied`` each file's, ``after`` the lines left. ``verification`` compares them
    with those before, file by file; a commit that is not PATCH_BUILT is never more than FAILED.
    """
    picked = lambda action: judged.where(F.col("action") == action).select("sha", F.explode("hunks").alias("h")).select("sha", "h.file", "h.idx")
    refs = picked("ROLLBACK")
    lost = lifecycle.missing_hunks(refs, repo.hunks)
    own = repo.hunks.join(refs, ["sha", "file", "idx"], "left_semi")
    kept = repo.hunks.join(picked("KEEP"), ["sha", "file", "idx"], "left_semi")
    undo = lifecycle.inverse_hunks(own)
    before = written(search.lines(repo.files).select("path", "line_no", "text"))
    planned, applied = lifecycle.apply_hunks(before, undo)
    planned, applied = written(planned), written(applied)
    plan = judged.where("action = 'ROLLBACK'").select("sha", F.explode("files").alias("file")).distinct()
    patches = lifecycle.patch_text(undo)
    now = lifecycle.content_hashes(before)
    stale = plan.limit(0).select("sha").withColumn("_stale", F.lit(True))
    attempt = plan.select("sha").distinct().join(patches.groupBy("sha").agg((F.count("*") > 0).alias("has_patches")), "sha", "left").withColumn("has_snapshot", F.lit(snapshot is not None))
    if snapshot is not None:
        known = plan.join(snapshot.select(F.col("path").alias("file"), F.col("hash").alias("then")), "file", "left").join(now.select(F.col("path").alias("file"), "hash"), "file", "left")
        stale = known.where("then IS NOT NULL AND NOT then <=> hash").select("sha").distinct().withColumn("_stale", F.lit(True))
        attempt = attempt.drop("has_snapshot").join(known.groupBy("sha").agg((F.count("then") == F.count("*")).alias("has_snapshot")), "sha", "left")
    ids = cited.groupBy("sha").agg(F.collect_set("id").alias("evidence_ids")) if cited is not None else plan.limit(0).select("sha", F.array().cast("array<string>").alias("evidence_ids"))
    proof = lifecycle.evidence_face(attempt.join(ids, "sha", "left"), registered if registered is not None else cited.limit(0) if cited is not None else plan.limit(0).select(F.col("sha").alias("id")))
    tests = F.lit(False) if results is None else F.lit(not results.isEmpty() and lifecycle.validation_status(results).where("NOT tests").isEmpty())
    judged_faces = written(lifecycle.verify(before, planned, after if after is not None else planned, applied, own, kept, plan, proof.withColumn("tests", tests)))
    built = lifecycle.patch_status(refs, repo.hunks).join(stale, "sha", "left").join(judged_faces.select("sha", "conflict"), "sha", "left")
    status = F.when(F.col("_stale"), "STALE_PLAN").when(F.size(F.coalesce("conflict", F.array())) > 0, "CONFLICT").otherwise(F.col("status"))
    built = built.select("sha", status.alias("status"))
    verdict = built.join(judged_faces, "sha", "left").withColumn("overall", F.when(F.col("status") == "PATCH_BUILT", F.col("overall")).otherwise("FAILED"))
    return {"missing": lost, "status": built, "patch": patches, "signature": lifecycle.patch_signature(undo), "applied": applied, "after": after if after is not None else planned, "verification": verdict.drop("status")}


def evaluate(predictions: DataFrame, gold: DataFrame, tasks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Mean precision, recall and F1, runs and errors by task type and mode.

    predictions: task_id, mode, item; gold: task_id, item. runs (task_id, mode, error) names all runs, those without a
    prediction and those that failed as well: they count with zeros.
    """
    known = predictions.select("task_id", "mode").distinct().withColumn("error", F.lit(None).cast("string")) if runs is None else runs
    want = known.select("task_id", "mode").join(gold, "task_id")
    scored = metrics.prf(metrics.set_counts(predictions, want, ["task_id", "mode"], ["item"]))
    scored = known.join(scored, ["task_id", "mode"], "left").na.fill(0.0, ["precision", "recall", "f1"]).join(tasks.select("task_id", "task_type"), "task_id")
    means = metrics.macro_means(scored, ["task_type", "mode"], ["precision", "recall", "f1"])
    return means.join(scored.groupBy("task_type", "mode").agg(F.count("*").alias("runs"), F.count("error").alias("errors")), ["task_type", "mode"])


def check_findings(findings: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Conflicts and verdicts of findings under registered evidence."""
    registered = evidence.register_evidence(rows)
    hot = evidence.conflicts(findings)
    return {"conflicts": hot, "verdicts": evidence.verdicts(findings, registered, hot), "unsupported": evidence.unsupported(findings, registered)}
