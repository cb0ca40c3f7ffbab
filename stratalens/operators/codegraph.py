"""Joins over code facts: callers, callees, importers, import resolution, routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import stable_id

from .scratch import spread


def _with_imports(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (file, name, ...) with _imported: whether the file imports that name."""
    imported = imports.select(F.col("importer").alias("file"), F.explode("names").alias("name")).distinct().withColumn("_imported", F.lit(True))
    return refs.join(imported, ["file", "name"], "left").withColumn("_imported", F.coalesce("_imported", F.lit(False)))


def _elsewhere(refs: DataFrame, own: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs joined with symbols of other files: by name where the file imports it, else with names that occur once.

    A name that many files define meets only the references that import it; all others join a table of single names.
    """
    single = symbols.groupBy("name").agg(F.count("*").alias("_n")).where("_n = 1").select("name")
    known = refs.where("_imported").join(own, "name")
    lone = refs.where("NOT _imported").join(own.join(single, "name", "left_semi"), "name")
    return known.unionByName(lone).where(F.col("file") != F.col("_file"))


def callers(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """qualified, caller, caller_file, line: who calls a symbol, by name, in one of three tiers.

    The call is in the symbol's file, or its file imports that name, or no other symbol has the name: three equi-joins
    that don't overlap, on (file, name), on imported names and on names that occur once.
    """
    refs = calls.select("caller", "line", F.col("caller_file").alias("file"), F.col("callee_short").alias("name"))
    return _called(refs, symbols, imports).select("qualified", "caller", F.col("file").alias("caller_file"), "line")


def _called(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (file, name, ...) with the qualified names of the symbols that each may mean."""
    refs = _with_imports(refs, imports)
    own = symbols.select("qualified", "name", F.col("file").alias("_file"))
    same = refs.join(own.withColumn("file", F.col("_file")), ["file", "name"])
    return same.unionByName(_elsewhere(refs, own, symbols))


def caller_counts(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """qualified, caller_file, n, lines: ``callers`` counted by file, with the sum of their lines.

    The tiers ask for a call's file and name only, so calls that share both are folded before they meet symbols: many
    calls of a name that many symbols have make no rows for each pair.
    """
    refs = calls.groupBy(F.col("caller_file").alias("file"), F.col("callee_short").alias("name")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"))
    return _called(refs, symbols, imports).select("qualified", F.col("file").alias("caller_file"), "n", "lines")


def jsx_callers(jsx_refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """qualified, file, line: where other files render a component that they import or that has a name of its own."""
    return _rendered(jsx_refs.select("file", "line", F.col("component").alias("name")), symbols, imports).select("qualified", "file", "line")


def _rendered(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    own = symbols.where("kind = 'component'").select("qualified", "name", F.col("file").alias("_file"))
    return _elsewhere(_with_imports(refs, imports), own, symbols)


def jsx_counts(jsx_refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """qualified, file, n: ``jsx_callers`` counted by file, folded first like ``caller_counts``."""
    refs = jsx_refs.groupBy("file", F.col("component").alias("name")).agg(F.count("*").alias("n"))
    return _rendered(refs, symbols, imports).select("qualified", "file", "n")


def callees(calls: DataFrame, qualified: str) -> DataFrame:
    """Calls made in a symbol or in a scope nested in it."""
    return calls.where((F.col("caller") == qualified) | F.startswith("caller", F.lit(qualified + ".")))


def indirect_callers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, names: DataFrame, depth: int = 2) -> DataFrame:
    """start, caller, depth, chain: callers of callers up to a depth, the first chain found for each; depth 1 included.

    names: start (a symbol's short name). A level is one join; a caller's short name is what follows its last ``::``
    and dot.
    """
    level = names.select("start", F.col("start").alias("name"), F.array().cast("array<string>").alias("chain"))
    all_calls = callers(calls, symbols, imports).withColumn("name", F.element_at(F.split("qualified", "::"), -1))
    found: DataFrame | None = None
    for d in range(1, depth + 1):
        step = level.join(all_calls, "name").withColumn("chain", F.concat("chain", F.array(F.concat_ws(":", "caller_file", F.col("line").cast("string")))))
        step = step.groupBy("start", "caller").agg(F.min("chain").alias("chain")).withColumn("depth", F.lit(d))
        if found is not None:
            step = step.join(found.select("start", "caller"), ["start", "caller"], "left_anti")
        found = step if found is None else found.unionByName(step)
        level = step.select("start", F.element_at(F.split(F.element_at(F.split("caller", "::"), -1), r"\."), -1).alias("name"), "chain")
    own = F.element_at(F.split("caller", "::"), -1) == F.col("start")
    return found.where(~own).select("start", "caller", "depth", "chain")


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps."""
    return F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))), "/"
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with source_file: the first candidate file that exists, '' for packages, URLs and misses.

    imports: importer, specifier (and more). Candidates are the importer's folder for relative specifiers, ``src`` and
    then the root for ``@/``, each with the known suffixes in order. Files are folded by their paths without suffixes, so a
    candidate meets one row for all suffixes and no import is copied.
    """
    folder = F.regexp_replace("importer", "/?[^/]*$", "")
    spec = F.col("specifier")
    near, aliased = (F.coalesce(x, F.lit(False)) for x in (spec.rlike(r"^\.\.?(/|$)"), F.startswith(spec, F.lit("@/"))))
    inner = F.substring(spec, F.lit(3), F.length(spec))
    # what a file answers to: its path without each suffix that it has; the first suffix counts where files share a name
    ends = F.filter(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(s).alias("end")) for k, s in enumerate(fixed.IMPORT_SUFFIXES)]), lambda s: F.endswith(F.col("path"), s["end"]))
    named = files.select("path", F.explode(ends).alias("s")).select(F.left("path", F.length("path") - F.length("s.end")).alias("_base"), F.col("s.ord").alias("ord"), "path")
    rows = imports.count() + files.count()
    bases = spread(named, rows, "_base").groupBy("_base").agg(F.min_by("path", "ord").alias("source_file"))

    def found(some: DataFrame, at: Column, column: str) -> DataFrame:
        return spread(some.withColumn("_base", normal_path(at)), rows, "_base").join(bases.withColumnRenamed("source_file", column), "_base", "left").drop("_base")

    one = found(imports.where(near), F.concat(folder, F.lit("/"), spec), "source_file")
    two = found(found(imports.where(aliased), F.concat(F.lit("src/"), inner), "_src"), inner, "_root").withColumn("source_file", F.coalesce("_src", "_root")).drop("_src", "_root")
    none = imports.where(~near & ~aliased).withColumn("source_file", F.lit(None).cast("string"))
    return one.unionByName(two).unionByName(none).withColumn("source_file", F.coalesce("source_file", F.lit("")))


def importers(imports: DataFrame, tests_only: bool = False) -> DataFrame:
    """source_file, importer; with tests_only just importers that look like tests."""
    out = imports.where("source_file <> ''").select("source_file", "importer").distinct()
    return out.where(F.col("importer").rlike("test|spec|__tests__")) if tests_only else out


def app_roles(files: DataFrame) -> DataFrame:
    """file, role (api, page or layout), route_path: what the files under an app folder are to its router."""
    parts = F.split("path", "/")
    app = F.array_position(F.slice(parts, F.lit(1), F.size(parts) - 1), "app")
    names = F.create_map(*[F.lit(x) for kv in fixed.APP_ROLES.items() for x in kv])
    role = F.try_element_at(names, F.element_at(parts, -1))
    route = F.concat(F.lit("/"), F.array_join(F.slice(parts, (app + 1).cast("int"), F.greatest((F.size(parts) - app - 1).cast("int"), F.lit(0))), "/"))
    return files.where((app > 0) & role.isNotNull()).select(F.col("path").alias("file"), role.alias("role"), route.alias("route_path"))


def api_endpoints(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file, route_path, methods: route files under an app folder, and the HTTP verbs they define."""
    routes = app_roles(files).where("role = 'api'").drop("role")
    verbs = symbols.where(F.col("name").isin(fixed.HTTP_HANDLERS)).groupBy("file").agg(F.array_sort(F.collect_set("name")).alias("methods"))
    return routes.join(verbs, "file", "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def app_views(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """file, role, qualified: the first component of each page, and the functions and components of each layout."""
    held = symbols.where("kind IN ('component', 'function')").join(app_roles(files).where("role <> 'api'"), "file")
    first = F.row_number().over(Window.partitionBy("file").orderBy("line_start", "qualified"))
    pages = held.where("role = 'page' AND kind = 'component'").withColumn("_k", first).where("_k = 1")
    return pages.select("file", "role", "qualified").union(held.where("role = 'layout'").select("file", "role", "qualified"))


def routes_reaching(endpoints: DataFrame, symbols: DataFrame, chains: DataFrame) -> DataFrame:
    """start, route_path: endpoints one of whose handlers is the start or calls it within the chains' depth."""
    handlers = symbols.where(F.col("name").isin(fixed.HTTP_HANDLERS)).join(endpoints.select("file", "route_path"), "file").select("qualified", "name", "route_path")
    direct = chains.select("start").distinct().join(handlers, F.col("start") == F.col("name")).select("start", "route_path")
    return direct.union(chains.join(handlers, F.col("caller") == F.col("qualified")).select("start", "route_path")).distinct()


def couplings(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """src, dst: sorted distinct edges between two sets of nodes, in either direction."""
    one = edges.join(a.select(F.col("node").alias("src")), "src", "left_semi").join(b.select(F.col("node").alias("dst")), "dst", "left_semi")
    two = edges.join(b.select(F.col("node").alias("src")), "src", "left_semi").join(a.select(F.col("node").alias("dst")), "dst", "left_semi")
    return one.select("src", "dst").union(two.select("src", "dst")).distinct()


def first_existing(candidates: DataFrame, existing: DataFrame, key: list[str], path: str, order: str) -> DataFrame:
    """For each key the candidate of lowest order that exists."""
    return candidates.join(existing, path, "left_semi").groupBy(*key).agg(F.min_by(path, order).alias(path))


def surface(text: Column, words: list[str]) -> Column:
    """Whether a text mentions one of some words, whatever its case."""
    return reduce(lambda x, y: x | y, [F.contains(F.lower(text), F.lit(w)) for w in words])


def context_of(edges: DataFrame, targets: DataFrame, levels: int = 3) -> DataFrame:
    """target, role, node, level: callers and callees through call names, importers, and the routes that reach the target.

    edges: src, dst, type. A scope CALLS a call name which REFERENCES symbols; levels are unrolled joins. A route is an
    endpoint (``api:``) that the target's file (level 0) or a caller's file DEFINES, at the lowest level.
    """
    calls = edges.where("type = 'CALLS'").select(F.col("src").alias("scope"), F.col("dst").alias("call"))
    refs = edges.where("type = 'REFERENCES'").select(F.col("src").alias("call"), F.col("dst").alias("symbol"))
    step = calls.join(refs, "call").select("scope", "symbol").distinct()
    level = targets.select("target", F.col("target").alias("symbol"))
    out: DataFrame | None = None
    for k in range(1, levels + 1):
        up = level.join(step, "symbol").select("target", F.lit("caller").alias("role"), F.col("scope").alias("node"), F.lit(k).alias("level")).distinct()
        if out is not None:
            up = up.join(out.select("target", "node"), ["target", "node"], "left_anti")
        out = up if out is None else out.unionByName(up)
        level = up.select("target", F.regexp_replace("node", "^scope:", "sym:").alias("symbol"))
    down = targets.withColumn("scope", F.regexp_replace("target", "^sym:", "scope:")).join(step, "scope").select("target", F.lit("callee").alias("role"), F.col("symbol").alias("node"), F.lit(1).alias("level"))
    brought = targets.withColumn("dst", F.concat(F.lit("file:"), F.regexp_extract("target", "^sym:(.*)::", 1))).join(edges.where("type = 'IMPORTS'"), "dst").select("target", F.lit("importer").alias("role"), F.col("src").alias("node"), F.lit(1).alias("level"))
    home = lambda c: F.concat(F.lit("file:"), F.regexp_extract(c, "^(?:sym|scope):(.*)::", 1))
    files = targets.select("target", home("target").alias("src"), F.lit(0).alias("level")).union(out.select("target", home("node"), "level"))
    routes = files.join(edges.where("type = 'DEFINES'").where(F.startswith("dst", F.lit("api:"))), "src").groupBy("target", F.col("dst").alias("node")).agg(F.min("level").alias("level")).select("target", F.lit("route").alias("role"), "node", "level")
    return out.unionByName(down).unionByName(brought).distinct().unionByName(routes)


def context_evidence(context: DataFrame, targets: DataFrame) -> DataFrame:
    """id, type, source, target, location, payload: what was read about each target (from ``context_of``), as evidence."""
    n = lambda role, only=F.lit(True): F.count_if((F.col("role") == role) & only)
    read = targets.select("target").distinct().join(context, "target", "left").groupBy("target").agg(F.concat_ws(", ", F.concat(n("caller", F.col("level") == 1), F.lit(" callers")), F.concat(n("callee"), F.lit(" callees")), F.concat(n("importer"), F.lit(" importers"))).alias("payload"))
    location = F.regexp_extract("target", "^sym:(.*)::", 1)
    kind, source = F.lit("AST").alias("type"), F.lit("context").alias("source")
    return read.select(F.concat(F.lit("ev:"), stable_id(F.lit("AST"), "target", location, "payload")).alias("id"), kind, source, "target", location.alias("location"), "payload")


def lexical_impact(found: DataFrame, symbol: str) -> DataFrame:
    """Matched lines of a symbol by role when no facts are there: definition, call or mention."""
    s = "\\Q" + symbol + "\\E"
    role = F.when(F.col("text").rlike(rf"\b(function|class|const|let|var|interface|type|enum)\s+{s}\b"), "definition").when(F.col("text").rlike(rf"\b{s}\s*\("), "call").otherwise("mention")
    return found.withColumn("role", role)


def lexical_roles(found: DataFrame, symbol: Column) -> DataFrame:
    """``lexical_impact`` where each row has its own symbol."""
    s = F.concat(F.lit("\\Q"), symbol, F.lit("\\E"))
    defined = F.regexp_like("text", F.concat(F.lit(r"\b(function|class|const|let|var|interface|type|enum)\s+"), s, F.lit(r"\b")))
    called = F.regexp_like("text", F.concat(F.lit(r"\b"), s, F.lit(r"\s*\(")))
    return found.withColumn("role", F.when(defined, "definition").when(called, "call").otherwise("mention"))


def newest_per(df: DataFrame, by: list[str], time: str, tie: str, n: int = 10) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(time), tie)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
