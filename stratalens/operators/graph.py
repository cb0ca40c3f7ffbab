"""A layered property graph as two tables: nodes(id, type, layer, props) and edges(src, dst, type, layer, salt, cnt, props)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import deleted, spread, written


def fold_nodes(raw: DataFrame) -> DataFrame:
    """id, type, layer, props, conflicts from rows of id, type, layer, ord, props (map).

    Each property keeps the value of the lowest ord; properties with other values are listed in conflicts. One id under
    two types is an error.
    """
    base = raw.groupBy("id").agg(F.min("type").alias("type"), F.max("type").alias("_other"), F.min_by("layer", "ord").alias("layer"))
    checked = base.withColumn("type", F.when(F.col("type") == F.col("_other"), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("two types for node "), F.col("id")))))
    kv = raw.select("id", "ord", F.explode("props").alias("k", "v")).groupBy("id", "k").agg(F.min_by("v", "ord").alias("v"), F.count_distinct("v").alias("n"))
    props = kv.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("k")))).alias("conflicts"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return checked.join(props, "id", "left").select("id", "type", "layer", F.coalesce("props", empty).alias("props"), F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"))


def fold_edges(raw: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """src, dst, type, salt, cnt, layer, props: repeated edges counted, each property from the lowest ord that has it.

    With the properties' names an edge is one group with a column for each, combined before the only shuffle. Without
    them rows are folded by edge and property first, then by edge.
    """
    key = ["src", "dst", "type", "salt"]
    if properties is None:
        own = F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"))
        each = raw.select(*key, "ord", "layer", F.explode(F.array_append(F.transform(F.map_entries(F.coalesce("props", F.expr("CAST(map() AS map<string,string>)"))), lambda e: F.struct(e.key.cast("string").alias("k"), e.value.cast("string").alias("v"))), own)).alias("p"))
        kv = each.groupBy(*key, "p.k").agg(F.min_by("p.v", "ord").alias("v"), F.count("*").alias("n"), F.min_by("layer", "ord").alias("layer"))
        mine = lambda c: F.max(F.when(F.col("k").isNull(), F.col(c)))
        found = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))
        folded = kv.groupBy(*key).agg(mine("n").alias("cnt"), mine("layer").alias("layer"), found.alias("_p"))
    else:
        # a null ord takes no part in min_by, so only rows that hold the property count
        held = [F.when(F.map_contains_key("props", k), F.col("ord")) for k in sorted(properties)]
        own = [F.min_by(F.try_element_at("props", F.lit(k)).cast("string"), o).alias(f"_v{i}") for i, (k, o) in enumerate(zip(sorted(properties), held, strict=True))]
        has = [F.count(o).alias(f"_n{i}") for i, o in enumerate(held)]
        folded = raw.groupBy(*key).agg(F.count("*").alias("cnt"), F.min_by("layer", "ord").alias("layer"), *own, *has)
        found = F.array_compact(F.array(*[F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(k).alias("k"), F.col(f"_v{i}").alias("v"))) for i, k in enumerate(sorted(properties))]))
        folded = folded.withColumn("_p", found)
    return folded.select(*key, "cnt", "layer", F.when(F.size("_p") > 0, F.map_from_entries("_p")).alias("props"))


def prune_layers(nodes: DataFrame, edges: DataFrame, layers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the active layers, and edges of them whose ends are both left."""
    n = nodes.where(F.col("layer").isin(layers))
    return n, induced(n, edges.where(F.col("layer").isin(layers)))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes: two semi-joins."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def layer_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy("layer").agg(F.count("*").alias("nodes"))
    b = edges.groupBy("layer").agg(F.count("*").alias("edges"))
    return a.join(b, "layer", "full_outer").na.fill(0, ["nodes", "edges"])


def _steps(edges: DataFrame, types: list[str] | None, direction: str) -> DataFrame:
    e = edges if types is None else edges.where(F.col("type").isin(types))
    out, back = e.select(F.col("src").alias("u"), F.col("dst").alias("v")), e.select(F.col("dst").alias("u"), F.col("src").alias("v"))
    return (out if direction == "out" else back if direction == "in" else out.union(back)).distinct()


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1, types: list[str] | None = None, direction: str = "out") -> DataFrame:
    """start, id, depth: what is reached within a number of steps, first depth only, the start itself left out.

    Levels are unrolled joins, each against what was seen before; long walks cut their lineage.
    """
    step = _steps(edges, types, direction)
    seen = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(step, F.col("id") == F.col("u")).select("start", F.col("v").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        frontier = written(new) if d % 3 == 0 else new
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def neighbours_stored(adjacency: DataFrame, starts: DataFrame, depth: int = 1, types: list[str] | None = None, direction: str = "out", layers: list[str] | None = None) -> DataFrame:
    """``neighbours`` over a table of ``sinks.write_adjacency``: a level shuffles its frontier, never the edges.

    The table is read with its layers pruned, and the frontier is dealt like its buckets.
    """
    e = adjacency if layers is None else adjacency.where(F.col("layer").isin(layers))
    e = e if types is None else e.where(F.col("type").isin(types))
    if direction != "both":
        e = e.where(F.col("forward") if direction == "out" else ~F.col("forward"))
    seen = written(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct(), "seen")
    frontier = seen
    for d in range(1, depth + 1):
        met = frontier.select("start", F.col("id").alias("u")).join(e.select("u", "v").hint("merge"), "u").select("start", F.col("v").alias("id")).distinct()
        frontier = written(met.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 6, types: list[str] | None = None) -> DataFrame:
    """start, end, path, hops: a shortest path over edges taken both ways, the least of equal ones; none beyond max_hops.

    Breadth-first from both ends, once for all pairs that share an end; each step goes on from the side whose frontier has
    fewer edges, so ends that many pairs have in a hub don't each cross its neighbours. A path is met between the levels
    reached, whatever they are: pairs meet the smaller frontier first and the other by node. A pair's end stops when all its
    pairs are found, nodes seen before aren't entered again, and what is kept for a node is the least path to it. All paths
    to one level have equal lengths, so the least whole path is made of least halves.
    """
    step = written(_steps(edges, types, "both"), "steps")
    degrees = written(step.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n")), "degrees")
    todo = written(pairs.select("start", "end").distinct(), "pairs")
    found = todo.where("start = end").select("start", "end", F.array("start").alias("path"))
    sides = {}
    for own in ("start", "end"):
        seen = written(todo.select(F.col(own).alias("own"), F.col(own).alias("id"), F.array(own).alias("path")).distinct(), "seen")
        sides[own] = [seen, seen]
    kept = [step, degrees, todo, sides["start"][0], sides["end"][0]]
    for _ in range(max_hops):
        left = written(todo.join(found.select("start", "end"), ["start", "end"], "left_anti"), "left")
        kept.append(left)
        ahead = {own: frontier.join(left.select(F.col(own).alias("own")).distinct(), "own", "left_semi") for own, (_, frontier) in sides.items()}
        edges_of = {own: f.join(degrees, "id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for own, f in ahead.items()}
        own = min(edges_of, key=edges_of.get)
        if edges_of[own] == 0:
            break
        seen = sides[own][0]
        put = (lambda p, x: F.concat(p, F.array(x))) if own == "start" else (lambda p, x: F.concat(F.array(x), p))
        new = ahead[own].join(step, F.col("id") == F.col("u")).groupBy("own", F.col("v").alias("to")).agg(F.min(put(F.col("path"), F.col("v"))).alias("path"))
        new = written(new.withColumnRenamed("to", "id").join(seen.select("own", "id"), ["own", "id"], "left_anti").select("own", "id", "path"), "frontier")
        kept.append(new)
        sides[own] = [seen.unionByName(new), new]
        halves = {"start": sides["start"][1].select(F.col("own").alias("start"), "id", F.col("path").alias("a")), "end": sides["end"][1].select(F.col("own").alias("end"), "id", F.col("path").alias("b"))}
        rows = {o: left.join(h.groupBy(o).agg(F.count("*").alias("n")), o).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for o, h in halves.items()}
        near, far = sorted(halves, key=rows.get)
        met = left.join(halves[near], near).join(halves[far], [far, "id"])
        met = written(met.groupBy("start", "end").agg(F.min(F.concat("a", F.slice("b", F.lit(2), F.size("b")))).alias("path")), "found")
        found = found.unionByName(met)
    out = written(found.select("start", "end", "path", (F.size("path") - 1).alias("hops")), "paths")
    deleted(*kept)
    return out


def task_view(nodes: DataFrame, edges: DataFrame, targets: DataFrame, types: list[str] | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(task_id, id) and (task_id, src, dst, type) around the targets (task_id, target); unknown targets are skipped."""
    known = targets.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    e = edges if types is None else edges.where(F.col("type").isin(types))
    inside = known.select("task_id", F.col("target").alias("id"), F.lit(0).alias("depth")).distinct()
    frontier, got = inside, None
    for d in range(1, depth + 1):
        f = frontier.select("task_id", "id")
        touched = f.join(e, F.col("id") == F.col("src")).select("task_id", "src", "dst", "type").union(f.join(e, F.col("id") == F.col("dst")).select("task_id", "src", "dst", "type")).distinct()
        got = touched if got is None else got.union(touched).distinct()
        ends = touched.select("task_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
        frontier = ends.join(inside.select("task_id", "id"), ["task_id", "id"], "left_anti").withColumn("depth", F.lit(d))
        inside = inside.unionByName(frontier)
    return inside, got


def expand_view(view_nodes: DataFrame, view_edges: DataFrame, edges: DataFrame, seeds: DataFrame, types: list[str], depth: int, trigger: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A view grown from seeds (task_id, target) over some relations, and the audit rows that say so."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    more_nodes, more_edges = task_view(ids, edges, seeds, types, depth)
    audit = seeds.select("task_id", F.col("target").alias("seed"), F.lit(",".join(types)).alias("relation"), F.lit(depth).alias("depth"), F.lit(trigger).alias("trigger"))
    merged = view_nodes.select("task_id", "id", "depth").unionByName(more_nodes).groupBy("task_id", "id").agg(F.min("depth").alias("depth"))
    return merged, view_edges.unionByName(more_edges).distinct(), audit


def dump_view(view_edges: DataFrame, most: int = 4000) -> DataFrame:
    """task_id, text: the view's edges as sorted lines, cut to a number of characters.

    Only lines that begin within the cut are brought together: a running length over each task's sorted lines tells which.
    """
    line = F.concat_ws(" ", "src", F.concat(F.lit("-"), F.col("type"), F.lit("->")), "dst")
    w = Window.partitionBy("task_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = view_edges.select("task_id", line.alias("line")).distinct().withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)))
    begun = lines.where(F.col("at") < most).groupBy("task_id").agg(F.array_sort(F.collect_list("line")).alias("l"))
    return begun.select("task_id", F.left(F.array_join("l", "\n"), F.lit(most)).alias("text"))


def _doubled(pointers: DataFrame, most: int) -> DataFrame:
    """id, to, dist, done: where pointers (id, to, dist, done) lead in the end; each round takes twice as many steps."""
    now = written(pointers, "pointers")
    for _ in range(most.bit_length() + 1):
        if now.where("NOT done").isEmpty():
            return now
        step = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        new = written(spread(now.where("NOT done"), most, "to").join(spread(step, most, "to"), "to", "left").select("id", F.coalesce("to2", "to").alias("to"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("done2", F.lit(True)).alias("done")).unionByName(now.where("done")), "pointers")
        deleted(now)
        now = new
    if now.where("NOT done").isEmpty():
        return now
    raise ValueError("the events' parents run in circles")


def subtree(events: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id, depth: the events below each root by parent pointers, the root included; a root below another is in both.

    Pointer doubling: every event's pointer to the nearest root above it takes twice as many steps with each round, so a
    chain of any length is done in as many rounds as its length has bits. Roots that lie below roots are closed in the
    same way. An event whose parent isn't there is below no root but itself; parents that run in circles below no root
    are an error.
    """
    tops = roots.select(F.col("id").alias("r")).distinct()
    most = max(events.count(), 1)
    own = events.select("id", "parent", F.lit(None).cast("boolean").alias("is_root")).union(tops.select("r", F.lit(None).cast(events.schema["parent"].dataType), F.lit(True)))
    marked = spread(own, most, "id").groupBy("id").agg(F.max("parent").alias("parent"), F.max("is_root").alias("is_root"))
    pointers = marked.where("is_root IS NOT NULL OR parent IS NOT NULL").select("id", F.when(F.col("is_root"), F.col("id")).otherwise(F.col("parent")).alias("to"), F.when(F.col("is_root"), 0).otherwise(1).alias("dist"), F.coalesce("is_root", F.lit(False)).alias("done"))
    near = spread(_doubled(pointers, most), most, "to").join(spread(tops.withColumnRenamed("r", "to"), most, "to"), "to", "left_semi").select("id", F.col("to").alias("root"), F.col("dist").alias("depth"))
    # links from a root to the nearest root above it, closed by squaring
    up = marked.where("is_root AND parent IS NOT NULL").select(F.col("id").alias("low"), F.col("parent").alias("id")).join(near, "id").select("low", F.col("root").alias("high"), (F.col("depth") + 1).alias("steps"))
    links = written(up, "links")
    for _ in range(most.bit_length() + 1):
        far = links.select(F.col("low").alias("high"), F.col("high").alias("high2"), F.col("steps").alias("steps2"))
        new = links.join(far, "high").select("low", F.col("high2").alias("high"), (F.col("steps") + F.col("steps2")).alias("steps")).unionByName(links).where("low <> high").groupBy("low", "high").agg(F.min("steps").alias("steps"))
        new = written(new, "links")
        grown = new.count() > links.count()
        deleted(links)
        links = new
        if not grown:
            break
    above = near.join(links.withColumnRenamed("low", "root"), "root").select(F.col("high").alias("root"), "id", (F.col("depth") + F.col("steps")).alias("depth"))
    return near.select("root", "id", "depth").unionByName(above)


def code_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, endpoints: DataFrame, ui: DataFrame, commits: DataFrame, commit_files: DataFrame, pairs: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the code layer: one projection for each kind of fact, in one union."""
    sid = F.concat(F.lit("sym:"), F.col("qualified"))
    fid = lambda c: F.concat(F.lit("file:"), F.col(c))
    kind = F.initcap(F.regexp_replace("kind", "arrow_const", "function"))

    def node(df, id_, type_):
        return df.select(id_.alias("id"), type_.alias("type")).distinct()

    def edge(df, a, b, type_, salt=None):
        return df.select(a.alias("src"), b.alias("dst"), F.lit(type_).alias("type"), (salt if salt is not None else F.lit("")).cast("string").alias("salt"))

    root = F.lit(f"repo:{repo}")
    scope = F.concat(F.lit("scope:"), F.col("caller"))
    name = F.concat(F.lit("callname:"), F.col("callee_short"))
    string = F.concat(F.lit("uistr:"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.lpad(F.lower(F.hex(F.crc32(F.col("text").cast("binary")))), 8, "0"))
    nodes = [
        node(files.limit(1), root, F.lit("Repository")), node(files, fid("path"), F.lit("File")), node(symbols, sid, kind), node(endpoints, F.concat(F.lit("api:"), F.col("file")), F.lit("APIEndpoint")),
        node(ui, string, F.lit("UIString")), node(calls, scope, F.lit("Scope")), node(calls, name, F.lit("CallName")), node(commits, F.concat(F.lit("commit:"), F.col("sha")), F.lit("Commit")),
    ]
    known = files.select(F.col("path").alias("file"))
    edges = [
        edge(files, root, fid("path"), "CONTAINS"), edge(symbols, fid("file"), sid, "DEFINES"), edge(endpoints, fid("file"), F.concat(F.lit("api:"), F.col("file")), "DEFINES"), edge(ui, fid("file"), string, "CONTAINS"),
        edge(imports.where("source_file <> ''"), fid("importer"), fid("source_file"), "IMPORTS"), edge(calls, scope, name, "CALLS", F.col("line")),
        edge(calls.select("callee_short").distinct().join(symbols, F.col("callee_short") == F.col("name")), name, sid, "REFERENCES"),
        edge(commit_files.join(known, "file", "left_semi"), F.concat(F.lit("commit:"), F.col("sha")), fid("file"), "MODIFIES"), edge(pairs, fid("a"), fid("b"), "CO_CHANGED_WITH"),
    ]
    all_nodes, all_edges = nodes[0], edges[0]
    for x in nodes[1:]:
        all_nodes = all_nodes.unionByName(x)
    for x in edges[1:]:
        all_edges = all_edges.unionByName(x)
    counted = all_edges.groupBy("src", "dst", "type", "salt").agg(F.count("*").alias("cnt"))
    return all_nodes.distinct().withColumn("layer", F.lit("code")), counted.withColumn("layer", F.lit("code"))


def change_graph(units: DataFrame, commit_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the change layer from units (sha, unit_id, symbols, hunks)."""
    cu = F.concat(F.lit("cu:"), F.col("unit_id"))
    commit = F.concat(F.lit("commit:"), F.col("sha"))
    hunks = units.select("sha", "unit_id", F.explode("hunks").alias("h"))
    hunk = F.concat(F.lit("hunk:"), F.col("unit_id"), F.lit(":"), F.col("h.file"), F.lit(":"), F.col("h.idx").cast("string"))
    changed = units.select("sha", "unit_id", F.explode("symbols").alias("s"))
    csym = F.concat(F.lit("csym:"), F.left("sha", F.lit(10)), F.lit(":"), F.col("s"))
    nodes = units.select(cu.alias("id"), F.lit("ChangeUnit").alias("type")).union(hunks.select(hunk, F.lit("Hunk"))).union(changed.select(csym, F.lit("ChangedSymbol"))).distinct()
    edges = (
        units.select(commit.alias("src"), cu.alias("dst"), F.lit("CONTAINS_CHANGE").alias("type")).union(units.select(cu, commit, F.lit("INTRODUCED_BY")))
        .union(hunks.select(cu, hunk, F.lit("CONTAINS_CHANGE"))).union(hunks.select(F.concat(F.lit("file:"), F.col("h.file")), commit, F.lit("CHANGED_BY")))
        .union(changed.select(csym, F.concat(F.lit("sym:"), F.col("s")), F.lit("REPRESENTS"))).distinct()
    )
    return nodes.withColumn("layer", F.lit("change")), edges.withColumn("layer", F.lit("change"))
