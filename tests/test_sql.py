"""Queries against their SQL on small tables made for one case each."""

import duckdb

import __spark_entry__ as entry


def same(spark, tmp_path, name, **tables):
    """Write each table (SQL of its rows), run a query and its SQL over them, and return the equal rows."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert got == sorted(con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    return got


DOCS = r"""SELECT * FROM (VALUES (1, 's', 'x émenteneux menteneux'), (2, 's', 'Menteneux'), (3, 's', 'menteneux' || chr(8205) || 'y'), (4, 's', 'ſenteneux menteneuxé'),
(5, 's', 'Kangaroos ''é''kangaroos kangaroos'), (6, 's', 'kangaroos_x'), (7, 's', 'İnventory'), (8, 's', '''ékangaroos'' "x" kangaroos'), (9, 's', chr(8490) || 'angaroos')) t(doc_id, source, text)"""
ITEMS = "SELECT * FROM (VALUES (1, 'menteneux kangaroos'), (2, 'Kangaroos senteneux inventory')) t(item_id, text)"


def test_places_of_terms_beside_letters_that_are_not_ascii(spark, tmp_path):
    got = same(spark, tmp_path, "task_matches", documents=DOCS, benchmark=ITEMS)
    assert (1, "docs/s/1.md", 1, 3, "menteneux") in got


def test_scores_of_terms_beside_letters_that_are_not_ascii(spark, tmp_path):
    same(spark, tmp_path, "task_locate", documents=DOCS, benchmark=ITEMS)


NATION = "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 1)) t(n_nationkey, n_regionkey)"
SUPPLIER = "SELECT CAST(i AS BIGINT) AS s_suppkey, i % 3 AS s_nationkey FROM range(1, 41) t(i)"


def test_paths_of_many_ends_cross_a_hub_once(spark, tmp_path, monkeypatch):
    from stratalens.operators import graph

    sizes, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": sizes.append((out := plain(df, name)).count()) or out)
    got = same(spark, tmp_path, "shortest_path_len", nation=NATION, supplier=SUPPLIER, customer="SELECT i AS c_custkey, i % 3 AS c_nationkey FROM range(600) t(i)", orders="SELECT i AS o_orderkey, i % 600 AS o_custkey FROM range(900) t(i)")
    # ends that each cross their nation would make 39 times 200 rows and more
    assert {r[2] for r in got} == {2, 4} and max(sizes) < 2000


def test_calls_are_folded_by_file_before_they_meet_symbols(spark, tmp_path, monkeypatch):
    from stratalens.operators import codegraph

    met, plain = [], codegraph._elsewhere
    monkeypatch.setattr(codegraph, "_elsewhere", lambda refs, own, symbols: met.append((out := plain(refs, own, symbols)).count()) or out)
    many = {"supplier": "SELECT i AS s_suppkey, i % 25 AS s_nationkey FROM range(1, 700) t(i)", "nation": "SELECT i AS n_nationkey, i % 5 AS n_regionkey FROM range(25) t(i)"}
    same(spark, tmp_path, "callers_3tier", lineitem="SELECT i // 4 AS l_orderkey, 1 + i % 699 AS l_suppkey, i % 4 AS l_linenumber FROM range(8000) t(i)", **many)
    same(spark, tmp_path, "jsx_callers", orders="SELECT i AS o_orderkey, i * 7 AS o_custkey FROM range(8000) t(i)", **many)
    # one row for each file, name and symbol that they meet, not for each call
    assert met[0] <= 50 * 12 and met[1] <= 50 * 6


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from stratalens.operators import cochange, scratch

    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    monkeypatch.setattr(cochange, "PART_ROWS", 100)
    files = spark.range(600).selectExpr("id DIV 6 AS sha", "id % 6 + (id DIV 6) % 2 AS file")
    got = cochange.cochange_pairs(files)
    assert got.rdd.getNumPartitions() >= 15 and got.count() == 20 and {r.n for r in got.collect()} == {50, 100}


def test_range_joins_are_dealt_by_their_rows(spark, monkeypatch):
    from stratalens.operators import ranges, scratch

    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    points = spark.range(1000).selectExpr("id % 50 AS file", "id AS k", "id DIV 2 AS line")
    intervals = spark.range(50).selectExpr("id AS file", "0L AS a", "600L AS z", "id AS ord")
    got = ranges.innermost(points, intervals, ["file"], "line", "a", "z", ["ord"], ["file", "k", "line"])
    assert got.rdd.getNumPartitions() >= 11 and got.count() == 1000 and "_bucket" not in got.columns


ORDERED = {
    "lineitem": "SELECT i // 4 AS l_orderkey, 1 + i % 4 AS l_linenumber, i * 7 % 300 AS l_partkey, 1 + i * 11 % 40 AS l_suppkey, ['A', 'N', 'R'][1 + i % 3] AS l_returnflag, ['F', 'O'][1 + i % 2] AS l_linestatus FROM range(3000) t(i)",
    "orders": "SELECT i AS o_orderkey, ['F', 'O', 'P'][1 + i % 3] AS o_orderstatus FROM range(800) t(i)",
    "part": "SELECT i AS p_partkey, i % 50 AS p_size FROM range(300) t(i)",
}


def dealt_by_rows(spark, tmp_path, monkeypatch, *names):
    from stratalens.operators import scratch

    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    for name in names:
        same(spark, tmp_path, name, **ORDERED)
        assert entry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 10, name


def test_patched_files_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    dealt_by_rows(spark, tmp_path, monkeypatch, "apply_hunks", "apply_status")


def test_events_of_subtrees_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    dealt_by_rows(spark, tmp_path, monkeypatch, "trace_lines")


def test_symbols_meet_their_commit_before_their_callers(spark, tmp_path, monkeypatch):
    dealt_by_rows(spark, tmp_path, monkeypatch, "collateral_callers")


def test_kept_hunks_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    dealt_by_rows(spark, tmp_path, monkeypatch, "preservation_face")


def test_imports_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    from stratalens.operators import codegraph

    dealt_by_rows(spark, tmp_path, monkeypatch, "import_priority")
    files = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("src/b/index.ts",), ("c.tsx",), ("src/c/index.tsx",), ("src/d.css",)], "path string")
    asked = [("./a", "src/a.ts"), ("./b", "src/b/index.ts"), ("./d.css", "src/d.css"), ("../c", "c.tsx"), ("@/c", "src/c/index.tsx"), ("@/src/a", "src/a.ts"), ("react", ""), (None, ""), ("./x", ""), ("@/x", "")]
    imports = spark.createDataFrame([("src/m.ts", s, k) for k, (s, _) in enumerate(asked)] * 2, "importer string, specifier string, k int")
    got = codegraph.resolve_imports(imports, files).collect()
    assert sorted((r.k, r.source_file) for r in got) == sorted([(k, f) for k, (_, f) in enumerate(asked)] * 2)


def test_units_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    from stratalens.operators import units

    dealt_by_rows(spark, tmp_path, monkeypatch, "collateral_risk")
    rows = [("a", [], "ROLLBACK"), ("b", ["f"], "KEEP"), ("b", ["f", "g"], "ROLLBACK"), ("c", None, "KEEP"), ("d", ["f"], None)]
    got = units.collateral_risk(spark.createDataFrame(rows, "sha string, files array<string>, action string")).collect()
    assert {r.sha: (r.risk, r.shared_files) for r in got} == {"a": (0.0, []), "b": (0.35, ["f"]), "c": (0.2, []), "d": (0.2, [])}


def test_files_are_dealt_one_a_row_and_units_without_commit_share_none(spark, tmp_path, monkeypatch):
    from stratalens.operators import scratch

    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    lines = ORDERED["lineitem"].replace("i // 4 AS", "CASE WHEN i % 16 < 8 THEN i // 4 END AS").replace("1 + i * 11 % 40 AS", "CASE WHEN i % 5 > 1 THEN 1 + i % 2 END AS")
    for name in ("collateral_risk", "collateral_callers"):
        got = same(spark, tmp_path, name, **ORDERED | {"lineitem": lines})
        assert [tuple(r)[1:] for r in got if r[0] is None] == [(0.0, "")[: len(got[0]) - 1]], name
        plan = entry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("RepartitionByExpression") < plan.index("Generate"), name


def test_verified_files_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    dealt_by_rows(spark, tmp_path, monkeypatch, "verified_patches")


def test_scores_of_terms_beside_other_spaces_and_line_ends(spark, tmp_path):
    docs = "SELECT * FROM (VALUES (1, 's', chr(160) || '# kangaroos'), (2, 's', chr(12288) || '// menteneux'), (3, 's', 'é' || chr(8232) || 'kangaroos'), (4, 's', ' * kangaroos'), (5, 's', chr(9) || '# kangaroos')) t(doc_id, source, text)"
    got = same(spark, tmp_path, "task_locate", documents=docs, benchmark=ITEMS)
    assert {r[1]: r[4] for r in got if r[0] == 1}["docs/s/1.md"] == 0.765
