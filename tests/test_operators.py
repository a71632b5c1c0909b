import json
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from pagelattice.operators import columns, components, describe, pairs, updates
from pagelattice.operators.components import components_within, connected_components
from pagelattice.sources import fixtures


def brute(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)] + [(500, k) for k in range(501, 560)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == brute({n for e in edges for n in e}, edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_rounds_and_in_one_task_agree(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(-150, 150), rng.randrange(-150, 150)) for _ in range(120)] + [(k, k + 1) for k in range(200, 400)] + [(None, 1), (2, None), (7, 7)]
    for kind in ("int", "long", "string"):
        own = [tuple(None if x is None else str(x) for x in e) for e in edges] if kind == "string" else edges
        frame = spark.createDataFrame(own, f"a {kind}, b {kind}").repartition(5)
        whole = [e for e in own if None not in e]
        for few in (components.FEW, 0):
            monkeypatch.setattr(components, "FEW", few)
            assert {r["node"]: r["component"] for r in connected_components(frame).collect()} == brute({n for e in whole for n in e}, whole)


def test_components_of_few_edges_take_few_tasks(spark):
    context, own = spark.sparkContext, {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        context.setJobGroup("few edges", "few edges")
        connected_components(spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few edges") for s in told.getJobInfo(j).stageIds}
    assert 0 < sum(x.numTasks for s in stages if (x := told.getStageInfo(s))) < 500


def test_components_within_groups_match_brute_force(spark):
    rng = random.Random(6)
    rows = [(g, rng.randrange(60), rng.randrange(60), rng.random()) for g in ("x", "y", "z" * 9) for _ in range(90)] + [("chain", k, k + 1, 0.1) for k in range(300)]
    frame = spark.createDataFrame(rows, "page_id string, i int, j int, d double").repartition(7)
    found = {(r["page_id"], r["node"]): r["component"] for r in components_within(frame, "page_id", "i", "j", "d", 0.4).collect()}
    for g in {r[0] for r in rows}:
        edges = [(a, b) for own, a, b, d in rows if own == g and d <= 0.4]
        assert {n: c for (own, n), c in found.items() if own == g} == brute({n for e in edges for n in e}, edges)
    assert components_within(frame.limit(0), "page_id", "i", "j").count() == 0


def test_clusters_of_large_and_text_page_ids(spark):
    for kind, page in (("long", 3_000_000_000), ("string", "p")):
        elements = spark.createDataFrame([(page, i) for i in range(3)], f"page_id {kind}, idx int")
        distances = spark.createDataFrame([(page, 0, 2, 0.1)], f"page_id {kind}, i int, j int, d double")
        assert {r["idx"]: r["cluster_key"] for r in pairs.clustered(distances, elements, ["d"]).collect()} == {0: 0, 1: None, 2: 0}


def test_repeats_are_numbered_by_page(spark):
    rows = spark.createDataFrame([(1, 0, "h"), (1, 1, "h"), (1, 2, "k"), (2, 0, "h"), (2, 5, "h")], "page_id int, idx int, hash string")
    assert sorted(tuple(r) for r in describe.number_repeats(rows, "hash", "idx").select("page_id", "idx", "name").collect()) == [(1, 0, "h"), (1, 1, "h__2"), (1, 2, "k"), (2, 0, "h"), (2, 5, "h__2")]


def test_dbscan_border_and_noise(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8)], "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 7, 8, 9)], "node long")
    assert {r[0]: r[1] for r in pairs.dbscan(edges, nodes, 3).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: None, 8: None, 9: None}


def test_consolidate_ignores_order(spark):
    a = spark.createDataFrame([(1, "x", ""), (1, "x", "b")], "page_id int, node_id string, v string")
    b = spark.createDataFrame([(1, "x", 3)], "page_id int, node_id string, w int")
    for feeds in ([a, b], [b, a]):
        assert describe.consolidate(feeds).select("v", "w").first()[:] == ("b", 3)


def test_pairs_are_an_equi_join(spark):
    rows = spark.createDataFrame([(p, i) for p in range(3) for i in range(4)], "page_id int, idx int")
    found = pairs.pairs_within(rows)
    assert found.count() == 18
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pairs_broadcast_no_elements(spark):
    rows = spark.createDataFrame([(k // 40, k % 40) for k in range(80)], "page_id int, idx int").withColumn("styles", F.array_repeat(F.lit("x"), 134))
    plan = pairs.pairs_within(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_pairs_of_large_pages_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LARGE", 7)
    rows = spark.createDataFrame([(1, k, f"n{k}") for k in range(30)] + [(2, k, "x") for k in range(5)] + [(3, 1, "y"), (None, 1, "z")], "page_id int, idx int, n string")
    found = pairs.pairs_within(rows)
    assert found.columns == ["a_page_id", "a_idx", "a_n", "b_page_id", "b_idx", "b_n"]
    assert sorted((r["a_page_id"], r["a_idx"], r["b_idx"]) for r in found.collect()) == [(p, i, j) for p, n in ((1, 30), (2, 5)) for i in range(n) for j in range(i + 1, n)]
    assert found.filter("a_page_id = 1 and (b_n <> concat('n', b_idx) or a_n <> concat('n', a_idx))").count() == 0


def test_elements_of_a_small_file_are_dealt_over_all_tasks(spark, tmp_path):
    spark.range(200).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert fixtures.elements(spark, str(tmp_path), fixtures.RECT).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_clusters_and_leftovers_are_disjoint(spark):
    elements = spark.createDataFrame([(1, i) for i in range(5)], "page_id long, idx int")
    distances = spark.createDataFrame([(1, 0, 1, 0.0), (1, 0, 2, 1.0), (1, 3, 4, 0.1)], "page_id long, i int, j int, d double")
    got = {r["idx"]: r["cluster_key"] for r in pairs.clustered(distances, elements, ["d"]).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 3, 4: 3}


def test_redundant_columns(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "x1"), ("c", "x1"), ("d", None)], "col_id string, text string")
    assert {r[0] for r in columns.drop_redundant(rows).select("col_id").distinct().collect()} == {"a", "c"}


def test_streamed_actions(spark, tmp_path):
    from pagelattice.streaming import ingest

    messages = ['{"task_uid": "t1", "action": "elemsSelected", "data": {"chosenElemIds": ["c", "a", "none", "b", "d"]}}', '{"task_uid": "t2", "action": "elemsSelected", "data": {"chosenElemIds": ["a"]}}', '{"task_uid": "t3", "action": "other"}', "no json"]
    elements = spark.createDataFrame([("t1", n, u) for n, u in (("a", "u1"), ("b", ""), ("c", "u3"), ("d", "u4"))] + [("t2", "a", "u1")], "task_uid string, node_id string, url string")
    spark.createDataFrame([(m,) for m in messages], "value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    ingest.action_stream(stream, elements, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    rows = spark.read.schema("task_uid string, urls array<string>, error string").json(str(tmp_path / "out"))
    assert sorted((tuple(r) for r in rows.select("task_uid", "urls", "error").collect()), key=str) == [("t1", ["u3", "u1", "u4"], None), ("t2", ["u1"], "failed to fetch 2 or more HTML pages")]


def test_requests_find_their_pages(spark):
    from pagelattice.streaming import ingest

    raw = spark.createDataFrame([('{"task_uid": "t", "page_url": "http://a/b"}',), ("no json",)], "value string")
    pages = spark.createDataFrame([(1, "http://a/b", "<a>"), (2, "http://c", "")], "page_id long, url string, html string")
    assert [tuple(r) for r in ingest.requested_pages(ingest.parse_requests(raw), pages).collect()] == [("t", 1, "http://a/b", "<a>")]


def test_readers_of_cases_and_truth(spark, tmp_path):
    from pagelattice.operators.updates import write_json
    from pagelattice.sources import fixtures

    (tmp_path / "cases").mkdir()
    (tmp_path / "cases" / "one.json").write_text(json.dumps({"context": {"page_url": "u", "quick": True}, "elem_descriptions": [{"text": "a"}, {"text": "b"}]}, indent=1))
    (tmp_path / "cases" / "one.png").write_text("")
    schema = "context struct<page_url:string,quick:boolean>, elem_descriptions array<struct<text:string>>"
    cases = fixtures.read_cases(spark, str(tmp_path / "cases"), schema)
    assert sorted(tuple(r) for r in cases.collect()) == [("u", True, 0, "a"), ("u", True, 1, "b")]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "x.json").write_text(json.dumps({"cluster_ids": [["1", "2"], ["3"]], "results_old": {"matrix_results": {"f": {"1__2": 0.1, "1__3": 0.9}}}, "results_new": {"matrix_results": {"f": {"1__2": 0.2}}}}))
    truth = fixtures.read_truth(spark, str(tmp_path / "truth"))
    assert sorted((tuple(r) for r in truth.collect()), key=str) == [("x", "f", "1__2", 0.1, 0.2, True), ("x", "f", "1__3", 0.9, None, False)]
    write_json(cases, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_canvas(spark):
    cells = spark.createDataFrame([(0, 10, 20, 30, 40), (2, 10, 1390, 30, 40), (1, 0, 1400, 5, 5)], "page_idx int, x int, y int, width int, height int")
    found = sorted(tuple(r) for r in updates.on_canvas(cells, 0.5).select("page_idx", "x", "y", "width", "height").collect())
    assert found == [(0, 5, 10, 15, 20), (2, 1305, 695, 15, 5)]


def test_the_entry_bears_the_subpackages_absence_alone(tmp_path):
    root = Path(__file__).parent.parent
    for name in ("pagelattice", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 90)"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "pagelattice" / "llm", ignore_errors=True)
    assert run().stdout.split() == ["0", "True"]
    (tmp_path / "pagelattice" / "llm").mkdir()
    (tmp_path / "pagelattice" / "llm" / "__init__.py").write_text("")
    (tmp_path / "pagelattice" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    assert "no_such_module_anywhere" in run().stderr


def test_stream_and_entry(spark, tmp_path):
    from pagelattice.streaming.ingest import page_stream, run_stream

    page = '<nav><li><a href="/a">a</a></li><li><a href="/a">a</a></li></nav>'
    spark.createDataFrame([(1, "http://x.example.com/en/1", page)], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    run_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("cluster_key = 0").count() == 2

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert spark.range(1).select(F.lit(1)).count() == 1
