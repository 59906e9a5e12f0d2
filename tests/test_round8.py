"""Pairs of all inputs, and what evidence, detections and lookups move and make."""

import glob
from itertools import combinations

import pytest

from txsieve.functions.session import cut
from txsieve.operators import detectors, forest, graph, graph_query
from txsieve.plans import analyze, queries

from .test_engine import frame, tx
from .test_scale import shuffled

DENSITY_MOVES = 2_200_000


def test_all_inputs_are_paired(spark):
    """more than 20 inputs gave a star from the smallest; however they are dealt, all pairs count."""
    many, some, few = [f"a{i:03}" for i in range(150)], [f"a{i:03}" for i in range(140, 165)], ["a001", "a000", "a001"]
    t = graph.cleaned(frame(spark, [tx(i, 10.0 * i, ins=tuple(ins)) for i, ins in enumerate((many, some, few))]))
    want = {}
    for i, ins in enumerate((many, some, few)):
        for pair in combinations(sorted(set(ins)), 2):
            want.setdefault(pair, []).append(f"t{i:03}")
    for settings in ({}, {"clique": 2, "chunk": 7}, {"clique": 200}):
        got = {(r.a, r.b): r.supporting_txids for r in graph.common_input_pairs(t, **settings).collect()}
        assert got == want


def test_density_sends_lists_to_blocks(spark):
    """F1 to F16: 3,000 transactions, paid by 20 of a cluster's 80 addresses. Lists went to every root and member, and all members of
    roots were laid out with them to look for hubs among them, even if the only hub (the cluster) is not near a root."""
    made = [("T", f"t{i - d:04}", f"t{i:04}") for i in range(3000) for d in range(1, 6) if i >= d]
    made += [("I", f"t{i:04}", f"a{(i * 3 + k) % 20}") for i in range(3000) for k in range(5)] + [("C", "cluster", f"a{k}") for k in range(80)]
    made += [("P", f"a{k}", f"a{k + 1}") for k in range(19)]
    rows = [(f"{kind}:{a}->{b}", a, b, kind, None) for kind, a, b in made]
    edges = cut(spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, edge_type string, amount double"))
    roots = cut(spark.createDataFrame([(f"t{i:04}", 1000 * i) for i in range(3000)], "node_id string, ts_us long"))
    near = {f"t{i:04}": {f"t{i:04}"} for i in range(3000)}
    out = {}
    for _, a, b in made:
        out.setdefault(a, []).append(b)
        for x, y in ((a, b), (b, a)):
            if x in near:
                near[x].add(y)
    expected = {t: round(sum(b in m for a in m for b in out.get(a, ())) / (len(m) * (len(m) - 1)), 6) for t, m in near.items()}
    before = shuffled(spark)
    got = {r.node_id: r.local_density for r in graph_query.local_density(edges, roots).collect()}
    moved = shuffled(spark) - before
    assert got == expected
    assert moved < DENSITY_MOVES, moved


def test_surroundings(spark):
    """What a root's edges say of it; blocks hold at most what they should, in time, and lists stay short."""
    rows = [("e1", "t1", "a", "INPUT_TO", 2.0), ("e2", "t1", "a", "OUTPUT_TO", 3.0), ("e3", "t1", "b", "OUTPUT_TO", None), ("e4", "t1", "t2", "TEMPORALLY_ASSOCIATED", None), ("e5", "t2", "t2", "K", None)]
    edges = spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, edge_type string, amount double")
    roots = spark.createDataFrame([("t1", 1), ("t2", 2), ("t3", 3)], "node_id string, ts_us long")
    got = {r.node_id: (r.degree, r.weighted_degree, r.links, r.paid, r.n, sorted(r.members)) for r in graph_query.surroundings(edges, roots).collect()}
    assert got == {"t1": (4, 7.0, 1, 2, 4, ["a", "b", "t1", "t2"]), "t2": (2, 2.0, 1, 0, 2, ["t1", "t2"]), "t3": (0, 0.0, 0, 0, 1, ["t3"])}
    assert {r.node_id: (r.n, len(r.members)) for r in graph_query.surroundings(edges, roots, 2).collect()} == {"t1": (4, 2), "t2": (2, 2), "t3": (1, 1)}
    many = spark.range(1000).selectExpr("string(id) as node_id", "id as ts_us")
    blocks = graph_query.surroundings(edges, many, block=100).groupBy("block").count().collect()
    assert max(r["count"] for r in blocks) <= 100 and len(blocks) <= 14
    # each isolated node, and those with one or two near
    few = graph_query._few_nodes(edges, graph_query.surroundings(edges, roots))
    assert {r.node_id: r.nodes_2hop for r in few.collect()} == {"t1": 4, "t2": 4, "t3": 1}


def test_density_of_few_roots_moves_their_edges_only(spark, monkeypatch):
    """all edges were moved for the one transaction that is looked up."""
    rows = [(f"I:t{i}->a{(i + k) % 40}", f"t{i}", f"a{(i + k) % 40}", "INPUT_TO", 1.0) for i in range(2000) for k in range(3)] + [("P:a1->a2", "a1", "a2", "P", None)]
    edges = cut(spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, edge_type string, amount double"))
    root = spark.createDataFrame([("t1",)], "node_id string")
    before = shuffled(spark)
    got = graph_query.local_density(edges, root).collect()
    moved = shuffled(spark) - before
    monkeypatch.setattr(graph_query, "FEW", 0)
    before = shuffled(spark)
    assert graph_query.local_density(edges, root).collect() == got and got[0].local_density == round(4 / 12, 6)
    assert 10 * moved < shuffled(spark) - before


@pytest.fixture(scope="module")
def run(spark):
    made = analyze.Run(frame(spark, [tx(i, 10.0 * i, ins=tuple(f"i{j}" for j in range(1 + i % 7)), outs=tuple(f"o{j}" for j in range(1 + i % 5))) for i in range(40)]), queries.NO_FOREST)
    made["fired"]
    return made


def test_a_run_keeps_only_its_tables(spark, run):
    """What tables were made from on the way stayed on the disk until the end."""
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    other = analyze.Run(run.given, queries.NO_FOREST)
    assert other["features"].count() == 40 and other["edges"].count() > 40
    new = {f.rpartition("/")[2] for f in set(glob.glob(f"{folder}/*")) - before}
    assert new == {f.split("/")[-2] for n in ("transactions", "cleaned", "features", "nodes", "edges") for f in other.made[n].inputFiles()}


def test_fired_writes_no_records(run):
    """F17, F18, F21"""
    assert "detections" not in run.made and run["fired"].count() == 40
    want = {r.event_id: r.triggers for r in run["fired"].collect()}
    records = detectors.detection_records(run["features"])
    assert want == {r.event_id: sorted(d for d in detectors.SCORED if r[f"{d}_score"] >= 0.5) for r in records.collect()}


def test_rollup_needs_no_links(run, monkeypatch):
    """links in time and nodes were made, which it does not read."""
    monkeypatch.setattr(queries, "analysis", lambda *_: run)
    lean = queries.p_entity_rollup(None, "").collect()
    assert lean and "edges" not in run.made
    run["edges"]
    assert queries.p_entity_rollup(None, "").collect() == lean


def test_detector_results_without_texts(run):
    """texts and maps were made for rows that show neither."""
    full, lean = (detectors.detector_results(run["features"], texts=t) for t in (True, False))
    assert "printf" in full._jdf.queryExecution().optimizedPlan().toString().lower() or "format_string" in full._jdf.queryExecution().optimizedPlan().toString()
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and "map(" not in plan
    assert sorted(full.select(lean.columns).collect()) == sorted(lean.collect())


def test_forest_writes_no_second_table(spark, monkeypatch):
    """the matrix of all rows was written beside the features; and few rows pass for a tree."""
    df = cut(spark.range(5000).selectExpr("string(id) as event_id", "double(id % 97) as x1", "double(id % 89) as x2"))
    tables = []
    monkeypatch.setattr(forest, "cut", lambda df: tables.append(df.columns) or cut(df))
    got = {r.event_id: r.isolation_forest_score for r in forest.anomaly_scores(df, ("x1", "x2"), trees=5).collect()}
    assert len(got) == 5000 and all("x" not in c for c in tables)
    monkeypatch.setattr(forest, "TREES", 0)  # without leaving rows out beforehand
    assert got == {r.event_id: r.isolation_forest_score for r in forest.anomaly_scores(df, ("x1", "x2"), trees=5).collect()}
