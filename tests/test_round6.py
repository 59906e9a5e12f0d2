"""What a run makes for a query, what passes through the driver, and how densities count."""

import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from txsieve.functions import session
from txsieve.functions.session import cut
from txsieve.operators import graph, graph_query
from txsieve.plans import analyze, feeds, queries
from txsieve.sources import validate
from txsieve.streaming import jobs

from .test_engine import frame, tx

SF = "/root/testdata/sf0.001"


def test_tables_of_some_size_are_not_broadcast_while_a_table_is_written(spark):
    """both sides are under Spark's own bound, so it would send one of them through the driver."""
    usual = spark.conf.get(session.BROADCAST)
    a = cut(spark.range(300_000).select("id", F.xxhash64("id").alias("x")))
    joined = a.join(a.select("id", F.col("x").alias("y")), "id")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    with session.writing(spark):
        plan = a.join(a.select("id", F.col("x").alias("y")), "id")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert spark.conf.get(session.BROADCAST) == usual


def test_tables_may_be_written_by_threads(spark):
    usual = [spark.conf.get(n, None) for n in (session.SWEEP, session.BROADCAST)]
    with ThreadPoolExecutor(4) as threads:
        made = list(threads.map(lambda n: cut(spark.range(n).repartition(2)).count(), range(1, 9)))
    assert made == list(range(1, 9)) and [spark.conf.get(n, None) for n in (session.SWEEP, session.BROADCAST)] == usual


def test_density_meets_targets_by_hash_and_counts_each_edge(spark):
    """Several edges between the same two nodes count each; lists are intersected, not searched one by one."""
    rows = [("e1", "t1", "a"), ("e2", "t1", "a"), ("e3", "t1", "b"), ("e4", "a", "b"), ("e5", "a", "b"), ("e6", "a", "b"), ("e7", "b", "c")]
    edges = cut(spark.createDataFrame([(*r, "K", None) for r in rows], "edge_id string, source_id string, target_id string, edge_type string, amount double"))
    density = graph_query.local_density(edges, spark.createDataFrame([("t1",)], "node_id string"))
    assert "array_intersect" in density._jdf.queryExecution().optimizedPlan().toString()
    # members t1, a, b: three edges of t1 and three of a lie among them
    assert density.first().local_density == 1.0


NEEDS = {
    "features": [], "detections": ["features"], "nodes": [], "edges": [], "graph_evidence": ["nodes", "edges"],
    "investigations": ["detections", "graph_evidence"], "alerts": ["investigations"], "metrics": list(analyze.STAGES),
}


@pytest.fixture(scope="module")
def empty_tables(spark):
    return analyze.analyze(frame(spark, []), queries.NO_FOREST)


def stand_in(run, table, needs):
    for name in needs:
        run[name]
    return table


@pytest.mark.parametrize(
    ("name", "needless"),
    [
        ("p_alert_kpis", {"alerts"}), ("p_risk_distribution", {"alerts"}), ("i_run_summary", {"alerts"}), ("i_run_metrics", {"alerts"}), ("p_node_risk", {"alerts"}),
        ("i_transaction_subgraph", {"features", "detections", "graph_evidence", "alerts"}), ("p_detector_hits", {"nodes", "edges", "graph_evidence", "investigations"}),
        ("p_facets", {"nodes", "edges", "graph_evidence", "investigations"}), ("p_entity_rollup", {"graph_evidence", "investigations", "alerts"}),
    ],
)
def test_queries_make_only_what_they_read(spark, empty_tables, monkeypatch, name, needless):
    """F9 to F19. Tables are stood in for, so that only the asking is seen."""
    empty, asked = frame(spark, []), set()

    class Asked(dict):
        def __contains__(self, key):
            asked.add(key)
            return dict.__contains__(self, key)

    for table in ("features", "detections", "graph_evidence", "investigations", "alerts", "nodes", "edges", "metrics"):
        monkeypatch.setattr(analyze.Run, f"_{table}", lambda self, table=table: stand_in(self, empty_tables[table], NEEDS[table]))
    run = analyze.Run(empty, queries.NO_FOREST)
    run.made = Asked()
    monkeypatch.setattr(queries, "analysis", lambda *_: run)
    queries.QUERIES[name](spark, SF)
    assert asked and not asked & needless, asked


def test_members_of_clusters_are_read_from_edges(spark):
    """as clusters() gives them, without a second run of components."""
    items = [tx(0, 0, ins=("a", "b")), tx(1, 9, ins=("b", "c")), tx(2, 20, ins=("x", "y")), tx(3, 30, ins=("z",))]
    t = cut(graph.cleaned(frame(spark, items)))
    edges = graph.build(frame(spark, items), tx=t)[1]
    assert sorted(graph.members(edges).collect()) == sorted(graph.clusters(t).collect()) != []


def test_outputs_before_an_input(spark):
    """as by looking at every output, those of the same instant too; 200,000 rows without a step for each."""
    made = [(t, f"t{x}", f"e{x * 7 % 10}", g) for t in (5, 5, 6, 9) for x in range(4) for g in (True, False)]
    rows, given, at, ids, times = jobs.latest_before(pd.DataFrame(made, columns=["ts_us", "txid", "event_id", "given"]))
    for r, n in zip(rows.itertuples(), at, strict=True):
        before = [(t, e) for t, x, e, g in made if g and (t, x, e) < (r.ts_us, r.txid, r.event_id)]
        assert r.given or (times[n], ids[n]) == (max(before) if before else (0, None))
    n = np.arange(200_000)
    many = pd.DataFrame({"ts_us": n // 4, "txid": [f"t{i:06}" for i in n], "event_id": n.astype(str), "given": n % 4 > 0})
    began = time.monotonic()
    jobs.latest_before(many)
    assert time.monotonic() - began < 10


def test_stream_finds_parents_of_the_same_instant(spark, tmp_path):
    """an output of the same microsecond counts if its txid comes before, in the batch or in the state."""
    first, second = [tx(0, 0, ins=("x",), outs=("a",))], [tx(1, 0, ins=("a",), outs=("b",)), tx(2, 0, ins=("b",), outs=("c",))]
    for n, items in enumerate((first, second)):
        frame(spark, items).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(frame(spark, first).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.txid, r.parent_id) for r in feeds.drained(jobs.lineage(source)).collect()}
    assert got == {("t001", first[0][0]), ("t002", second[0][0])}


def test_stream_batches_have_their_own_settings(spark):
    """tables of a batch's session are not broadcast either, and both sessions are set back."""
    other = spark.newSession()
    usual = [s.conf.get(session.BROADCAST) for s in (spark, other)]
    with session.writing(spark), session.writing(other):
        assert {int(s.conf.get(session.BROADCAST)) for s in (spark, other)} == {session.MOST_BROADCAST}
    assert [s.conf.get(session.BROADCAST) for s in (spark, other)] == usual


def test_a_filter_on_reasons_does_not_compute_texts_again(spark):
    """a text is computed at most twice in the filter (for its null check and its rule), not for each mention."""
    plan = feeds.QUERIES["val_quarantine"](spark, SF)._jdf.queryExecution().optimizedPlan()
    filters = [n.expressions().toString() for n in nodes(plan) if n.nodeName() == "Filter"]
    assert max(f.count("date_format") for f in filters) == 2


def test_events_without_id_are_named_by_their_txid(spark):
    """as before the change of the rule."""
    raw = spark.createDataFrame([(None, "t1"), (" ", "t2"), ("e3", None), (None, " ")], "event_id string, txid string")
    got = [(r.event_id, "event_id is missing" in r.reasons) for r in validate.canonicalize(raw).select("event_id", "reasons").collect()]
    assert got == [("evt_t1", False), ("evt_t2", False), ("e3", False), (None, True)]


def nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from nodes(below.apply(i))
