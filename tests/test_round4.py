"""Disk of components and graphs, evidence of asked nodes, what evaluation reads."""

import os
import random

import pyarrow as pa

from txsieve.functions.session import cut, drop, prepare
from txsieve.operators import evaluation, features, graph, graph_query
from txsieve.operators.components import components, forest
from txsieve.operators.scan import scan

from .test_engine import frame, tx


def folder(spark):
    return f"{prepare(spark).sparkContext.getCheckpointDir().removeprefix('file:')}/cut-{spark.sparkContext.applicationId}"


def test_forest_keeps_few_edges_and_all_components(spark):
    r = random.Random(1)
    pairs = [(a, b) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(4000)) if a < b]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])
    kept = sum(b.num_rows for b in forest([batch.slice(i, 500) for i in range(0, len(pairs), 500)]))
    assert kept < 300
    before = set(os.listdir(folder(spark))) if os.path.isdir(folder(spark)) else set()
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got) == {x for p in pairs for x in p} and all(got[a] == got[b] for a, b in pairs)
    # labels and the last, empty edges: tables of the rounds are gone
    assert len(set(os.listdir(folder(spark))) - before) <= 2


def test_cut_sweeps_what_it_shuffled_and_drop_deletes_its_own(spark, tmp_path):
    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    mine = cut(spark.range(1000).repartition(4, "id"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == held
    assert mine.count() == 1000
    path = os.path.dirname(mine.inputFiles()[0].removeprefix("file://"))
    spark.range(5).write.parquet(f"{tmp_path}/given")
    drop(mine, spark.read.parquet(f"{tmp_path}/given"))
    assert not os.path.exists(path) and os.path.exists(f"{tmp_path}/given")


def test_repeated_addresses_add_up_and_others_are_not_shuffled(spark):
    t = cut(graph.cleaned(frame(spark, [tx(0, 0, ins=("a", "b", "a"), outs=("c",)), tx(1, 1, ins=("d",), outs=("e", "e", "f"), amounts=[1.0, 2.0, 4.0])])))
    got = {r.edge_id: (r.amount, r.idx) for side in ("ins", "outs") for r in graph.address_edges(t, side).collect()}
    assert got["OUTPUT_TO:t001->e"] == (3.0, 0) and got["OUTPUT_TO:t001->f"] == (4.0, 2) and got["INPUT_TO:t000->b"][1] == 1 and len(got) == 6
    assert "Union" in graph.address_edges(t, "ins")._jdf.queryExecution().optimizedPlan().toString()


def test_counterparties_of_asked_nodes(spark):
    items = [tx(i, 10.0 * i, ins=("a", f"b{i % 3}"), outs=(f"c{i % 2}", "a")) for i in range(8)] + [tx(9, 99, ins=("z",), outs=("t000",))]
    t = cut(graph.cleaned(frame(spark, items)))
    nodes, edges = graph.build(frame(spark, items), tx=t)
    everyone = {r.node_id: r.unique_counterparties for r in graph_query.counterparties(nodes, edges).collect()}
    pairs = cut(graph_query.neighbours(edges))
    for ids in (["t001", "t009"], ["t000", "a", "c1"], ["10.0.0.1", "AS1"]):
        roots = nodes.where(nodes.node_id.isin(ids)).select("node_id")
        assert {r.node_id: r.unique_counterparties for r in graph_query.counterparties(nodes, edges, roots, pairs).collect()} == {i: everyone[i] for i in ids}
    plain = {r.node_id: r[1:] for r in graph_query.degrees(edges).collect()}
    assert {r.node_id: r[1:] for r in graph_query.degrees(edges, pairs).collect()} == plain


def test_scan_carries_are_merged(spark):
    df = spark.range(20).selectExpr("id as ts_us", "string(id) as txid", "string(id) as event_id", "id % 3 as k", "int(id div 7) as part")
    out = scan(df, ["k"], before={"last": "ts_us"})
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()


def test_row_features_are_not_written_before_the_join(spark):
    before = set(os.listdir(folder(spark))) if os.path.isdir(folder(spark)) else set()
    got = features.with_features(frame(spark, [tx(0, 0), tx(1, 5)]))
    assert got.columns[0] == "event_id" and got.count() == 2
    for name in set(os.listdir(folder(spark))) - before:
        assert "amount_cv" not in spark.read.parquet(f"{folder(spark)}/{name}").columns


def test_align_reads_txids_only_and_still_finds_leaks(spark):
    records = spark.createDataFrame([("t1", 0.5, "x"), ("t1", 0.1, "y"), ("t3", 0.2, "z")], "txid string, score double, scenario string")
    labels = spark.createDataFrame([("t1", True), ("t2", False)], "txid string, is_benign boolean")
    row = evaluation.align(records, labels)[1].first().asDict()
    assert row == {"records": 3, "labels": 2, "duplicate_records": 1, "duplicate_labels": 0, "missing_labels": 1, "extra_labels": 1, "aligned": 2, "leaked_columns": 1}
    assert not {"input_addresses", "burst_score"} & set(evaluation.READ)
