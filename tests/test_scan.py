"""Two-level scans, indexed windows, exactly-once sinks and whole quarantined rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsieve.operators import features, graph, graph_query, rolling, rows, scan
from txsieve.sources import validate
from txsieve.streaming import jobs

from .test_engine import T0, by_event, frame, tx
from .test_sources import GOOD, HEAD


def test_sorted_window_against_numpy():
    r = random.Random(4)
    for size in (1, 2, 7, 200):
        window, kept = scan.Sorted(size), []
        for _ in range(500):
            x = float(r.choice([r.randrange(5), r.random(), -r.random() * 10]))
            gone = window.add(x)
            kept.append(x)
            assert gone == (kept.pop(0) if len(kept) > size else 0)
            middle = window.median()
            assert middle == np.median(kept)
            assert np.isclose(window.deviation(middle), np.median(np.abs(np.array(kept) - middle)), rtol=0, atol=1e-12)


def test_histories_over_blocks(spark):
    r = random.Random(6)
    items = [(f"e{k}-{i}", k, i + 1, None if i == 0 else r.randrange(1000), float(r.randrange(50))) for k, n in (("a", 900), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(items, "event_id string, key string, k long, gap_us long, amount double")
    got = {x.event_id: x for x in scan.histories(df, "key", gaps=10, amounts=20, block=25).collect()}
    assert len(got) == len(items)
    for k in "abc":
        own = [x for x in items if x[1] == k]
        for i, x in enumerate(own):
            g, gaps, prior = got[x[0]], [y[3] for y in own[max(0, i - 9) : i + 1] if y[3] is not None], [y[4] for y in own[max(0, i - 20) : i]]
            assert (g.gap_median is None) == (not gaps) and (not gaps or abs(g.gap_median - np.median(gaps) / 1e6) < 1e-12 and abs(g.gap_mean - np.mean(gaps) / 1e6) < 1e-12)
            assert g.amount_median == (np.median(prior) if prior else None)
            assert g.amount_mad == (np.median(np.abs(np.array(prior) - np.median(prior))) if len(prior) > 1 else None)


def test_a_hot_key_spreads_over_parts(spark):
    """One address on half of all rows, many of them at one instant: no task has more than a fair share of them."""
    df = spark.range(4000).select(
        F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("txid"),
        F.when(F.col("id") < 1500, 0).otherwise(F.col("id") * 1_000_000).cast("long").alias("ts_us"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ip"),
    )
    parts = scan.Parts(df, 16)
    dealt = df.withColumn("part", parts.column())
    most = dealt.groupBy("ip", "part").count().agg(F.max("count")).first()[0]
    assert parts.count == 16 and most <= 2 * 4000 / 2 / 16 * 2
    got = scan.scan(dealt, ["ip"], {"k": F.lit(1)}, before={"last": "event_id"}, after={"next": "event_id"}).where("ip = 'hot'").collect()
    order = sorted(got, key=lambda x: (x.ts_us, x.txid, x.event_id))
    assert [x.k for x in order] == list(range(1, 2001))
    assert [x.last for x in order] == [None, *[x.event_id for x in order[:-1]]] and [x.next for x in order] == [*[x.event_id for x in order[1:]], None]
    near = {x.event_id: x.n for x in scan.trailing(df, "ip", {"n": (100_000_000, F.lit(1), None)}, parts).collect()}
    for i, x in enumerate(order):
        assert near[x.event_id] == sum(x.ts_us - y.ts_us <= 100_000_000 for y in order[: i + 1][-1700:])
    plan = scan.scan(dealt, ["ip"], {"k": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ip" in plan and "Window" in plan


def test_features_do_not_depend_on_the_parts(spark, monkeypatch):
    r = random.Random(8)
    items = [tx(i, 30.0 * r.randrange(200), ins=(r.choice("ab"),), outs=(f"o{r.randrange(4)}",), amounts=[r.random()], ip=r.choice(("1.1.1.1", "2.2.2.2"))) for i in range(80)]
    one = by_event(features.feature_table(frame(spark, items)))
    monkeypatch.setattr(scan.Parts.__init__, "__defaults__", (23,))
    assert by_event(features.feature_table(frame(spark, items))) == one


def test_links_of_a_busy_address(spark):
    """Links over time buckets against a loop; one IP on all rows."""
    r = random.Random(3)
    items = [tx(i, float(r.randrange(0, 3000, 10)), ins=(r.choice("abc"),), outs=(r.choice("cde"),), ip="9.9.9.9" if i % 3 else None) for i in range(120)]
    got = {(x.txid, x.past_txid): x for x in graph.temporal_links(graph.cleaned(frame(spark, items))).collect()}
    done, want = [], set()
    for it in sorted(items, key=lambda x: (x[2], x[1], x[0])):
        near = [p for p in done if (it[2] - p[2]).total_seconds() <= 300 and ({*p[7], *p[8]} & {*it[7], *it[8]} or p[3] and p[3] == it[3])]
        want |= {(it[1], p[1]) for p in near[-5:]}
        done.append(it)
    assert set(got) == want and T0 is not None
    by = {it[1]: it for it in items}
    for (a, b), x in got.items():
        assert x.shared_addresses == sorted({*by[a][7], *by[a][8]} & {*by[b][7], *by[b][8]}) and x.shared_ips == (["9.9.9.9"] if by[a][3] and by[a][3] == by[b][3] else [])


def test_a_batch_run_twice_gives_one_copy(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\n".join([HEAD, GOOD, GOOD.replace("0.001", "-1")]) + "\n")
    raw = spark.readStream.schema(validate.RAW_SCHEMA).option("header", True).csv(str(tmp_path / "in"))
    good, bad, log = (str(tmp_path / x) for x in ("good", "bad", "log"))
    jobs.ingest_stream(raw, "b", good, bad, log).awaitTermination(120)
    for f in (".0.crc", "0"):
        if os.path.exists(f"{log}/commits/{f}"):
            os.remove(f"{log}/commits/{f}")  # as if the driver had gone before the batch was noted
    spark.createDataFrame([("x",)], "event_id string").write.parquet(f"{good}/batch=7")  # a batch without a marker
    jobs.ingest_stream(raw, "b", good, bad, log).awaitTermination(120)
    assert jobs.committed(spark, good) == [f"{good}/batch=0"]
    assert spark.read.parquet(*jobs.committed(spark, good)).count() == 1 and spark.read.json(*jobs.committed(spark, bad, good)).count() == 1
    assert jobs.committed(spark, str(tmp_path / "none")) == []


def test_quarantine_keeps_whole_rows(spark):
    raw = spark.createDataFrame([("e", "", "x" * 5000)], "event_id string, txid string, script_type string")
    bad = validate.quarantined(validate.canonicalize(raw)).collect()
    assert len(bad) == 1 and "x" * 5000 in bad[0].raw_data


def test_lineage_helpers(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("z", "y")], "event_id string, parent_id string")
    assert {(x.event_id, x.root, x.steps) for x in rolling.chains(links).collect()} == {("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("z", "y", 1)}
    assert rows.with_order(frame(spark, [tx(0)])).count() == 1


def test_heavy_transactions_are_not_paired(spark):
    """A transaction of 10,000 addresses, heavy ones that overlap, and light ones, against sets."""
    r = random.Random(12)
    of = {"big": {f"b{i}" for i in range(10_000)}, "h1": {f"a{i}" for i in range(100)}, "h2": {f"a{i}" for i in range(50, 150)} | {"b1"}}
    of |= {f"l{i}": {f"a{r.randrange(200)}" for _ in range(r.randrange(1, 6))} | ({f"b{r.randrange(5)}"} if i % 7 == 0 else set()) for i in range(150)}
    others = {}
    for members in of.values():
        for a in members:
            others.setdefault(a, set()).update(members)
    money = spark.createDataFrame([(t, a) for t, m in of.items() for a in m], "txid string, address string")
    got = {x.node_id: x.n for x in graph_query.co_addresses(money).collect()}
    assert {a: got.get(a, 0) for a in others} == {a: len(o) - 1 for a, o in others.items()}


def test_subgraph_of_a_transaction(spark):
    nodes, edges = graph.build(frame(spark, [tx(i, 10.0 * i, ins=("a", "b"), outs=(f"o{i}",)) for i in range(4)]))
    evidence = spark.createDataFrame([("t001", 0.5), ("t002", 0.1)], "txid string, graph_support_score double")
    near, inside, found = graph_query.transaction_subgraph(nodes, edges, evidence, "t001", 1)
    ids, kept = [x.node_id for x in near.collect()], [x.edge_id for x in inside.collect()]
    assert ids == sorted(ids) and kept == sorted(kept) and {"t001", "a", "b", "o1", "t000"} <= set(ids) and "o3" not in ids
    assert [x.txid for x in found.collect()] == ["t001"]
    with pytest.raises(ValueError, match="hops"):
        graph_query.transaction_subgraph(nodes, edges, evidence, "t001", 6)
