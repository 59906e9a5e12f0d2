"""Features, detectors, graph, scores and evaluation on hand-made transactions."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from txsieve.functions import scalars
from txsieve.operators import alerts, detectors, evaluation, features, forest, graph, graph_query, rolling, rows
from txsieve.operators.components import components
from txsieve.plans import analyze
from txsieve.schema import CANONICAL, FEATURES, registry

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def tx(k, t=0.0, ins=("a",), outs=("b",), amounts=None, ip="10.0.0.1", dst="10.0.0.2", txid=None, fee=0.0, asn="AS1", country="X", port=1000):
    amounts = [1.0] * len(outs) if amounts is None else list(amounts)
    when = T0 + timedelta(seconds=t)
    return (f"e{k:03}", txid or f"t{k:03}", when, ip, dst, port, 8333, list(ins), list(outs), [sum(amounts) / max(1, len(ins))] * len(ins), amounts, fee, "s", country, asn, "b", when)


def frame(spark, items):
    return spark.createDataFrame(items, CANONICAL)


def by_event(df):
    return {r.event_id: r for r in df.collect()}


def test_trailing_windows(spark):
    got = by_event(features.with_features(frame(spark, [tx(i, t, outs=(f"o{i}",), amounts=[i + 1.0]) for i, t in enumerate((0, 100, 200, 600))])))
    order = [got[f"e{i:03}"] for i in range(4)]
    assert [r.tx_count_5m for r in order] == [1, 2, 3, 1]
    assert [r.volume_5m for r in order] == [1, 3, 6, 4]
    assert order[3].tx_count_1h == 4 and order[3].volume_1h == 10
    assert [r.history_count for r in order] == [0, 1, 2, 3] and order[0].baseline_stability == 0
    assert order[3].median_interarrival == 100 and order[3].mean_interarrival == 200


def test_equal_times_and_edges_against_a_loop(spark):
    r = random.Random(3)
    items = [tx(i, r.choice((0, 0, 100, 300, 3600, 3700, 90000)), ins=(r.choice("ab"),), outs=(f"o{r.randrange(3)}",), ip=r.choice(("1.1.1.1", "2.2.2.2", "unknown_ip", "")), amounts=[float(r.randrange(1, 5))]) for i in range(60)]
    got = by_event(features.with_features(frame(spark, items)))
    done = []
    for it in sorted(items, key=lambda x: (x[2], x[1], x[0])):
        g, t, e, ip = got[it[0]], it[2].timestamp(), it[7][0], it[3]
        prior = [p for p in done if p[7][0] == e]
        near = lambda ps, w, t=t: [p for p in ps if t - p[2].timestamp() <= w]
        assert g.tx_count_1h == len(near(prior, 3600)) + 1 and g.tx_count_24h == len(near(prior, 86400)) + 1
        same = [p for p in done if p[3] == ip and ip not in ("unknown_ip", "")]
        assert g.ip_reuse_count == len(near(same, 3600)) and g.ip_reuse_count_24h == len(near(same, 86400))
        if ip not in ("unknown_ip", ""):
            assert g.unique_addresses_per_ip == len({p[7][0] for p in near(same, 3600)} | {e})
        else:
            assert g.unique_addresses_per_ip == 1 and g.endpoint_recurrence == 1
        assert g.unique_counterparties == len({a for p in [*prior, it] for a in p[8]})
        assert g.entity_tx_count == len(prior) + 1
        done.append(it)


def test_no_future_leakage(spark):
    items = [tx(i, 50.0 * i, ins=("a", "c"), outs=("b", "a")) for i in range(6)]
    few = by_event(features.feature_table(frame(spark, items[:3])))
    many = by_event(features.feature_table(frame(spark, items)))
    assert all(few[k] == many[k] for k in few)


def test_lineage(spark):
    items = [tx(0, 0, ins=("r",), outs=("h1",)), tx(1, 20, ins=("h1",), outs=("h2",)), tx(2, 40, ins=("h2",), outs=("h2",)), tx(3, 9999, ins=("z", "h2"), outs=())]
    got = by_event(rolling.with_lineage(rows.with_row_features(rows.with_order(frame(spark, items)))))
    assert [got[f"e{i:03}"].chain_parent for i in range(4)] == [None, "e000", "e001", "e002"]
    assert [got[f"e{i:03}"].chain_hops for i in range(4)] == [1, 2, 3, 4]
    short = rolling.parents(rows.with_order(frame(spark, items)), 3600)
    assert {r.event_id for r in short.collect()} == {"e001", "e002"}
    f = by_event(features.with_features(frame(spark, items[:2])))
    assert f["e001"].history_count == 1 and f["e001"].median_interarrival == 20
    assert by_event(detectors.with_scores(features.with_features(frame(spark, items[:2]))))["e001"].rapid_hop_triggered


def test_row_features_and_quality(spark):
    odd = list(tx(1, ins=(), outs=(), amounts=[]))
    odd[3] = odd[4] = odd[13] = odd[14] = None
    odd[7] = odd[8] = odd[9] = odd[10] = None
    got = by_event(rows.with_row_features(rows.with_order(frame(spark, [tx(0, ins=("a", "b"), outs=("b", "c"), amounts=[0.3, 0.7]), tuple(odd)]))))
    r = got["e000"]
    assert r.address_reuse_in_tx == 1 and r.is_peeling_structure == 1 and abs(r.output_concentration - 0.58) < 1e-9 and r.round_amount_ratio == 1
    assert got["e001"].entity == "unknown_entity" and got["e001"].output_count == 0 and got["e001"].amount_data_completeness == 0


def test_scores_stay_in_bounds(spark):
    names = sorted({f for items in detectors.EVIDENCE.values() for f, _, _ in items} | set(FEATURES))
    values = [0.0, 1.0, -3.0, 1e9, None, float("nan")]
    data = [(f"e{i}", f"t{i}", i, *[float(v) if v is not None else None for v in [values[(i + j) % 6] for j in range(len(names))]]) for i in range(6)]
    df = spark.createDataFrame(data, "event_id string, txid string, ts_us long, " + ", ".join(f"{n} double" for n in names))
    for r in detectors.with_scores(df).collect():
        for d in detectors.DETECTORS:
            assert 0 <= r[f"{d}_score"] <= 1


def test_network_alone_does_not_trigger(spark):
    got = by_event(detectors.with_scores(features.with_features(frame(spark, [tx(0)]))))
    assert got["e000"].asn_concentration == 1 and not got["e000"].network_cluster_triggered


def test_forest_finds_the_outlier_and_repeats(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(f"e{i}", r.gauss(0, 1), r.gauss(0, 1)) for i in range(400)] + [("far", 40.0, -40.0)], "event_id string, x1 double, x2 double")
    a = {x.event_id: x.isolation_forest_score for x in forest.anomaly_scores(df, ("x1", "x2"), trees=30).collect()}
    b = {x.event_id: x.isolation_forest_score for x in forest.anomaly_scores(df.repartition(7), ("x1", "x2"), trees=30).collect()}
    assert max(a, key=a.get) == "far" and a == b and all(0 <= v <= 1 for v in a.values())


def test_graph(spark):
    items = [tx(0, 0, ins=("a", "b"), outs=("c",)), tx(1, 100, ins=("a", "b"), outs=("d", "d")), tx(2, 600, ins=("b", " e "), outs=("f",), ip="none"), tx(3, 700, txid="t002", outs=("zz",)), tx(4, 5000, ins=("q",), outs=("r",), ip=None)]
    nodes, edges = graph.build(frame(spark, items))
    e = {r.edge_id: r for r in edges.collect()}
    assert e["OUTPUT_TO:t001->d"].amount == 2.0 and e["OUTPUT_TO:t001->d"].idx == 0
    assert e["CANDIDATE_SAME_ENTITY:a<->b"].support_count == 2 and abs(e["CANDIDATE_SAME_ENTITY:a<->b"].confidence - 0.7) < 1e-9
    assert "CANDIDATE_SAME_ENTITY:candidate_entity:a->e" in e
    links = [r for r in e.values() if r.edge_type == "TEMPORALLY_ASSOCIATED"]
    assert [(r.source_id, r.target_id, r.time_delta_seconds) for r in links] == [("t000", "t001", 100.0)]
    assert "zz" not in {r.node_id for r in nodes.collect()}
    assert {r.node_id: r.degree for r in graph_query.degrees(edges).collect()}["t000"] == 5
    near = {r.node_id: r.hop for r in graph_query.k_hop(edges, "t000", 2).collect()}
    assert near["a"] == 1 and near["t001"] == 1 and near["d"] == 2 and "t000" not in near
    assert {r.related_id for r in graph_query.related_entities(nodes, edges, "a").collect()} == {"b", "e", "candidate_entity:a"}
    assert graph_query.get_node(nodes, "X").first().node_id == "COUNTRY:X"
    ev = {r.txid: r for r in graph_query.graph_evidence(graph.cleaned(frame(spark, items)), nodes, edges).collect()}
    assert ev["t000"].common_input_support == 2 and ev["t000"].temporal_links == 1 and 0 < ev["t000"].graph_support_score <= 1
    assert ev["t004"].nodes_2hop == 3


def test_components_against_union_find(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in pairs if a != b for n in (a, b)}


def test_analysis_ranks_and_is_consistent(spark):
    items = [tx(i, 10.0 * i, ins=tuple(f"i{j}" for j in range(1 + i % 7)), outs=tuple(f"o{j}" for j in range(1 + i % 5))) for i in range(40)]
    res = analyze.analyze(frame(spark, items), analyze.Config(trees=10))
    ranked = sorted(res["alerts"].collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 41))
    keys = [(-r.priority_score, -r.risk_score, -r.confidence_score, r.txid) for r in ranked]
    assert keys == sorted(keys)
    for r in ranked:
        want = 0.45 * r.component_ml + 0.25 * r.component_graph + 0.20 * r.component_temporal + 0.10 * r.component_network
        assert abs(r.risk_score - want) < 1e-4 and 0 <= r.confidence_score <= 1
        assert r.alert_id == f"ALT_{r.txid}_{r['rank']:04}"
    few = alerts.top_k(res["alerts"], 3).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    with pytest.raises(ValueError):
        alerts.filter_tier(res["alerts"], "urgent")
    s = res["summary"].first()
    assert s.transactions == s.alerts == 40 and s.low + s.medium + s.high + s.critical == 40
    assert analyze.fingerprint(frame(spark, items)).first() == analyze.fingerprint(frame(spark, items[::-1])).first()


def test_empty_analysis(spark):
    res = analyze.analyze(frame(spark, []))
    assert res["alerts"].count() == 0 and res["summary"].first().transactions == 0


def test_areas_and_one_class(spark):
    df = spark.createDataFrame([("k", 0.9, True), ("k", 0.5, True), ("k", 0.5, False), ("k", 0.1, False), ("one", 0.3, True), ("one", 0.2, True)], "g string, s double, y boolean")
    got = {r.g: r for r in evaluation.areas(df, ["g"], "s", F.col("y")).collect()}
    assert got["k"].roc_auc == 0.875 and abs(got["k"].pr_auc - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-9
    assert got["one"].roc_auc is None and got["one"].pr_auc == 1.0


def test_registry():
    assert len(FEATURES) == 61


def test_registry_slots(spark):
    assert registry(spark).count() == 62
    assert spark.range(1).select(scalars.linear_scale(F.lit(None).cast("double"), 0, 1), scalars.clamp_01(F.lit(float("nan")))).first() == (0.0, 0.0)
