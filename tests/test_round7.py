"""Shuffle files, and the scans that features share."""

import glob

from pyspark.sql import functions as F

from txsieve.llm import common
from txsieve.operators import features, rolling, rows, scan
from txsieve.plans import fixture
from txsieve.schema import FEATURES, RANGES


def shuffle_files(spark):
    return glob.glob(f"{spark.sparkContext.getConf().get('spark.local.dir')}/**/shuffle_*.data", recursive=True)


def test_written_leaves_no_shuffle_files(spark):
    def run():
        return common.written(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count())

    before = set(shuffle_files(spark))
    table = run()
    assert not set(shuffle_files(spark)) - before
    assert table.agg(F.sum("count")).collect()[0][0] == 2000


def test_range_check_counts_before_rows_are_tall(spark):
    row = {f: max(RANGES[f][1], 0.0) + (0.5 if RANGES[f][3] else 0.0) for f in FEATURES}
    given = [row, row | {"fan_in_ratio": None}, row | {"fan_in_ratio": -1.0}, row | {"fan_in_ratio": float("nan")}]
    df = spark.createDataFrame([[r[f] for f in FEATURES] for r in given], ", ".join(f"`{f}` double" for f in FEATURES))
    check = features.range_check(df)
    got = {r.feature: (r.n_rows, r.n_null, r.n_out) for r in check.collect()}
    assert len(got) == len(FEATURES) and got.pop("fan_in_ratio") == (4, 1, 2)
    assert set(got.values()) == {(4, 0, 0)}
    assert features.range_check(df.limit(0)).count() == 0
    plan = check._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_parts_by_time_are_those_of_the_order(spark):
    given = [(t // 3 * 1000 if t % 5 else 40_000, f"t{t % 7}", f"e{t:04d}") for t in range(400)]
    df = spark.createDataFrame([*given, (None, "t", "e")], "ts_us long, txid string, event_id string")
    parts = scan.Parts(df.where("ts_us is not null"), 16)
    assert parts.last == max(r[0] for r in given)
    for late in (0, 1):
        x = df.select(parts.column(late).alias("got"), parts._searched(late).alias("want"))
        assert x.where("not got <=> want").count() == 0


def test_no_departures_after_the_last_row(spark):
    df = spark.createDataFrame([(i * 1000, f"t{i}", f"e{i}", "k") for i in range(50)], "ts_us long, txid string, event_id string, k string")
    parts = scan.Parts(df, 2)
    out = scan.trailing(df, "k", {"near": (10_000, F.lit(1), None), "far": (10**9, F.lit(1), None)}, parts)
    got = {r.event_id: (r.near, r.far) for r in out.collect()}
    assert got == {f"e{i}": (min(i, 10) + 1, i + 1) for i in range(50)}
    # the second span is longer than all the time there is: nothing passes its filter
    assert "<= -" in out._jdf.queryExecution().optimizedPlan().toString()


def test_network_scans_do_not_repeat_temporal_ones(spark):
    slim, parts = rolling.with_history(rows.with_row_features(rows.with_order(fixture.transactions(spark, "/root/testdata/sf0.001"))))
    df = rolling.with_temporal(slim, parts)
    plan = rolling.with_network(df, parts, slim)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_r__v24") <= df._jdf.queryExecution().optimizedPlan().toString().count("_r__v24")


def test_lineage_computes_rows_once(spark):
    tx = rows.with_order(fixture.transactions(spark, "/root/testdata/sf0.001"))
    plan = rolling.parents(tx)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    # outputs and their amounts are fields of the gathered lines: no lambda maps a row's lines
    outputs = tx.select("output_addresses", "output_amounts")
    assert "lambdafunction" not in outputs._jdf.queryExecution().optimizedPlan().toString()


def test_parents_of_both_lists(spark):
    data = [("e1", "t1", 10, ["a"], ["b", "b", ""]), ("e2", "t2", 20, ["x", "b"], ["x"]), ("e3", "t3", 20, ["x"], None), ("e4", "t4", 30, None, ["b"]), ("e5", "t5", 30, ["", "b"], [])]
    df = spark.createDataFrame(data, "event_id string, txid string, ts_us long, input_addresses array<string>, output_addresses array<string>")
    got = {(r.event_id, r.parent_id, r.parent_ts) for r in rolling.parents(df).collect()}
    assert got == {("e2", "e1", 10), ("e3", "e2", 20), ("e5", "e4", 30)}
