"""What jobs move and how deep their plans are: neither may grow faster than the input."""

import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from txsieve.functions.session import cut, prepare
from txsieve.operators import features, graph, graph_query, rolling
from txsieve.plans import fixture
from txsieve.streaming import jobs

SF = "/root/testdata/sf0.001"
LINKS_MOVE, SCANS, DENSITY_MOVES = 2_000_000, 100, 1_000_000


def shuffled(spark) -> int:
    """Bytes that the session's stages have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_temporal_links_move_numbers_once(spark):
    """4,000 transactions in 40 seconds that share 40 addresses and 4 IPs: every key has five rows to look back to."""
    n = F.col("id")
    ends = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.concat(F.lit("a"), ((n * 7 + i * 3) % 40).cast("string")).alias("a"), F.lit(1.0).alias("v")))
    tx = spark.range(4000).select((n * 10_000).alias("ts_us"), F.format_string("tx_%08d", n).alias("txid"), n.cast("string").alias("event_id"), ends.alias("ins"), F.slice(ends, 1, 0).alias("outs"), F.concat(F.lit("10.0.0."), (n % 4).cast("string")).alias("ip"))
    tx = cut(tx)
    before = shuffled(spark)
    links = cut(graph.temporal_links(tx))
    moved = shuffled(spark) - before
    assert links.count() == sum(min(5, i) if i > 40 else 0 for i in range(4000)) + links.where("ts_us <= 400000").count()
    assert links.where("size(shared_addresses) + size(shared_ips) = 0").isEmpty()
    assert moved < LINKS_MOVE, moved


def test_scans_do_not_multiply_the_plan(spark):
    df = fixture.transactions(prepare(spark), SF)
    plan = features.with_features(df)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") < SCANS, plan.count("FileScan")


def test_links_are_followed_across_ranges(spark):
    """A chain of 5,000 rows, a fork in it and a pair: roots and steps hold however the ranges cut it."""
    rows = [(f"e{i}", f"e{i - 1}", i - 1) for i in range(1, 5000)] + [("f1", "e10", 10), ("f2", "f1", 11), ("y", "x", 3)]
    links = spark.createDataFrame(rows, "event_id string, parent_id string, parent_ts long")
    expected = {(f"e{i}", "e0", i) for i in range(1, 5000)} | {("f1", "e0", 11), ("f2", "e0", 12), ("y", "x", 1)}
    near = rolling._followed(links, 700)
    assert near.select("up").distinct().count() <= 20
    assert {tuple(r) for r in rolling.chains(links).collect()} == expected
    far = rolling._jumped(cut(near), 64)
    assert far.where("event_id = 'e4999' and root = 'e0' and steps = 4999").count() == 1


def test_density_lays_out_no_wedges(spark):
    """500 transactions with links to the eight before and five of 20 addresses, paired in a hub: as by brute force."""
    made = [("T", f"t{i - d}", f"t{i}") for i in range(500) for d in range(1, 9) if i >= d]
    made += [(kind, f"t{i}", f"a{(i * 3 + k) % 20}") for i in range(500) for k in range(5) for kind in ("I", "O") if kind == "I" or k < 2]
    made += [("P", "a0", f"a{k}") for k in range(1, 20)]
    rows = [(f"{kind}:{a}->{b}", a, b, kind, None) for kind, a, b in made]
    edges = cut(spark.createDataFrame(rows, "edge_id string, source_id string, target_id string, edge_type string, amount double"))
    roots = cut(spark.createDataFrame([(f"t{i}",) for i in range(500)], "node_id string"))
    near = {f"t{i}": {f"t{i}"} for i in range(500)}
    for _, a, b in made:
        for x, y in ((a, b), (b, a)):
            if x in near:
                near[x].add(y)
    expected = {t: round(sum(a in m and b in m for _, a, b in made) / (len(m) * (len(m) - 1)), 6) for t, m in near.items()}
    before = shuffled(spark)
    got = {r.node_id: r.local_density for r in graph_query.local_density(edges, roots).collect()}
    moved = shuffled(spark) - before
    assert got == expected
    assert moved < DENSITY_MOVES, moved
    for light in (1, 9, 18, 21):
        assert {r.node_id: r.local_density for r in graph_query.local_density(edges, roots, light).collect()} == expected


class Held(dict):
    """A map or value state in memory."""

    exists = lambda self: "v" in self
    get = lambda self, *a: dict.get(self, *a) if a else self["v"]
    update = lambda self, v: self.__setitem__("v", v)
    iterator = lambda self: iter(list(self.items()))
    getValue, removeKey, updateValue = dict.__getitem__, dict.__delitem__, dict.__setitem__


def test_rolling_state_of_a_dense_key():
    """20,000 rows in one bucket, then rows between them, as by brute force; a row's work does not grow with its bucket."""

    def emit(within, n):
        return float(within(jobs.H1)[0] - 1), round(within(jobs.D1)[1], 3)

    state = jobs.Rolling(600_000_000, emit, ["event_id", "txid", "ts_us", "ip", "n", "amount", "later_rows", "late"])
    state.totals, state.rows, state.life, state.handle = Held(), Held(), Held(), SimpleNamespace(registerTimer=lambda _: None, deleteTimer=lambda _: None)
    timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    batch = lambda times: pd.DataFrame({"event_id": [str(t) for t in times], "txid": [str(t) for t in times], "ts_us": times, "amount": [1.5] * len(times)})
    start = 7200 * 1_000_000
    first = [start + 10_000 * i for i in range(20_000)]
    began = time.monotonic()
    list(state.handleInputRows(("k",), iter([batch(first)]), timer))
    second = [start + 10_000 * i + 5 for i in range(0, 20_000, 500)] + [start + 400_000_000 + i for i in range(5)]
    got = pd.concat(list(state.handleInputRows(("k",), iter([batch(second)]), timer)))
    took = time.monotonic() - began
    seen = list(first)
    for r, t in zip(got.itertuples(index=False), second, strict=True):
        seen.append(t)
        upto = sum(x <= t for x in seen)
        assert (r.n, r.amount, r.later_rows) == (upto - 1, upto * 1.5, len(seen) - upto)
    assert took < 8, took
