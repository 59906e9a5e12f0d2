"""Window, cumulative and lineage features.

All windows follow one total order, (ts_us, txid, event_id). Trailing windows include their far edge and
the row itself, but not later rows of the same instant. Sums over keys are two-level scans, so no task holds a key.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.scalars import usable_ip
from txsieve.functions.session import cut, prepare

from .scan import ORDER, Parts, gathered, histories, scan, trailing

MIN5, HOUR, DAY = 300_000_000, 3_600_000_000, 86_400_000_000


def near_parent() -> Column:
    return F.col("chain_parent").isNotNull() & (F.col("chain_interval") <= 300)


def parents(df: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """(event_id, parent_id, parent_ts): the latest earlier spender of the first input that has one.

    An as-of join without a range join: outputs and inputs are put in one order per address, and each input
    takes the last output before it. A transaction's own outputs come after its inputs.
    """
    key = F.struct(*ORDER)
    # both lists of a row in one pass: a union would compute the rows twice
    side = lambda given, addresses: F.struct(F.lit(given).alias("given"), F.col(addresses).alias("addresses"))
    sides = df.select(*ORDER, F.explode(F.array(side(1, "output_addresses"), side(0, "input_addresses"))).alias("side"))
    both = sides.select(*ORDER, "side.given", F.posexplode("side.addresses").alias("pos", "address")).where(F.coalesce("address", F.lit("")) != "")
    before = Window.partitionBy("address").orderBy(*ORDER, "given").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("p", F.last(F.when(F.col("given") == 1, key), ignorenulls=True).over(before)).where(
        "given = 0 and p is not null"
    )
    if ttl_seconds is not None:
        found = found.where(F.col("ts_us") - F.col("p.ts_us") <= ttl_seconds * 1e6)
    return found.groupBy("event_id").agg(F.min_by("p", "pos").alias("p")).select(
        "event_id", F.col("p.event_id").alias("parent_id"), F.col("p.ts_us").alias("parent_ts")
    )


def chains(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(event_id, root, steps) of rows with a parent: the last row that the links lead to, and how many they are.

    Links that have a time (parent_ts) are first followed inside ranges of it, which leaves few rows to be led to.
    These go by pointer jumping: the number of joins is the logarithm of the longest chain of them.
    """
    if "parent_ts" not in links.columns:
        return _jumped(links.select("event_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps")), max_rounds)
    near = cut(_followed(links))
    ends = near.select(F.col("up").alias("event_id")).distinct()
    far = _jumped(cut(near.join(ends, "event_id", "left_semi")), max_rounds)
    far = far.select(F.col("event_id").alias("up"), F.col("root").alias("far"), F.col("steps").alias("more"))
    return near.join(far, "up", "left").select("event_id", F.coalesce("far", "up").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))


def _followed(links: DataFrame, rows: int = 200_000) -> DataFrame:
    """(event_id, up, steps): links followed as far as they stay in one of the ranges of parent_ts, of about ``rows`` rows each."""
    prepare(links.sparkSession)
    dealt = links.select("event_id", "parent_id", "parent_ts").repartitionByRange(max(2, links.count() // rows + 1), "parent_ts", "event_id").select("event_id", "parent_id")

    def run(batches):
        up: dict[str, tuple[str, int]] = {}
        for b in batches:
            up.update((e, (p, 1)) for e, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        done: set[str] = set()
        for event in up:
            path, at = [], event
            while at in up and at not in done:
                path.append(at)
                done.add(at)
                at = up[at][0]
            # what is next is settled, or not of this range
            end, steps = up.get(at, (at, 0))
            for e in reversed(path):
                steps += 1
                up[e] = (end, steps)
        names = list(up)
        for i in range(0, len(names), 10_000):
            some = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([up[e][0] for e in some], pa.string()), pa.array([up[e][1] for e in some], pa.int64())], names=["event_id", "up", "steps"])

    return dealt.mapInArrow(run, "event_id string, up string, steps long")


def _jumped(at: DataFrame, max_rounds: int) -> DataFrame:
    for _ in range(max_rounds):
        at = cut(at)
        over = at.select(F.col("event_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"))
        nxt = at.join(over, "up", "left")
        if nxt.where("up2 is not null").isEmpty():
            return at.select("event_id", F.col("up").alias("root"), "steps")
        at = nxt.select(
            "event_id",
            F.coalesce("up2", F.when(F.col("more").isNull(), F.col("up"))).alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        )
    raise RuntimeError("parent links form a cycle")


def chain_hops(links: DataFrame) -> DataFrame:
    """(event_id, hops) for rows with a parent: 1 + the parent's hops, where roots have 1."""
    return chains(links).select("event_id", (F.col("steps") + 1).alias("hops"))


def with_lineage(df: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """chain_parent, chain_interval (seconds), chain_hops (1 without a parent)."""
    links = cut(parents(df, ttl_seconds))
    hops = chain_hops(links)
    return (
        df.join(links, "event_id", "left")
        .join(hops, "event_id", "left")
        .withColumns(
            {
                "chain_parent": F.col("parent_id"),
                "chain_interval": F.when(F.col("parent_id").isNotNull(), (F.col("ts_us") - F.col("parent_ts")) / 1e6),
                "chain_hops": F.coalesce("hops", F.lit(1).cast("long")),
            }
        )
        .drop("parent_id", "parent_ts", "hops")
    )


def entity_history(df: DataFrame) -> DataFrame:
    """event_id, k, first_ts, new counts and sums, gaps and order statistics: all that follows an entity's rows in order.

    ``df``: slim rows with lineage and ``part``.
    """
    amount, ones = F.col("raw_out"), F.lit(1)
    rows = df.select(*ORDER, "part", "entity", "raw_out", "src_ip", "asn", "geo_country", "output_addresses", (near_parent() & (F.col("chain_hops") > 1)).alias("near"), "chain_hops")
    # first occurrences of a value in an entity: the rows of (entity, kind, value), counted in one scan for all kinds
    value = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    kinds = {"asn": F.coalesce("asn", F.lit("unknown_asn")), "cc": F.coalesce("geo_country", F.lit("unknown")), "ip": F.coalesce("src_ip", F.lit("unknown_ip"))}
    given = F.transform(F.filter(F.array_distinct(F.coalesce("output_addresses", F.array().cast("array<string>"))), lambda a: a != ""), lambda a: value("address", a))
    tall = rows.select(*ORDER, "part", "entity", F.explode(F.concat(F.array(*[value(k, v) for k, v in kinds.items()]), given)).alias("of")).select(*ORDER, "part", "entity", "of.*")
    seen, new = scan(tall, ["entity", "kind", "v"], {"n": ones}), F.col("n") == 1
    news = seen.groupBy("event_id").agg(
        *[F.count_if(new & (F.col("kind") == k)).alias(f"new_{k}") for k in kinds], F.count_if(new & (F.col("kind") == "address")).alias("new_address"),
        F.max(F.when(F.col("kind") == "asn", F.col("n"))).alias("n_asn"),
    )
    rows = cut(rows.select(*ORDER, "part", "entity", "raw_out", "near", "chain_hops").join(news, "event_id"))
    up = scan(
        rows, ["entity"],
        {
            "k": ones, "entity_sum": amount, "asns": F.col("new_asn"), "countries": F.col("new_cc"), "ips": F.col("new_ip"),
            "addresses": F.col("new_address"), "squares": 2 * F.col("n_asn") - 1,
        },
        before={"last_ts": "ts_us"},
        # what the first row of an entity says, carried on: its time, and the hops that it inherits
        first={"first_ts": F.col("ts_us"), "inherited": F.when(F.col("near"), F.col("chain_hops") - 1).otherwise(0)},
    )
    up = cut(up.select("event_id", "ts_us", "entity", "raw_out", "k", "entity_sum", "asns", "countries", "ips", "addresses", "squares", "first_ts", "inherited", (F.col("ts_us") - F.col("last_ts")).alias("gap_us")))
    statistics = histories(up.withColumn("amount", F.col("raw_out")), "entity")
    return gathered([up.drop("ts_us", "entity", "raw_out", "gap_us"), statistics])


def with_history(df: DataFrame, lineage_ttl_seconds: float | None = None) -> tuple[DataFrame, Parts]:
    """Slim rows with lineage, part and entity_history, and the cuts of the order.

    They are written: each scan reads its rows twice, and several scans follow.
    """
    df = cut(df.select("event_id", "txid", "ts_us", "entity", "raw_out", "src_ip", "dst_ip", "src_port", "dst_port", "asn", "geo_country", "input_addresses", "output_addresses"))
    parts = Parts(df)
    slim = cut(with_lineage(df, lineage_ttl_seconds).withColumn("part", parts.column()))
    return cut(slim.drop("input_addresses", "output_addresses").join(entity_history(slim), "event_id")), parts


def with_temporal(df: DataFrame, parts: Parts) -> DataFrame:
    """Trailing counts and volumes, gaps between transactions, burst and velocity, history.

    ``df``: rows with lineage and entity_history. Volumes are summed as decimals of eight digits, so what has left a window
    leaves no rounding behind.
    """
    amount, one = F.col("raw_out").cast("decimal(30, 8)"), F.lit(1)
    spans = {"_n5": (MIN5, one, None), "_n1": (HOUR, one, None), "_n24": (DAY, one, None), "_v5": (MIN5, amount, None), "_v1": (HOUR, amount, None), "_v24": (DAY, amount, None)}
    df = df.join(trailing(df, "entity", spans, parts), "event_id")
    near = near_parent()
    chain = F.when(F.col("chain_interval") > 0, F.col("chain_interval")).otherwise(0.0)
    n5 = F.when(near, F.greatest(F.col("_n5"), F.col("chain_hops"))).otherwise(F.col("_n5")).cast("double")
    n1 = F.col("_n1").cast("double")
    v5, v1, v24 = (F.greatest(F.col(v).cast("double"), F.lit(0.0)) for v in ("_v5", "_v1", "_v24"))
    history = (F.col("k") - 1 + F.col("inherited")).cast("double")
    return df.withColumns(
        {
            "tx_count_5m": n5, "tx_count_1h": n1, "tx_count_24h": F.col("_n24").cast("double"),
            "volume_5m": F.round(v5, 8), "volume_1h": F.round(v1, 8), "volume_24h": F.round(v24, 8),
            "mean_interarrival": F.round(F.coalesce("gap_mean", chain, F.lit(0.0)), 2),
            "median_interarrival": F.round(F.coalesce("gap_median", chain, F.lit(0.0)), 2),
            "burst_score": F.round(F.when(n1 > 1, 12 * n5 / n1).when(near & (n5 >= 2), 2 * n5).otherwise(1.0), 4),
            "velocity_ratio": F.when(v1 > 1e-12, 12 * v5 / v1).otherwise(1.0),
            "history_count": history,
            "baseline_stability": F.round(F.least(F.lit(1.0), history / 15), 4),
        }
    ).drop(*spans)


def by_address(df: DataFrame, parts: Parts) -> DataFrame:
    """(event_id, ...): rows and distinct entities of the same IP within an hour and a day, up to each row.

    An entity counts until it comes again or its time is up.
    """
    rows = df.select(*ORDER, "part", "entity", usable_ip(F.col("src_ip")).alias("ip")).where("ip is not null")
    rows = cut(scan(rows, ["ip", "entity"], before={"last": "ts_us"}, after={"next": "ts_us"}).select(*ORDER, "ip", "last", "next"))
    spans, one = {}, F.lit(1)
    for n, span in (("1", HOUR), ("24", DAY)):
        spans[f"_i{n}"] = (span, one, None)
        comes = F.when(F.col("ts_us") - F.col("last") <= span, 0).otherwise(1)
        goes = F.when(F.col("next") - F.col("ts_us") <= span, 0).otherwise(1)
        spans[f"_u{n}"] = (span, comes, goes)
    return trailing(rows, "ip", spans, parts)


def with_network(df: DataFrame, parts: Parts, rows: DataFrame | None = None) -> DataFrame:
    """Reuse of addresses and endpoints, distinct entities behind an IP, lifetime counts.

    ``df``: rows with ``part`` and entity_history; ``rows``: the same rows as they are written, which the scans read,
    so that what ``df`` adds to them is not computed for each scan.
    """
    rows = df if rows is None else rows
    ip, other, one = usable_ip(F.col("src_ip")), usable_ip(F.col("dst_ip")), F.lit(1)
    pairs = rows.select(*ORDER, F.when(ip.isNotNull() & other.isNotNull(), F.concat_ws("|", ip, other)).alias("pair"))
    found = [by_address(rows, parts), trailing(pairs, "pair", {"_e1": (HOUR, one, None), "_e24": (DAY, one, None)}, parts)]
    lifetime = {"country_count": F.coalesce("geo_country", F.lit("unknown")), "src_port_frequency": F.coalesce("src_port", F.lit(0)), "dst_port_frequency": F.coalesce("dst_port", F.lit(0))}
    tall = rows.select(*ORDER, "part", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.cast("string").alias("v")) for n, v in lifetime.items()])).alias("of")).select(*ORDER, "part", "of.*")
    counted = scan(tall, ["kind", "v"], {"n": one})
    found.append(counted.select("event_id", *[F.when(F.col("kind") == n, F.col("n")).alias(n) for n in lifetime]))
    df = df.join(gathered(found), "event_id", "left")
    number = lambda c, otherwise: F.coalesce(F.col(c).cast("double"), F.lit(otherwise))
    return df.withColumns(
        {
            "ip_reuse_count": number("_i1", 1.0) - 1, "ip_reuse_count_24h": number("_i24", 1.0) - 1,
            "endpoint_recurrence": number("_e1", 1.0), "endpoint_recurrence_24h": number("_e24", 1.0),
            "unique_addresses_per_ip": number("_u1", 1.0), "unique_addresses_per_ip_24h": number("_u24", 1.0),
            "unique_asns": F.col("asns").cast("double"), "unique_countries": F.col("countries").cast("double"),
            "asn_concentration": F.round(F.col("squares") / (F.col("k") * F.col("k")), 4),
            **{n: F.col(n).cast("double") for n in lifetime},
        }
    ).drop("_i1", "_i24", "_u1", "_u24", "_e1", "_e24")


def with_entity(df: DataFrame) -> DataFrame:
    """Cumulative and robust history of the entity. ``df``: rows with entity_history and tx_count_1h."""
    x, mad = F.col("raw_out"), F.coalesce("amount_mad", F.lit(0.0))
    middle, scale = F.coalesce("amount_median", F.col("raw_out")), 1.4826 * mad
    age = F.round((F.col("ts_us") - F.col("first_ts")) / 1e6, 2)
    done = (F.col("k") - 1).cast("double")
    rate = done * 3600 / age
    return df.withColumns(
        {
            "entity_tx_count": F.col("k").cast("double"),
            "entity_volume": F.round("entity_sum", 8),
            "entity_age_seconds": age,
            "unique_counterparties": F.col("addresses").cast("double"),
            "unique_ips": F.col("ips").cast("double"),
            "historical_median_amount": F.round(middle, 8),
            "historical_MAD_amount": F.round(mad, 8),
            "baseline_deviation": F.round(F.when(scale > 1e-6, F.abs(x - middle) / scale).otherwise(0.0), 4),
            "activity_change": F.round(
                F.when((age >= 3600) & (done >= 2), F.when(rate > 1e-4, F.col("tx_count_1h") / rate).otherwise(1.0)).otherwise(1.0), 4
            ),
        }
    )
