"""The typed transaction graph: nodes and edges as two DataFrames.

Transactions are deduplicated by txid (the first in order stays); addresses are joined to the transactions they
fund and receive from, to IP, network and country nodes, to co-spending clusters, and transactions to the ones
shortly before that share an address or IP. No self-join: links look back over a few rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.scalars import clean_ip, clean_label
from txsieve.functions.session import cut, drop

from .components import components

WINDOW_SECONDS, MAX_LINKS, CLIQUE, CHUNK = 300, 5, 20, 64
ORDER = ("ts_us", "txid", "event_id")


def cleaned(df: DataFrame) -> DataFrame:
    """One row per txid: trimmed addresses with their amounts, cleaned IP, network and country."""
    first = Window.partitionBy("txid").orderBy("ts_us", "event_id")
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("timestamp"))
    df = df.where(F.trim(F.coalesce("txid", F.lit(""))) != "").withColumn("_r", F.row_number().over(first)).where("_r = 1")

    def ends(addresses, amounts):
        blank = F.array().cast("array<string>")
        both = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(F.coalesce(addresses, blank)), F.lit(1))),
            lambda i: F.struct(F.trim(F.try_element_at(F.coalesce(addresses, blank), i)).alias("a"), F.coalesce(F.try_element_at(amounts, i), F.lit(0.0)).alias("v")),
        )
        return F.filter(both, lambda p: F.coalesce(p.a, F.lit("")) != "")

    asn = clean_label(F.col("asn"))
    return df.select(
        *ORDER, "fee",
        ends(F.col("input_addresses"), F.col("input_amounts")).alias("ins"), ends(F.col("output_addresses"), F.col("output_amounts")).alias("outs"),
        clean_ip(F.col("src_ip")).alias("ip"), "src_port",
        F.when(F.upper(asn).startswith("AS"), asn).otherwise(F.concat(F.lit("ASN:"), asn)).alias("asn"), asn.alias("asn_name"),
        F.concat(F.lit("COUNTRY:"), F.upper(clean_label(F.col("geo_country")))).alias("country"),
    )


def _edges(df: DataFrame, kind: str, source, target, ts="ts_us", arrow: str = "->", **more) -> DataFrame:
    fill = {"amount": "double", "idx": "int", "src_port": "int", "time_delta_seconds": "double", "shared_addresses": "array<string>", "shared_ips": "array<string>", "support_count": "long", "supporting_txids": "array<string>", "confidence": "double"}
    return df.select(
        F.concat(F.lit(f"{kind}:"), source, F.lit(arrow), target).alias("edge_id"), source.alias("source_id"), target.alias("target_id"),
        F.lit(kind).alias("edge_type"), (F.col(ts) if ts else F.lit(None).cast("long")).alias("ts_us"),
        *[(more[k] if k in more else F.lit(None)).cast(t).alias(k) for k, t in fill.items()],
    )


def address_edges(tx: DataFrame, side: str) -> DataFrame:
    """INPUT_TO or OUTPUT_TO, from the transaction; repeats add up, the first index stays.

    Only transactions that repeat an address are grouped: the others' rows stay where they are.
    """
    kind = "INPUT_TO" if side == "ins" else "OUTPUT_TO"
    again = F.size(F.array_distinct(F.transform(side, lambda p: p.a))) < F.size(side)
    laid = lambda df: df.select("txid", "ts_us", F.posexplode(side).alias("idx", "p")).select("txid", "ts_us", F.col("p.a").alias("address"), F.col("p.v").alias("v"), "idx")
    once = laid(tx.where(~again)).select("txid", "ts_us", "address", F.round("v", 8).alias("amount"), "idx")
    flat = once.unionByName(laid(tx.where(again)).groupBy("txid", "ts_us", "address").agg(F.round(F.sum("v"), 8).alias("amount"), F.min("idx").alias("idx")))
    return _edges(flat, kind, F.col("txid"), F.col("address"), amount=F.col("amount"), idx=F.col("idx"))


def network_edges(tx: DataFrame) -> list[DataFrame]:
    seen = tx.where("ip is not null")
    out = [_edges(seen, "OBSERVED_WITH", F.col("txid"), F.col("ip"), src_port=F.col("src_port"))]
    for kind, to in (("SAME_ASN", "asn"), ("OBSERVED_WITH", "country")):
        last = seen.where(F.col(to).isNotNull()).groupBy("ip", to).agg(F.max_by("ts_us", F.struct(*ORDER)).alias("ts_us"))
        out.append(_edges(last, kind, F.col("ip"), F.col(to)))
    return out


def common_input_pairs(tx: DataFrame, clique: int = CLIQUE, chunk: int = CHUNK) -> DataFrame:
    """(a, b, support_count, supporting_txids, confidence) of all addresses spent together, a < b.

    Transactions of up to ``clique`` distinct inputs lay their pairs out in a row. Of larger ones, ``chunk`` inputs and
    those that come after them are a row, and these rows are spread: the pairs of one are made in many tasks, one by one.
    """
    spent = tx.select("txid", F.array_sort(F.array_distinct(F.transform("ins", lambda p: p.a))).alias("s")).where(F.size("s") >= 2)
    pairs = F.flatten(
        F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    flat = spent.where(F.size("s") <= clique).select("txid", F.explode(pairs).alias("p")).select("txid", "p.*")
    large = spent.where(F.size("s") > clique).select("txid", "s", F.explode(F.sequence(F.lit(1), F.size("s"), F.lit(chunk))).alias("at"))
    large = large.select("txid", "at", F.slice("s", F.col("at"), chunk).alias("first"), F.slice("s", F.col("at"), F.size("s")).alias("rest")).repartition("txid", "at")
    large = large.select("txid", "rest", F.explode("first").alias("a")).select("txid", "a", F.explode(F.filter("rest", lambda b: b > F.col("a"))).alias("b"))
    g = flat.unionByName(large).groupBy("a", "b").agg(F.array_sort(F.collect_set("txid")).alias("supporting_txids"))
    n = F.size("supporting_txids").cast("long")
    return g.select("a", "b", n.alias("support_count"), "supporting_txids", F.least(F.lit(0.95), F.round(0.50 + 0.10 * n, 3)).alias("confidence"))


def clusters(tx: DataFrame) -> DataFrame:
    """(address, cluster): co-spent addresses, directly or by chains; the id carries the smallest member."""
    spent = tx.select(F.array_sort(F.array_distinct(F.transform("ins", lambda p: p.a))).alias("s")).where(F.size("s") >= 2)
    stars = spent.select(F.get("s", F.lit(0)).alias("a"), F.explode(F.slice("s", 2, F.size("s") - 1)).alias("b"))
    return components(stars).select(F.col("node").alias("address"), F.concat(F.lit("candidate_entity:"), "component").alias("cluster"))


def members(edges: DataFrame) -> DataFrame:
    """(address, cluster) as clusters() gives them, read from the graph's edges; pairs have a count of transactions."""
    e = edges.where("edge_type = 'CANDIDATE_SAME_ENTITY' and support_count is null")
    return e.select(F.col("target_id").alias("address"), F.col("source_id").alias("cluster"))


def temporal_links(tx: DataFrame, window_seconds: float = WINDOW_SECONDS, most: int = MAX_LINKS) -> DataFrame:
    """(txid, ts_us, past_txid, time_delta_seconds, shared_addresses, shared_ips): the ``most`` latest earlier ones.

    A band join by time: rows of a key (address or IP) lie in buckets of the window's length, and each row is
    also shown to the bucket after its own, so all that a row can be linked to is in its bucket. There the
    ``most`` rows before it are enough: a pair among the latest of all is among the latest of every key it shares,
    so the keys that name a chosen row are all that both share. A busy key spreads over its buckets.
    What is moved are numbers in the total order: a row per (transaction, key) with at most ``most`` of them.
    """
    addresses = F.array_distinct(F.transform(F.concat("ins", "outs"), lambda p: p.a))
    keys = F.concat(F.transform("addresses", lambda a: F.concat(F.lit("a:"), a)), F.when(F.col("ip").isNotNull(), F.array(F.concat(F.lit("i:"), "ip"))).otherwise(F.array().cast("array<string>")))
    # numbers rise with the order: partitions are ranges of it, sorted
    base = tx.select(*ORDER, "ip", addresses.alias("addresses")).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    base = cut(base.select(F.monotonically_increasing_id().alias("n"), "txid", "ts_us", keys.alias("keys")))
    width = max(1, int(window_seconds * 1_000_000))
    own = F.floor(F.col("ts_us") / F.lit(width))
    shown = F.explode(F.array(F.struct(own.alias("bucket"), F.lit(True).alias("asks")), F.struct((own + 1).alias("bucket"), F.lit(False).alias("asks"))))
    flat = base.select("n", "ts_us", F.explode("keys").alias("key")).select("n", "ts_us", "key", shown.alias("b")).select("n", "ts_us", "key", "b.*")
    inside = Window.partitionBy("key", "bucket").orderBy("n")
    place = F.struct("n", "ts_us")
    flat = flat.withColumns({f"_{i}": F.lag(place, i).over(inside) for i in range(1, most + 1)}).where("asks")
    before = F.filter(F.array(*[f"_{i}" for i in range(1, most + 1)]), lambda p: p.isNotNull() & (F.col("ts_us") - p.ts_us <= width))
    hits = flat.select("n", "key", F.transform(before, lambda p: p.n).alias("ps")).where(F.size("ps") > 0).groupBy("n").agg(F.collect_list(F.struct("key", "ps")).alias("hits"))
    latest = F.slice(F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h.ps))), asc=False), 1, most)
    pairs = hits.select("n", "hits", F.explode(latest).alias("p"))
    pairs = pairs.select("n", "p", F.transform(F.filter("hits", lambda h: F.array_contains(h.ps, F.col("p"))), lambda h: h.key).alias("shared"))
    names = base.select("n", "txid", "ts_us")
    past = names.select(F.col("n").alias("p"), F.col("txid").alias("past_txid"), F.col("ts_us").alias("past_ts"))
    met = pairs.join(names, "n").drop("n").join(past, "p")
    of = lambda kind: F.transform(F.filter("shared", lambda k: k.startswith(kind)), lambda k: F.substring(k, 3, 1 << 30))
    return met.select(
        "txid", "ts_us", "past_txid", F.round((F.col("ts_us") - F.col("past_ts")) / 1e6, 4).alias("time_delta_seconds"),
        F.array_sort(of("a:")).alias("shared_addresses"), of("i:").alias("shared_ips"),
    )


ATTRIBUTES = {
    "txid": "string", "ts_us": "long", "fee": "double", "input_count": "int", "output_count": "int", "address": "string", "ip": "string",
    "asn": "string", "country": "string", "lead_address": "string", "member_count": "long",
}


def nodes_of(tx: DataFrame, member: DataFrame) -> DataFrame:
    """node_id, node_type and the attributes of every node.

    Writes are in order: transactions by time, in each the transaction, its inputs and outputs, IP, network and country;
    clusters last. A node keeps the type of its first write, and of each attribute the last one that was written: ids of
    several kinds may be equal, and two names may stand for one network. Each kind is reduced to a row
    per node before the kinds meet. Members of a cluster are its edges, not a list.
    """
    def place(k):
        return F.struct(F.col("ts_us").alias("t"), F.col("txid").alias("x"), F.col("event_id").alias("e"), (F.lit(k) if isinstance(k, int) else k).alias("k"))

    def kind(df, node, kind_, at, **attributes):
        return df.select(F.col(node).alias("node_id"), F.lit(kind_).alias("node_type"), at.alias("at"), *[attributes.get(a, F.lit(None)).cast(t).alias(a) for a, t in ATTRIBUTES.items()])

    first = F.min("at").alias("at")
    side = lambda c, k: F.transform(c, lambda p, i: F.struct(p.a.alias("address"), (F.lit(k) + i).alias("k")))
    sides = F.concat(side("ins", 1), side("outs", 1 << 20))
    ends = tx.select("ts_us", "txid", "event_id", F.explode(sides).alias("p")).groupBy(F.col("p.address").alias("address")).agg(F.min(place(F.col("p.k"))).alias("at"))
    seen = tx.where("ip is not null")
    at = place(1 << 30)
    ips = seen.select("ip", at.alias("at")).groupBy("ip").agg(first)
    networks = seen.where("asn is not null").select("asn", "asn_name", at.alias("at")).groupBy("asn").agg(first, F.max_by("asn_name", "at").alias("asn_name"))
    countries = seen.where("country is not null").select("country", at.alias("at")).groupBy("country").agg(first)
    entities = member.groupBy("cluster").agg(F.min("address").alias("lead"), F.count(F.lit(1)).alias("n"))
    last = F.struct(F.lit((1 << 63) - 1).alias("t"), F.lit("").alias("x"), F.lit("").alias("e"), F.lit(0).alias("k"))
    deeper = lambda k: F.struct(F.col("at.t").alias("t"), F.col("at.x").alias("x"), F.col("at.e").alias("e"), F.lit(k).alias("k"))
    kinds = [
        kind(tx, "txid", "TRANSACTION", place(0), txid=F.col("txid"), ts_us=F.col("ts_us"), fee=F.col("fee"), input_count=F.size("ins"), output_count=F.size("outs")),
        kind(ends, "address", "ADDRESS", F.col("at"), address=F.col("address")),
        kind(ips, "ip", "IP", deeper((1 << 30) + 1), ip=F.col("ip")),
        kind(networks, "asn", "ASN", deeper((1 << 30) + 2), asn=F.col("asn_name")),
        kind(countries, "country", "COUNTRY", deeper((1 << 30) + 3), country=F.substring_index("country", ":", -1)),
        kind(entities, "cluster", "CANDIDATE_ENTITY", last, lead_address=F.col("lead"), member_count=F.col("n")),
    ]
    nodes = kinds[0]
    for k in kinds[1:]:
        nodes = nodes.unionByName(k)
    # an attribute is of one kind, so a node has one value of it
    return nodes.groupBy("node_id").agg(F.min_by("node_type", "at").alias("node_type"), *[F.max(a).alias(a) for a in ATTRIBUTES])


def build(df: DataFrame, window_seconds: float = WINDOW_SECONDS, most: int = MAX_LINKS, clique: int = CLIQUE, write=None, tx: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of canonical transactions. ``write``: what writes a named table, if not cut(); ``tx``: cleaned(df), if written already."""
    write = write or (lambda _, df: cut(df))
    given, tx = tx, cut(cleaned(df)) if tx is None else tx
    pairs = cut(common_input_pairs(tx, clique))
    member = cut(clusters(tx))
    links = temporal_links(tx, window_seconds, most)
    a, b = F.col("a"), F.col("b")
    edges = [
        address_edges(tx, "ins"), address_edges(tx, "outs"), *network_edges(tx),
        _edges(links, "TEMPORALLY_ASSOCIATED", F.col("past_txid"), F.col("txid"), time_delta_seconds=F.col("time_delta_seconds"), shared_addresses=F.col("shared_addresses"), shared_ips=F.col("shared_ips")),
        _edges(pairs, "CANDIDATE_SAME_ENTITY", a, b, None, "<->", support_count=F.col("support_count"), supporting_txids=F.col("supporting_txids"), confidence=F.col("confidence")),
        _edges(member, "CANDIDATE_SAME_ENTITY", F.col("cluster"), F.col("address"), None, confidence=F.lit(0.60)),
    ]
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    out = write("nodes", nodes_of(tx, member)), write("edges", all_edges)
    drop(pairs, member, *([tx] if given is None else []))
    return out
