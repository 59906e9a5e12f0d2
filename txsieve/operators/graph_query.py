"""Lookups, metrics and evidence on the graph's nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.scalars import clamp_01, round_up4
from txsieve.functions.session import cut

from .components import components

#: Transactions of more addresses are not paired.
LIGHT = 64
#: Roots that one block of surroundings() holds.
BLOCK = 256
#: Up to so many roots, only the edges around them are moved: their names, and those of their members, are broadcast.
FEW = 1000


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node itself, or else the network or country of that name."""
    ids = [node_id, f"ASN:{node_id}", f"COUNTRY:{node_id}"]
    rank = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("node_id"))
    return nodes.where(F.col("node_id").isin(ids)).orderBy(rank).limit(1)


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id)).orderBy("edge_id")


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other"), "edge_id", "edge_type", "amount")
    b = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other"), "edge_id", "edge_type", "amount")
    return a.unionByName(b.where("node_id <> other"))


def k_hop(edges: DataFrame, node_id: str, hops: int) -> DataFrame:
    """(node_id, hop) within ``hops`` of a node, itself excluded: breadth-first, one join a level."""
    near = both_ways(edges).select("node_id", "other")
    seen = edges.sparkSession.createDataFrame([(node_id, 0)], "node_id string, hop int")
    for hop in range(1, hops + 1):
        level = seen.where(F.col("hop") == hop - 1).select("node_id")
        new = near.join(level, "node_id").select(F.col("other").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        seen = cut(seen.unionByName(new.withColumn("hop", F.lit(hop))))
    return seen.where("hop > 0")


def subgraph(nodes: DataFrame, edges: DataFrame, node_id: str, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` and all edges between them."""
    ids = k_hop(edges, node_id, hops).select("node_id").unionByName(nodes.where(F.col("node_id") == node_id).select("node_id"))
    ids = cut(ids)
    inside = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return nodes.join(ids, "node_id", "left_semi"), inside


def transaction_subgraph(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, txid: str, hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges within one to five hops of a transaction, each sorted by id, and its evidence."""
    if not 1 <= hops <= 5:
        raise ValueError("hops must be 1 to 5")
    near, inside = subgraph(nodes, edges, txid, hops)
    return near.orderBy("node_id"), inside.orderBy("edge_id"), evidence.where(F.col("txid") == txid)


def transactions_of_addresses(edges: DataFrame) -> DataFrame:
    """(address, as_input, as_output, all): sorted txids."""
    e = edges.where(F.col("edge_type").isin("INPUT_TO", "OUTPUT_TO"))
    ids = lambda kind: F.array_sort(F.collect_set(F.when(F.col("edge_type") == kind, F.col("source_id"))))
    return e.groupBy(F.col("target_id").alias("address")).agg(ids("INPUT_TO").alias("as_input"), ids("OUTPUT_TO").alias("as_output"), F.array_sort(F.collect_set("source_id")).alias("all"))


def addresses_of_transactions(tx: DataFrame) -> DataFrame:
    """(txid, inputs, outputs, all): lists in order with repeats, and the union by first sight."""
    a = lambda c: F.transform(c, lambda p: p.a)
    return tx.select("txid", a("ins").alias("inputs"), a("outs").alias("outputs"), F.array_distinct(F.concat(a("ins"), a("outs"))).alias("all"))


def transactions_of_ips(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ips = nodes.where("node_type = 'IP'").select(F.col("node_id").alias("target_id"))
    e = edges.where("edge_type = 'OBSERVED_WITH'").join(ips, "target_id", "left_semi")
    return e.groupBy(F.col("target_id").alias("ip")).agg(F.array_sort(F.collect_set("source_id")).alias("txids"))


def related_entities(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(related_id, relation): of an address its clusters, peers and fellow members; of a cluster its members;
    of a transaction what its inputs have."""
    same = edges.where("edge_type = 'CANDIDATE_SAME_ENTITY'").select("source_id", "target_id")
    is_cluster = F.col("source_id").startswith("candidate_entity:")
    member = same.where(is_cluster).select(F.col("source_id").alias("cluster"), F.col("target_id").alias("address"))
    pair = same.where(~is_cluster)
    pair = pair.unionByName(pair.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    start = edges.where((F.col("edge_type") == "INPUT_TO") & (F.col("source_id") == node_id)).select(F.col("target_id").alias("address"))
    start = start.unionByName(nodes.where(F.col("node_id") == node_id).where("node_type = 'ADDRESS'").select(F.col("node_id").alias("address"))).distinct()
    of = member.join(start, "address", "left_semi")
    parts = [
        of.select(F.col("cluster").alias("related_id"), F.lit("cluster").alias("relation")),
        pair.join(start.withColumnRenamed("address", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("related_id"), F.lit("pair").alias("relation")),
        member.join(of.select("cluster").distinct(), "cluster", "left_semi").select(F.col("address").alias("related_id"), F.lit("member").alias("relation")),
        member.where(F.col("cluster") == node_id).select(F.col("address").alias("related_id"), F.lit("member").alias("relation")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("related_id") != node_id).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, other, n, weight, links) of every two joined nodes, both ways: edges, their amounts, temporal ones."""
    pairs = both_ways(edges).groupBy("node_id", "other")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("amount", F.lit(1.0))).alias("weight"), F.count_if(F.col("edge_type") == "TEMPORALLY_ASSOCIATED").alias("links"))


def degrees(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(node_id, degree, weighted_degree): distinct incident edges, and their amounts (1 without one).

    ``pairs``, here and below: neighbours(edges), if written already.
    """
    if pairs is not None:
        return pairs.groupBy("node_id").agg(F.sum("n").alias("degree"), F.round(F.sum("weight"), 8).alias("weighted_degree"))
    return both_ways(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum(F.coalesce("amount", F.lit(1.0))), 8).alias("weighted_degree"))


def surroundings(edges: DataFrame, roots: DataFrame, light: int = LIGHT, block: int = BLOCK) -> DataFrame:
    """One row per root: its edges, their amounts, temporal ones, addresses paid from it, and the nodes around it.

    ``n`` counts the root and its neighbours; ``members`` lists them if they are ``light`` at most, else some of them.
    Roots near each other in time (in name, without ``ts_us``) have the same ``block``, which holds up to ``block`` of them.
    Edges are moved once, to their roots; a list never grows over ``light``.
    """
    order = [c for c in ("ts_us", "node_id") if c in roots.columns]
    dealt = roots.groupBy("node_id").agg(F.min(order[0]).alias("ts_us")) if len(order) > 1 else roots.select("node_id").distinct()
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # rises inside a partition, and its blocks are of one partition
    dealt = cut(dealt.select("node_id", F.floor(place / block).alias("block")))
    paid = F.col("edge_type").isin("INPUT_TO", "OUTPUT_TO")
    side = lambda a, b, paid: edges.select(F.col(a).alias("node_id"), F.col(b).alias("other"), "edge_type", "amount", paid.alias("paid"))
    met = side("source_id", "target_id", paid).unionByName(side("target_id", "source_id", F.lit(False)).where("node_id <> other"))
    if dealt.count() <= FEW:
        met = met.join(F.broadcast(dealt.select("node_id")), "node_id", "left_semi")
    # all that follows is by node_id, as the join leaves it
    one = dealt.join(met, "node_id", "left").groupBy("node_id", "block", "other").agg(
        F.count("other").alias("n"), F.sum(F.when(F.col("other").isNotNull(), F.coalesce("amount", F.lit(1.0)))).alias("weight"),
        F.count_if(F.col("edge_type") == "TEMPORALLY_ASSOCIATED").alias("links"), F.max("paid").alias("paid"),
    )
    one = one.withColumn("mate", F.when(F.col("other") != F.col("node_id"), F.col("other")))
    one = one.withColumn("_i", F.row_number().over(Window.partitionBy("node_id").orderBy(F.asc_nulls_last("mate"))))
    return one.groupBy("node_id", "block").agg(
        F.sum("n").alias("degree"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 8).alias("weighted_degree"), F.sum("links").alias("links"), F.count_if("paid").alias("paid"),
        (1 + F.count("mate")).alias("n"), F.concat(F.array("node_id"), F.collect_list(F.when(F.col("_i") < light, F.col("mate")))).alias("members"),
    )


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component, component_size): weakly connected, all kinds of nodes."""
    c = components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    c = nodes.select("node_id").join(c.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("component_size")), "component")


def co_addresses(money: DataFrame, light: int = LIGHT, asked: DataFrame | None = None) -> DataFrame:
    """(node_id, n): the other addresses that share a transaction with an address, of distinct (txid, address) rows.

    ``asked``: the addresses to count for (all if None).

    Transactions of up to ``light`` addresses give pairs. Heavier ones are never paired: addresses that lie in the same
    heavy transactions have the same union of them, which is counted once, for one address of each such set
    (two 64-bit sums and a count stand for it). Pairs of light transactions add to it where no heavy one holds both.
    """
    sizes = money.groupBy("txid").agg(F.count(F.lit(1)).alias("k"))
    sized = cut(money.join(sizes, "txid"))
    few, heavy = sized.where(F.col("k") <= light).drop("k"), sized.where(F.col("k") > light).drop("k")
    of = lambda df: df if asked is None else df.join(asked.select("address"), "address", "left_semi")
    pairs = of(few).join(few.select("txid", F.col("address").alias("other")), "txid").where("address <> other").select("address", "other").distinct()
    h = F.xxhash64(F.lit(1), "txid")
    sets = cut(of(heavy).groupBy("address").agg(F.sum(h.cast("decimal(38, 0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "txid")).alias("b"), F.count(F.lit(1)).alias("m")))
    first = sets.groupBy("a", "b", "m").agg(F.min("address").alias("address"))
    unions = first.join(heavy, "address").select("a", "b", "m", "txid").join(heavy.select("txid", F.col("address").alias("member")), "txid")
    unions = unions.groupBy("a", "b", "m").agg((F.count_distinct("member") - 1).alias("n"))
    together = pairs.join(heavy, "address").join(heavy.select("txid", F.col("address").alias("other")), ["txid", "other"]).select("address", "other").distinct()
    apart = pairs.join(together, ["address", "other"], "left_anti").groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    both = sets.join(unions, ["a", "b", "m"]).select("address", "n").unionByName(apart)
    return both.groupBy(F.col("address").alias("node_id")).agg(F.sum("n").alias("n"))


def counterparties(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None, pairs: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """(node_id, unique_counterparties) of ``roots`` (all nodes if None): addresses of a transaction, co-addresses of an
    address, transactions of an IP, neighbours of anything else. ``around``: surroundings(edges, roots), if written already."""
    kinds = None
    if roots is not None:
        nodes = cut(nodes.select("node_id", "node_type").join(roots.select("node_id"), "node_id", "left_semi"))
        kinds = {r.node_type for r in nodes.select("node_type").distinct().collect()}  # six at most; the others' tables are not made
    money = edges.where(F.col("edge_type").isin("INPUT_TO", "OUTPUT_TO")).select(F.col("source_id").alias("txid"), F.col("target_id").alias("address")).distinct()
    asked = None if roots is None else nodes.where("node_type = 'ADDRESS'").select(F.col("node_id").alias("address"))
    tables = {
        ("TRANSACTION",): lambda: money.groupBy(F.col("txid").alias("node_id")).agg(F.count(F.lit(1)).alias("n")) if around is None else around.select("node_id", F.col("paid").alias("n")),
        ("ADDRESS",): lambda: co_addresses(money, asked=asked),
        ("IP",): lambda: edges.where("edge_type = 'OBSERVED_WITH'").groupBy(F.col("target_id").alias("node_id")).agg(F.count_distinct("source_id").alias("n")),
        ("ASN", "COUNTRY", "CANDIDATE_ENTITY"): lambda: (neighbours(edges) if pairs is None else pairs).groupBy("node_id").agg(F.count(F.lit(1)).alias("n")),
    }
    out = nodes.select("node_id", F.lit(0).cast("long").alias("unique_counterparties")).limit(0)
    for of, table in tables.items():
        if kinds is None or kinds & set(of):
            part = nodes.where(F.col("node_type").isin(*of)).join(table(), "node_id", "left")
            out = out.unionByName(part.select("node_id", F.coalesce("n", F.lit(0)).alias("unique_counterparties")))
    return out


def local_density(edges: DataFrame, roots: DataFrame, light: int = LIGHT, around: DataFrame | None = None) -> DataFrame:
    """(node_id, local_density): edges over ordered pairs among a root and its neighbours.

    The targets of a node's edges, as a list, are sent once to each block of roots that it is a member around, and meet the
    members' lists there: neither lists nor wedges are laid out for every root and member. Roots of more than ``light``
    members, and members with more than ``light`` edges, are met by rows: those of the first by edge, those of the
    second by pair of members. Hubs that transactions point to have few edges of their own and are never spread out.

    ``around``: surroundings(edges, roots, light), if written already.
    """
    around = cut(surroundings(edges, roots, light)) if around is None else around
    # an edge is known by its id; where type and ends make it up, the type is enough
    made = F.concat("edge_type", F.lit(":"), "source_id", F.lit("->"), "target_id")
    known = F.struct("edge_type", F.when(~F.col("edge_id").eqNullSafe(made), F.col("edge_id")).alias("id")).alias("edge")
    ends = edges.select(F.col("source_id").alias("other"), "target_id", known)
    small, large = around.where(F.col("n") <= light), around.where(F.col("n") > light).select("node_id")
    asked = cut(small.select("block", F.explode("members").alias("other")).distinct())
    near = ends if around.count() > FEW else ends.join(F.broadcast(asked.select("other").distinct()), "other", "left_semi")
    # by source, as all that follows; lists hold each target once, and further edges to it in a list of their own, mostly empty
    by = Window.partitionBy("other").orderBy("target_id", "edge")
    sized = near.repartition("other").distinct().withColumns({"_i": F.row_number().over(by), "_again": F.lag("target_id").over(by).eqNullSafe(F.col("target_id"))})
    listed = lambda c: F.collect_list(F.when((F.col("_i") <= light) & c, F.col("target_id")))
    few = cut(sized.groupBy("other").agg(F.count(F.lit(1)).alias("k"), listed(~F.col("_again")).alias("targets"), listed(F.col("_again")).alias("more")))
    sent = asked.join(few.where(F.col("k") <= light).drop("k"), "other")
    hubs = cut(asked.join(few.where(F.col("k") > light).select("other"), "other", "left_semi"))

    def meet(sent):
        # numbers are compared first, names where they agree; they are made where the rows meet
        of = small.select("block", "node_id", "members").repartition("block").withColumn("_hs", F.transform("members", lambda x: F.hash(x)))
        to = sent.repartition("block").withColumn("_h", F.hash("other"))
        return of.join(to.hint("merge"), "block").where(F.array_contains("_hs", F.col("_h")) & F.array_contains("members", F.col("other")))

    # members meet targets by hashing; both hold each node once
    inside = F.size(F.array_intersect("members", "targets")) + F.when(F.size("more") > 0, F.size(F.filter("more", lambda t: F.array_contains(F.col("members"), t)))).otherwise(0)
    counts = [meet(sent).groupBy("block", "node_id").agg(F.sum(inside).alias("m")).select("node_id", "m")]
    edge = ends.distinct()
    one = F.lit(1).cast("long").alias("m")
    if not hubs.isEmpty():
        pairs = meet(hubs).select("node_id", "other", F.explode("members").alias("target_id"))
        counts.append(pairs.join(edge, ["other", "target_id"]).select("node_id", one))
    if not large.isEmpty():
        members = both_ways(edges).select("node_id", "other").join(large, "node_id", "left_semi").unionByName(large.select("node_id", F.col("node_id").alias("other"))).distinct()
        counts.append(members.join(edge, "other").join(members.select("node_id", F.col("other").alias("target_id")), ["node_id", "target_id"], "left_semi").select("node_id", one))
    m = counts[0]
    for c in counts[1:]:
        m = m.unionByName(c)
    m = m.groupBy("node_id").agg(F.sum("m").alias("m"))
    return around.select("node_id", "n").join(m, "node_id", "left").select("node_id", F.when(F.col("n") > 1, F.round(F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1)), 6)).otherwise(0.0).alias("local_density"))


def metrics(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None, around: DataFrame | None = None) -> DataFrame:
    """Degree, weighted degree, counterparties, component size and density of ``roots`` (all nodes if None)."""
    met = counterparties(nodes, edges, roots, around=around)
    roots = nodes.select("node_id") if roots is None else roots
    around = cut(surroundings(edges, roots)) if around is None else around
    return (
        around.select("node_id", "degree", "weighted_degree")
        .join(met, "node_id", "left")
        .join(component_sizes(nodes, edges).drop("component"), "node_id", "left")
        .join(local_density(edges, roots, around=around), "node_id", "left")
        .na.fill(0)
    )


def _few_nodes(edges: DataFrame, around: DataFrame) -> DataFrame:
    """(node_id, nodes_2hop): the size of the two-hop neighbourhood, up to 4, of the roots of surroundings().

    Whoever has three neighbours, or one neighbour with three, has at least four nodes. Only around the others
    edges are looked at, and only where their surroundings are small, the two hops are laid out.
    """
    lone = cut(around.where("n < 4").select("node_id", F.filter("members", lambda x: x != F.col("node_id")).alias("mates")))
    if lone.isEmpty():
        return around.select("node_id", F.lit(4).alias("nodes_2hop"))
    mine = lone.select("node_id", F.explode("mates").alias("other"))
    near = cut(both_ways(edges).select("node_id", "other").where("node_id <> other").distinct().join(mine.select(F.col("other").alias("node_id")).distinct(), "node_id", "left_semi"))
    n = near.groupBy(F.col("node_id").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    bound = mine.join(n, "other").groupBy("node_id").agg((1 + F.max("n")).alias("least"))
    one = mine.join(bound.where("least < 4"), "node_id", "left_semi")
    two = one.join(near.select(F.col("node_id").alias("other"), F.col("other").alias("far")), "other").select("node_id", F.col("far").alias("other"))
    exact = one.unionByName(two).where("node_id <> other").distinct().groupBy("node_id").agg((1 + F.count(F.lit(1))).alias("exact"))
    few = lone.select("node_id").join(bound, "node_id", "left").join(exact, "node_id", "left").select("node_id", F.least(F.lit(4), F.coalesce("exact", "least", F.lit(1))).cast("int").alias("nodes_2hop"))
    return around.where("n >= 4").select("node_id", F.lit(4).alias("nodes_2hop")).unionByName(few)


def _item(metric: str, value: Column, text: str) -> Column:
    return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.format_string(text, value.cast("double")).alias("reason"))


def graph_evidence(tx: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per transaction: metrics, normalised signals, composite score, support score and evidence items."""
    around = cut(surroundings(edges, tx.select(F.col("txid").alias("node_id"), "ts_us")))
    roots = around.select("node_id")
    same = edges.where("edge_type = 'CANDIDATE_SAME_ENTITY' and support_count is not null")
    ends = same.select(F.col("source_id").alias("address"), "support_count").unionByName(same.select(F.col("target_id").alias("address"), "support_count"))
    best = ends.groupBy("address").agg(F.max("support_count").alias("s"))
    inputs = edges.where("edge_type = 'INPUT_TO'").select(F.col("source_id").alias("node_id"), F.col("target_id").alias("address"))
    support = inputs.join(best, "address", "left").groupBy("node_id").agg(F.coalesce(F.max("s"), F.lit(1)).alias("s"))
    spent = tx.select(F.col("txid").alias("node_id"), F.size("ins").alias("n_inputs"))
    links = around.select("node_id", F.col("links").alias("temporal_links"))
    df = metrics(nodes, edges, roots, around).join(spent, "node_id").join(support, "node_id", "left").join(links, "node_id", "left").join(_few_nodes(edges, around), "node_id", "left")
    df = df.withColumns(
        {
            "temporal_links": F.coalesce("temporal_links", F.lit(0)),
            "common_input_support": F.when(F.col("n_inputs") >= 2, F.greatest(F.coalesce("s", F.lit(1)), F.lit(1))).otherwise(0),
        }
    )
    norm = {
        "norm_degree": clamp_01((F.col("degree") - 2) / 18),
        "norm_component_size": clamp_01((F.col("component_size") - 3) / 27),
        "norm_local_density": clamp_01(F.col("local_density") / 0.30),
        "norm_common_input": F.when(F.col("n_inputs") >= 2, clamp_01(0.40 + 0.12 * F.col("common_input_support"))).otherwise(0.0),
        "norm_temporal_links": clamp_01(F.col("temporal_links") / 5),
        "norm_counterparties": clamp_01((F.col("unique_counterparties") - 2) / 10),
    }
    df = df.withColumns(norm)
    top = F.sort_array(F.array(*[F.col(k) for k in norm if k != "norm_counterparties"]), asc=False)
    df = df.withColumn("composite_graph_score", round_up4(top[0] + (1 - top[0]) * 0.25 * top[1]))
    known = F.least(F.lit(1.0), F.col("nodes_2hop") / 4)
    df = df.withColumn(
        "graph_support_score",
        round_up4(clamp_01(0.50 * known + 0.30 * F.col("composite_graph_score") + 0.20 * F.least(F.lit(1.0), F.col("degree") / 4))),
    )
    items = [
        _item("degree", F.col("degree"), "%.0f edges meet here"), _item("connected_component_size", F.col("component_size"), "part of a component of %.0f nodes"),
        _item("local_density", F.col("local_density"), "density of the neighbourhood %.4f"),
        F.when(F.col("n_inputs") >= 2, _item("common_input_support", F.col("common_input_support"), "inputs spent together in %.0f transactions")),
        F.when(F.col("temporal_links") > 0, _item("temporal_links", F.col("temporal_links"), "%.0f links to transactions close in time")),
    ]
    return df.withColumn("graph_items", F.filter(F.array(*items), lambda x: x.isNotNull())).withColumnRenamed("node_id", "txid").drop("s")
