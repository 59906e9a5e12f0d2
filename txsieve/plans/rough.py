"""Registered queries on a rougher fixture: repeated txids, blank and padded addresses, ids that meet across kinds of
nodes, networks by several names, and rows that stand apart from all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txsieve.functions.session import cut, prepare
from txsieve.operators import graph

from . import fixture
from .oracle import sql
from .queries import rnd, rnd_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_CHAIN = ["lines", "ev", "c0", "c"]


def query(name: str, oracle_sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle_sql:
            ORACLE[name] = oracle_sql
        return f

    return add


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture with faults by event id."""
    df = fixture.transactions(prepare(spark), sf_dir)
    e = F.col("event_id").cast("long")
    apart = e % 17 == 0
    other = lambda n: F.concat(F.lit("tx_"), F.lpad(n.cast("string"), 8, "0"))
    address = lambda a: F.when(apart, F.concat(F.lit("z"), (e / 34).cast("long").cast("string"), a)).otherwise(a)
    return df.select(
        *[c for c in df.columns if c not in ("txid", "src_ip", "asn", "geo_country", "input_addresses", "output_addresses")],
        F.when(e % 101 == 0, F.concat(F.lit("a_"), (e % 400).cast("string"))).when((e % 31 == 0) & (e > 31), other(e - 7)).when(e % 211 == 0, F.lit(" ")).otherwise(F.col("txid")).alias("txid"),
        F.when(apart, "unknown_ip").otherwise(F.col("src_ip")).alias("src_ip"),
        F.when(e % 19 == 0, F.substring("asn", 3, 9)).when(e % 23 == 0, F.concat(F.lit("ASN:"), F.substring("asn", 3, 9))).otherwise(F.col("asn")).alias("asn"),
        F.when(e % 29 == 0, "n/a").otherwise(F.col("geo_country")).alias("geo_country"),
        F.transform("input_addresses", address).alias("input_addresses"),
        F.transform("output_addresses", lambda a, i: F.when((e % 13 == 0) & (i == 0), F.lit("  ")).when(e % 13 == 1, F.concat(F.lit(" "), address(a), F.lit(" "))).otherwise(address(a))).alias("output_addresses"),
    )


_ROUGH = """r0 as (select *, cast(event_id as bigint) as e from c),
r as (select event_id, ts_us, fee, src_port, amts,
  case when e % 101 = 0 then 'a_' || (e % 400) when e % 31 = 0 and e > 31 then 'tx_' || lpad(cast(e - 7 as varchar), 8, '0') when e % 211 = 0 then ' ' else txid end as txid,
  case when e % 17 = 0 or e % 97 = 0 then null else src_ip end as ip,
  case when e % 19 = 0 then 'ASN:' || asn[3:] when e % 23 = 0 then 'ASN:' || asn[3:] else asn end as asn,
  case when e % 19 = 0 then asn[3:] when e % 23 = 0 then 'ASN:' || asn[3:] else asn end as asn_name,
  case when e % 29 = 0 then null else 'COUNTRY:' || upper(geo_country) end as country,
  case when e % 17 = 0 then list_transform(ins, lambda a: 'z' || (e // 34) || a) else ins end as ins,
  case when e % 13 = 0 then (case when e % 17 = 0 then list_transform(outs, lambda a: 'z' || (e // 34) || a) else outs end)[2:]
    when e % 17 = 0 then list_transform(outs, lambda a: 'z' || (e // 34) || a) else outs end as outs
  from r0),
t as (select * from r where trim(txid) <> '' qualify row_number() over (partition by txid order by ts_us, event_id) = 1)"""


def rsql(rest: str) -> str:
    return sql(_CHAIN, "select 1").rsplit("select 1", 1)[0].rstrip() + ",\n" + _ROUGH + "\n" + rest


@query("b_node_attributes", rsql("""
, co as (select txid, unnest(list_distinct(ins)) as a from t where len(list_distinct(ins)) > 1),
w(a, lead) as (
  select distinct a, a from co
  union select x.a, w.lead from w join co y on y.a = w.a join co x on x.txid = y.txid),
cl as (select a, min(lead) as lead from w group by a),
wr as (
  select txid as id, 'TRANSACTION' as kind, ts_us as t, txid as x, event_id as e, 0 as k, ts_us, fee, len(ins) as ni, len(outs) as no, null::varchar as asn, null::bigint as members from t
  union all select a, 'ADDRESS', ts_us, txid, event_id, 1, null, null, null, null, null, null from (select *, unnest(list_concat(ins, outs)) as a from t)
  union all select ip, 'IP', ts_us, txid, event_id, 2, null, null, null, null, null, null from t where ip is not null
  union all select asn, 'ASN', ts_us, txid, event_id, 3, null, null, null, null, asn_name, null from t where ip is not null
  union all select country, 'COUNTRY', ts_us, txid, event_id, 4, null, null, null, null, null, null from t where ip is not null and country is not null
  union all select 'candidate_entity:' || lead, 'CANDIDATE_ENTITY', 9223372036854775807, '', '', 5, null, null, null, null, null, count(*) from cl group by lead)
select id as node_id, arg_min(kind, (t, x, e, k)) as node_type, max(ts_us) as ts_us, """ + rnd_sql("max(fee)", 6) + """ as fee, cast(max(ni) as integer) as input_count,
  cast(max(no) as integer) as output_count, arg_max(asn, (t, x, e, k)) filter (asn is not null) as asn,
  max(case when kind = 'COUNTRY' then id[9:] end) as country, max(members) as member_count from wr group by id"""))  # fmt: skip
def b_node_attributes(spark, sf_dir):
    tx = cut(graph.cleaned(transactions(spark, sf_dir)))
    nodes = graph.nodes_of(tx, cut(graph.clusters(tx)))
    return nodes.select("node_id", "node_type", "ts_us", rnd("fee", 6).alias("fee"), "input_count", "output_count", "asn", "country", "member_count")


@query("b_observed_ports", rsql("select 'OBSERVED_WITH:' || txid || '->' || ip as edge_id, cast(src_port as integer) as src_port, ts_us from t where ip is not null"))
def b_observed_ports(spark, sf_dir):
    return graph.network_edges(graph.cleaned(transactions(spark, sf_dir)))[0].select("edge_id", "src_port", "ts_us")
