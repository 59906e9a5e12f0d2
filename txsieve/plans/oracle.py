"""DuckDB SQL of the same definitions: named steps, joined as common table expressions."""

from __future__ import annotations

START = 1704067200000000
M5, H1, D1 = 300000000, 3600000000, 86400000000

STEPS = {
    "lines": """select l_orderkey as event_id,
  list(struct_pack(p := l_partkey, x := l_extendedprice) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as lines,
  sum(cast(round(l_tax * 100) as bigint)) as tax from lineitem group by 1""",
    "ev": f"""select e.*, coalesce(lines, []) as lines, cast(coalesce(tax, 0) as double) / 10000 as fee_, n_name,
  case when e.event_id % 7 = 0 then 1 + e.event_id % 6 else 1 + e.event_id % 2 end as n_in,
  {START} + (epoch_us(ts) - {START}) // 40 as ts_us
  from events e left join lines using (event_id) left join nation on n_nationkey = user_id % 25""",
    "c0": """select cast(event_id as varchar) as event_id, 'tx_' || lpad(cast(event_id as varchar), 8, '0') as txid, ts_us,
  case when event_id % 97 = 0 then 'unknown_ip' else '10.0.' || (user_id % 12) || '.1' end as src_ip,
  '172.16.0.' || (event_id % 4) as dst_ip, 1024 + (user_id * 7) % 300 as src_port,
  case when event_id % 20 = 0 then 18333 else 8333 end as dst_port,
  list_transform(range(n_in), lambda i: 'a_' || ((user_id * 3 + 17 * i) % 400)) as ins,
  list_transform(lines, lambda l: 'a_' || (l.p % 400)) as outs,
  list_transform(lines, lambda l: case when event_type = 'purchase' then 0.1::double else l.x / 10000 end) as amts,
  fee_ as fee, n_in, event_type as script_type, n_name as geo_country,
  'AS' || (100 * ((user_id + case when event_id % 9 = 0 then 1 else 0 end) % 6)) as asn from ev""",
    "c": """select *, coalesce(list_sum(amts), 0.0) as raw_out, coalesce(nullif(ins[1], ''), 'ip_' || nullif(src_ip, ''), 'unknown_entity') as entity,
  cast(len(ins) as double) as ni, cast(len(outs) as double) as no from c0""",
    "rowf": """select *, raw_out + fee as raw_in,
  case when len(amts) > 0 then raw_out / len(amts) else 0 end as amount_mean,
  case when len(amts) > 1 then list_aggregate(amts, 'stddev_pop') else 0 end as amount_std,
  case when raw_out > 1e-12 then list_sum(list_transform(amts, lambda x: (x / raw_out) * (x / raw_out))) else 0 end as output_concentration,
  case when len(amts) > 0 then list_max(list_transform(amts, lambda x: len(list_filter(amts, lambda y: round(y, 8) = round(x, 8))))) / len(amts) else 0 end as equal_output_ratio,
  case when len(amts) > 0 then len(list_filter(amts, lambda x: cast(round(x * 1e8) as bigint) > 0 and cast(round(x * 1e8) as bigint) % 500000 = 0)) / len(amts) else 0 end as round_amount_ratio,
  case when ni + no > 0 then ni / (ni + no) else 0 end as fan_in_ratio, case when ni + no > 0 then no / (ni + no) else 0 end as fan_out_ratio,
  case when ni in (1, 2) and no = 2 and raw_out > 1e-8 and list_min(amts) / raw_out < 0.35 then 1.0 else 0.0 end as is_peeling_structure,
  case when ni >= 5 and no <= 2 then 1.0 else 0.0 end as is_consolidation_structure,
  case when ni <= 2 and no >= 5 then 1.0 else 0.0 end as is_dispersion_structure from c""",
    "rowg": """select *, case when amount_mean > 1e-12 then amount_std / amount_mean else 0 end as amount_cv,
  case when no >= 3 and equal_output_ratio >= 0.7 then 1.0 else 0.0 end as is_equal_split_structure from rowf""",
    "given": "select event_id, txid, ts_us, unnest(outs) as address from c",
    "taken": "select event_id, txid, ts_us, unnest(ins) as address, generate_subscripts(ins, 1) as pos from c",
    "par": """select event_id, arg_min(struct_pack(id := pid, ts := pts), pos) as p from (
    select t.event_id, t.pos, arg_max(g.event_id, (g.ts_us, g.txid, g.event_id)) as pid, max(g.ts_us) as pts
    from taken t join given g on g.address = t.address and (g.ts_us, g.txid, g.event_id) < (t.ts_us, t.txid, t.event_id) group by 1, 2) group by 1""",
    "hop(event_id, hops)": """select event_id, cast(1 as bigint) from c where event_id not in (select event_id from par)
  union all select p.event_id, h.hops + 1 from hop h join par p on p.p.id = h.event_id""",
    "lin": """select c.*, p.p.id as chain_parent, (c.ts_us - p.p.ts) / 1e6 as chain_interval, h.hops as chain_hops
  from c left join par p using (event_id) join hop h using (event_id)""",
    "tmp0": f"""select *, count(*) over m5 as n5, count(*) over h1 as n1, count(*) over d1 as n24, sum(raw_out) over m5 as v5, sum(raw_out) over h1 as v1,
  sum(raw_out) over d1 as v24, (ts_us - lag(ts_us) over s) / 1e6 as gap, row_number() over s as k from lin
  window s as (partition by entity order by ts_us, txid, event_id), m5 as (partition by entity order by ts_us range between {M5} preceding and current row),
  h1 as (partition by entity order by ts_us range between {H1} preceding and current row), d1 as (partition by entity order by ts_us range between {D1} preceding and current row)""",
    "tmp1": """select *, avg(gap) over w as mean_gap, quantile_cont(gap, 0.5) over w as med_gap,
  first_value(case when k = 1 and chain_parent is not null and chain_interval <= 300 then chain_hops - 1 else 0 end) over (partition by entity order by ts_us, txid, event_id) as h0,
  case when chain_parent is not null and chain_interval <= 300 then greatest(n5, chain_hops) else n5 end as tx5 from tmp0
  window w as (partition by entity order by ts_us, txid, event_id rows between 99 preceding and current row)""",
    "tmp": """select *, cast(tx5 as double) as tx_count_5m, cast(n1 as double) as tx_count_1h, cast(n24 as double) as tx_count_24h,
  coalesce(mean_gap, case when chain_interval > 0 then chain_interval end, 0) as mean_interarrival,
  coalesce(med_gap, case when chain_interval > 0 then chain_interval end, 0) as median_interarrival,
  case when n1 > 1 then 12.0 * tx5 / n1 when chain_parent is not null and chain_interval <= 300 and tx5 >= 2 then 2.0 * tx5 else 1.0 end as burst_score,
  case when v1 > 1e-12 then 12 * v5 / v1 else 1.0 end as velocity_ratio, cast(k - 1 + h0 as double) as history_count,
  least(1.0, (k - 1 + h0) / 15.0) as baseline_stability from tmp1""",
    "net0": """select *, case when src_ip not in ('', 'unknown_ip', 'None', 'none', 'null', '0') then src_ip end as ip,
  row_number() over (partition by entity, asn order by ts_us, txid, event_id) as rn_asn,
  row_number() over (partition by entity order by ts_us, txid, event_id) as kk,
  case when row_number() over (partition by entity, geo_country order by ts_us, txid, event_id) = 1 then 1 else 0 end as new_cc,
  case when row_number() over (partition by entity, src_ip order by ts_us, txid, event_id) = 1 then 1 else 0 end as new_ip from c""",
    "net": f"""select *, case when ip is null then 0.0 else cast(count(*) over i1 - 1 as double) end as ip_reuse_count,
  case when ip is null then 0.0 else cast(count(*) over i24 - 1 as double) end as ip_reuse_count_24h,
  case when ip is null then 1.0 else cast(count(distinct entity) over i1 as double) end as unique_addresses_per_ip,
  case when ip is null then 1.0 else cast(count(distinct entity) over i24 as double) end as unique_addresses_per_ip_24h,
  case when ip is null then 1.0 else cast(count(*) over e1 as double) end as endpoint_recurrence,
  case when ip is null then 1.0 else cast(count(*) over e24 as double) end as endpoint_recurrence_24h,
  cast(sum(case when rn_asn = 1 then 1 else 0 end) over u as double) as unique_asns, cast(sum(new_cc) over u as double) as unique_countries,
  cast(sum(new_ip) over u as double) as unique_ips, sum(2 * rn_asn - 1) over u / cast(kk * kk as double) as asn_concentration,
  cast(row_number() over (partition by geo_country order by ts_us, txid, event_id) as double) as country_count,
  cast(row_number() over (partition by src_port order by ts_us, txid, event_id) as double) as src_port_frequency,
  cast(row_number() over (partition by dst_port order by ts_us, txid, event_id) as double) as dst_port_frequency from net0
  window u as (partition by entity order by ts_us, txid, event_id), i1 as (partition by ip order by ts_us range between {H1} preceding and current row),
  i24 as (partition by ip order by ts_us range between {D1} preceding and current row), e1 as (partition by ip, dst_ip order by ts_us range between {H1} preceding and current row),
  e24 as (partition by ip, dst_ip order by ts_us range between {D1} preceding and current row)""",
    "cpn": """select event_id, sum(case when rn = 1 then 1 else 0 end) as fresh from (
    select event_id, row_number() over (partition by entity, address order by ts_us, txid, event_id) as rn
    from (select distinct c.event_id, c.txid, c.ts_us, c.entity, g.address from c join given g using (event_id))) group by 1""",
    "ent0": """select c.*, fresh, cast(row_number() over u as double) as entity_tx_count, sum(raw_out) over u as entity_volume,
  (ts_us - min(ts_us) over u) / 1e6 as age, cast(sum(coalesce(fresh, 0)) over u as double) as unique_counterparties,
  list(raw_out) over (partition by entity order by ts_us, txid, event_id rows between 200 preceding and 1 preceding) as hist
  from c left join cpn using (event_id) window u as (partition by entity order by ts_us, txid, event_id)""",
    "ent1": "select *, list_aggregate(coalesce(hist, []), 'median') as med0 from ent0",
    "ent": """select *, coalesce(med0, raw_out) as med,
  case when len(coalesce(hist, [])) >= 2 then list_aggregate(list_transform(hist, lambda v: abs(v - med0)), 'median') else 0 end as mad from ent1""",
    "feat": """select g.event_id, g.txid, g.ts_us, g.entity, g.ni as input_count, g.no as output_count, g.fan_in_ratio, g.fan_out_ratio, g.output_concentration, g.equal_output_ratio,
  g.round_amount_ratio, g.amount_cv, g.is_peeling_structure, g.is_consolidation_structure, g.is_dispersion_structure, g.is_equal_split_structure, g.raw_out,
  t.tx_count_5m, t.tx_count_1h, round(t.median_interarrival + 1e-9, 2) as median_interarrival, round(t.burst_score, 4) as burst_score, t.velocity_ratio, t.history_count, round(t.baseline_stability, 4) as baseline_stability,
  n.ip_reuse_count, n.unique_addresses_per_ip, n.endpoint_recurrence, n.src_port_frequency, round(n.asn_concentration, 4) as asn_concentration,
  round(case when 1.4826 * e.mad > 1e-6 then abs(e.raw_out - e.med) / (1.4826 * e.mad) else 0 end, 4) as baseline_deviation,
  round(case when round(e.age, 2) >= 3600 and e.entity_tx_count >= 3 then case when (e.entity_tx_count - 1) * 3600 / round(e.age, 2) > 1e-4 then t.tx_count_1h / ((e.entity_tx_count - 1) * 3600 / round(e.age, 2)) else 1.0 end else 1.0 end, 4) as activity_change
  from rowg g join tmp t using (event_id) join net n using (event_id) join ent e using (event_id)""",
}


def ls(x: str, lo: float, hi: float) -> str:
    return f"greatest(0.0, least(1.0, (({x}) - {lo}) / {hi - lo}))"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_one = lambda c: f"coalesce(nullif({c}, 0), 1.0)"
_hub = [ls("ip_reuse_count", 2, 8), ls(_one("endpoint_recurrence"), 2, 6), ls(_one("unique_addresses_per_ip"), 2, 6), ls(_one("src_port_frequency"), 3, 15)]
DETECTORS = {
    "fan_in": f"0.55 * {ls('input_count', 4, 24)} + 0.30 * {ls('fan_in_ratio', .6, .9)} + 0.15 * is_consolidation_structure",
    "fan_out": f"0.50 * {ls('output_count', 4, 24)} + 0.30 * {ls('fan_out_ratio', .6, .9)} + 0.10 * is_dispersion_structure + 0.10 * round_amount_ratio",
    "equal_output": f"case when output_count >= 3 then 0.55 * {ls('equal_output_ratio', .5, .9)} + 0.25 * is_equal_split_structure + 0.10 * {ls('output_count', 3, 10)} + case when amount_cv < 0.5 then 0.10 * (1 - least(1.0, amount_cv)) else 0 end else 0 end",
    "peeling_like": f"case when input_count in (1, 2) and output_count = 2 then 0.60 * {ls('output_concentration', .6, .95)} + 0.40 * is_peeling_structure else 0 end",
    "mixing_like": f"case when input_count >= 3 and output_count >= 3 then 0.30 * {ls('input_count', 3, 8)} + 0.30 * {ls('output_count', 3, 10)} + 0.30 * {ls('equal_output_ratio', .45, .85)} + 0.10 * is_equal_split_structure else 0 end",
    "temporal_burst": f"case when tx_count_1h > 1 then 0.50 * {ls(_one('burst_score'), 1.5, 6)} + 0.35 * {ls(_one('velocity_ratio'), 1.5, 6)} + 0.15 * {ls('tx_count_5m', 3, 10)} else 0 end",
    "rapid_hop": f"case when history_count >= 1 and median_interarrival > 0 and median_interarrival <= 120 then 0.70 * {ls('120 - median_interarrival', 0, 110)} + 0.30 * {ls('tx_count_5m', 2, 6)} else 0 end",
    "baseline_deviation": f"case when baseline_stability >= 0.2 then (0.65 * {ls('baseline_deviation', 2, 8)} + 0.35 * {ls(_one('activity_change'), 2, 6)}) * baseline_stability else 0 end",
    "ip_reuse": f"0.60 * {ls('ip_reuse_count', 3, 20)} + 0.40 * {ls(_one('unique_addresses_per_ip'), 2, 8)}",
    "network_cluster": f"0.30 * {ls('asn_concentration', .7, 1.0)} + 0.45 * greatest({', '.join(_hub)}) + 0.25 * ({' + '.join(_hub)}) / 4",
    "endpoint_recurrence": f"0.75 * {ls(_one('endpoint_recurrence'), 3, 15)} + 0.25 * {ls('ip_reuse_count', 5, 20)}",
}
CATEGORY = {
    "structural": ("fan_in", "fan_out", "equal_output", "peeling_like", "mixing_like"),
    "temporal": ("temporal_burst", "rapid_hop", "baseline_deviation"),
    "network": ("ip_reuse", "network_cluster", "endpoint_recurrence"),
}
STEPS["raw"] = "select event_id, txid, ts_us, history_count, baseline_stability, " + ", ".join(f"{clamp(x)} as raw_{k}" for k, x in DETECTORS.items()) + " from feat"
STEPS["det"] = (
    "select event_id, txid, ts_us, "
    + ", ".join(f"round(raw_{k} + 1e-9, 4) as {k}, raw_{k} >= 0.5 as {k}_triggered" for k in DETECTORS)
    + ", "
    + ", ".join("greatest(" + ", ".join(f"round(raw_{d} + 1e-9, 4)" for d in ds) + f") as {c}_score" for c, ds in CATEGORY.items())
    + " from raw"
)
_FEATURE_CHAIN = ["lines", "ev", "c0", "c"]
ROWS = [*_FEATURE_CHAIN, "rowf", "rowg"]
LINEAGE = [*_FEATURE_CHAIN, "given", "taken", "par", "hop(event_id, hops)", "lin"]
TEMPORAL = [*LINEAGE, "tmp0", "tmp1", "tmp"]
NETWORK = [*_FEATURE_CHAIN, "net0", "net"]
ENTITY = [*_FEATURE_CHAIN, "given", "cpn", "ent0", "ent1", "ent"]
ALL = list(dict.fromkeys([*ROWS, *TEMPORAL, *NETWORK, *ENTITY, "feat"]))
DETECT = [*ALL, "raw", "det"]


def sql(steps: list[str], final: str, **more: str) -> str:
    named = {**STEPS, **more}
    return "with recursive " + ",\n".join(f"{k} as ({named[k]})" for k in [*steps, *more]) + "\n" + final
