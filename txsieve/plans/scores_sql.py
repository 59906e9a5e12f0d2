"""DuckDB SQL of graph evidence, fusion and alert ranks, on top of the steps of the graph and the detectors.

The fixture's graph is connected, so the component of every node is what the smallest node reaches.
"""

from __future__ import annotations

from txsieve.operators.detectors import EVIDENCE as CUTS

from . import oracle

_MONEY = "edge_type in ('INPUT_TO', 'OUTPUT_TO')"
_CLAMP = oracle.clamp
_FIRED = {d: f"det.{d} >= 0.5" for d in oracle.DETECTORS}
_COMPONENT = {"structural": "graph", "temporal": "temporal", "network": "network"}
_OF = {d: _COMPONENT[k] for k, ds in oracle.CATEGORY.items() for d in ds}


def up4(x: str) -> str:
    return f"round(({x}) + 1e-9, 4)"


def _two(scores: str) -> str:
    """s1 + (1 - s1) s2 / 4 of the two highest of a list."""
    s = f"list_reverse_sort([{scores}])"
    return f"({s}[1] + (1 - {s}[1]) * 0.25 * {s}[2])"


def _list(conditions: dict[str, str]) -> str:
    items = ", ".join(f"case when {cond} then '{name}' end" for name, cond in conditions.items())
    return f"list_filter([{items}], lambda z: z is not null)"


_metrics = " union all ".join(
    f"select event_id, '{feature}' as metric from det join feat using (event_id) where {_FIRED[d]} and feat.{feature} >= {least}"
    for d, cuts in CUTS.items()
    for feature, least, _ in cuts
)
EVIDENCE = {
    "conn(n)": "select min(node_id) from ends union select e.other from conn join ends e on e.node_id = conn.n",
    "txnear": "select distinct node_id, other from ends where node_id in (select txid from gc) union select txid, txid from gc",
    "dens": """select node_id, round(coalesce(m, 0) / (n * (n - 1)), 6) as local_density from (select node_id, count(*) as n from txnear group by 1) left join (
    select a.node_id, count(distinct e.edge_id) as m from edge e join txnear a on a.other = e.source_id join txnear b on b.node_id = a.node_id and b.other = e.target_id group by 1) using (node_id)""",
    "best": "select a, max(s) as s from (select a, support_count as s from pairs union all select b, support_count from pairs) group by 1",
    "supp": "select spent.txid, max(s) as s from spent join best using (a) group by 1",
    "tlinks": "select node_id as txid, count(*) as n from ends where edge_type = 'TEMPORALLY_ASSOCIATED' group by 1",
    "cps": f"select node_id as txid, count(distinct other) as n from ends where {_MONEY} group by 1",
    "hop2": """select x.node_id as txid, count(distinct y.other) as n from (select node_id, other from txnear) x join
    (select distinct node_id, other from ends union select distinct node_id, node_id from ends) y on y.node_id = x.other group by 1""",
    "ev0": """select gc.event_id, gc.txid, degree, (select count(*) from conn) as component_size, local_density, coalesce(cps.n, 0) as unique_counterparties,
    coalesce(tlinks.n, 0) as temporal_links, case when len(ins) >= 2 then greatest(coalesce(supp.s, 1), 1) else 0 end as common_input_support, len(ins) as n_inputs, least(4, hop2.n) as nodes_2hop
    from gc join deg on deg.node_id = gc.txid join dens on dens.node_id = gc.txid join hop2 on hop2.txid = gc.txid
    left join supp on supp.txid = gc.txid left join tlinks on tlinks.txid = gc.txid left join cps on cps.txid = gc.txid""",
    "ev1": f"""select *, {_CLAMP('(degree - 2) / 18')} as n_deg, {_CLAMP('(component_size - 3) / 27')} as n_comp, {_CLAMP('local_density / 0.30')} as n_dens,
    case when n_inputs >= 2 then {_CLAMP('0.40 + 0.12 * common_input_support')} else 0.0 end as n_in, {_CLAMP('temporal_links / 5')} as n_temp from ev0""",
    "ev2": f"select *, {up4(_two('cast(n_deg as double), cast(n_comp as double), cast(n_dens as double), cast(n_in as double), cast(n_temp as double)'))} as composite from ev1",
    "evid": f"""select *, {up4(_CLAMP('0.50 * least(1.0, nodes_2hop / 4) + 0.30 * composite + 0.20 * least(1.0, degree / 4)'))} as support,
    3 + (case when n_inputs >= 2 then 1 else 0 end) + (case when temporal_links > 0 then 1 else 0 end) as n_items from ev2""",
}
FUSION = {
    "fu0": "select det.*, feat.baseline_stability, composite, support, n_items, case when len(c.amts) > 0 then 1.0 else 0.0 end as adc, round((13 + case when len(c.outs) > 0 then 2 else 0 end) / 15.0::double, 4) as fc, "
    + ", ".join(f"{_two(', '.join(f'det.{d}' for d in ds))} as s_{_COMPONENT[k]}" for k, ds in oracle.CATEGORY.items())
    + ", " + _list(dict(sorted(_FIRED.items()))) + " as triggers from det join feat using (event_id) join evid using (event_id) join c using (event_id)",
    "fu1": f"select *, {_CLAMP('case when s_graph > 0 then s_graph + (1 - s_graph) * 0.30 * composite else 0.60 * composite end')} as c_graph, s_temporal as c_temporal, s_network as c_network from fu0",
    "fu2": f"""select *, {up4(_CLAMP('0.25 * c_graph + 0.20 * c_temporal + 0.10 * c_network'))} as risk_score, """
    + _list({k: f"c_{k} >= 0.5 or " + " or ".join(f"{d} >= 0.5" for d in _OF if _OF[d] == k) for k in ("graph", "network", "temporal")}) + " as categories from fu1",
    "fum": f"select event_id, count(distinct metric) as n from ({_metrics}) group by 1",
    "fu3": """select fu2.*, cast(len(categories) as integer) as signal_count, coalesce(fum.n, 0) + n_items as n_evidence from fu2 left join fum using (event_id)""",
    "fu4": f"""select *, {up4(_CLAMP('0.25 * (0.4 * fc + 0.4 + 0.2 * adc) + 0.30 * (0.70 * signal_count / 4 + 0.30 * least(1.0, len(triggers) / 3)) + 0.20 * baseline_stability + 0.15 * support + 0.10'))} as confidence_score,
    case when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level,
    {up4('0.5 * least(1.0, n_evidence / 4) + 0.25')} as evidence_strength from fu3""",
    "fu5": f"select *, {up4('0.60 * risk_score + 0.20 * confidence_score + 0.10 * signal_count / 4 + 0.10 * evidence_strength')} as priority_score from fu4",
    "inv": """select *, row_number() over (order by priority_score desc, risk_score desc, confidence_score desc, txid, event_id) as rank from fu5""",
}
