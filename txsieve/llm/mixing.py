"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source is put into a pseudo-random order (by md5 of the id) and cut into blocks of
``block_rows`` documents. With integer weights q_i of sum Q, block k of source i may start at
slot floor(k Q / q_i) and is due by slot ceil((k + 1) Q / q_i). Earliest deadline first gives
every slot a block; after any number of slots each source is less than one block away from its
share. The schedule repeats every Q slots, so only one period is laid out, and block k of a source
takes slot (k div q) Q + slot(k mod q). Sources without a weight of their own have equal windows
and follow each other, so the period is laid out in runs of them: its size is that of the weights,
not of the number of sources, which stay a table.

A source that ends early leaves its later slots unused, so the others go on in the proportions
of their own weights. All documents are kept; ``mix_position`` numbers them without gaps.

Ranks and positions come from range partitions and their counts, so that no source, no repeated or
null id and no range of slots is gathered in one task.

Defined cases: a null source is a source of its own; sources without a weight get
``default_weight``; null ids come first in their source; repeated rows are kept, in any order among
themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BLOCK_ROWS, MAX_PERIOD = 16, 1 << 20


def period(weights: list[int]) -> list[tuple[int, int, int]]:
    """(weight's index, k, slot) of one period of sum(weights) slots: EDF over Pfair windows."""
    total, due, out = sum(weights), [], []
    released = [(0, i, 0) for i, q in enumerate(weights) if q > 0]
    heapq.heapify(released)
    for slot in range(total):
        while released and released[0][0] <= slot:
            _, i, k = heapq.heappop(released)
            heapq.heappush(due, (-(-(k + 1) * total // weights[i]), i, k))
        _, i, k = heapq.heappop(due)  # weights add up to the period: some block is always released
        out.append((i, k, slot))
        if k + 1 < weights[i]:
            heapq.heappush(released, ((k + 1) * total // weights[i], i, k + 1))
    return out


def runs(n: int, quota: int, named: list[tuple[int, int]]) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """The slots of period() where ``n`` sources share one quota: run lengths instead of a slot each.

    ``named`` are the other sources in order: (how many of the n come before it, its quota). Returns
    the slots of each named source, and runs (k, rank, slot): from that rank of the n on, block k takes
    consecutive slots, up to the next run of k. Both are as long as the quotas, whatever n is.
    """
    total = n * quota + sum(q for _, q in named)
    window = lambda k, q: (k * total // q, -(-(k + 1) * total // q))
    released = sorted(
        [(*window(k, q), first, 0, j, k) for j, (first, q) in enumerate(named) for k in range(q)]
        + [(*window(k, quota), 0, 1, 0, k) for k in range(quota if n else 0)]
    )
    slots, out, due, at, slot = [[] for _ in named], [], [], 0, 0
    while due or at < len(released):
        while at < len(released) and released[at][0] <= slot:
            heapq.heappush(due, released[at][1:])
            at += 1
        deadline, rank, shared, j, k = heapq.heappop(due)
        if not shared:
            slots[j].append(slot)
            slot += 1
            continue
        end = n  # the run ends where a named source is next in order, or where a release may change the choice
        if due and due[0][0] == deadline:
            end = min(end, due[0][1])
        if at < len(released):
            end = min(end, rank + released[at][0] - slot)
        out.append((k, rank, slot))
        slot += end - rank
        if end < n:
            heapq.heappush(due, (deadline, end, 1, 0, k))
    return slots, out


def numbered(df: DataFrame, groups: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by range, with ``_at`` and ``_part``; and a ``_shift`` for each group and part.

    ``_at`` + ``_shift`` numbers the rows of a group from 0. Parts are ranges of groups and ``order``, so
    with an order that has no ties no group or key gathers in one task; only parts' counts are added up.
    """
    keys = [*(F.asc_nulls_first(g) for g in groups), *order]
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = checkpoint(laid).withColumn("_part", F.shiftright("_at", 33))
    totals = laid.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return laid, totals.select(*groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))


def schedule(sources: DataFrame, weights: dict[str, int], default_weight: int = 1) -> tuple[DataFrame, int]:
    """_source, _quota and _slots (of one period) of each distinct source; and the period.

    Sources stay a table. Those with a weight of their own, a parameter's number, go to the driver.
    """
    spark = sources.sparkSession
    laid, shifts = numbered(sources, [], [F.asc_nulls_first("source")])
    ranked = checkpoint(laid.join(F.broadcast(shifts), "_part").select("source", (F.col("_at") + F.col("_shift")).alias("_rank")))
    own = F.coalesce(F.col("source").isin([s for s in weights if s is not None]), F.lit(None in weights))
    named = [(r.source, r["_rank"], int(weights[r.source])) for r in ranked.where(own).orderBy("_rank").collect()]
    n = ranked.count() - len(named)
    quotas = [q for *_, q in named] + [int(default_weight)] * (n > 0)
    if any(q <= 0 for q in quotas):
        raise ValueError("weights must be positive")
    if sum(quotas) > MAX_PERIOD:
        raise ValueError(f"weights that add up to {sum(quotas)}; at most {MAX_PERIOD}")
    slots, shared = runs(n, int(default_weight), [(rank - j, q) for j, (_, rank, q) in enumerate(named)])
    first = spark.createDataFrame([(s, q, x) for (s, _, q), x in zip(named, slots, strict=True)], "_source string, _quota long, _slots array<long>")
    if not n:
        return first, max(1, sum(quotas))
    table = spark.createDataFrame([([rank for _, rank, _ in named], sorted(shared))], "_named array<long>, _runs array<struct<k: long, rank: long, slot: long>>")
    rank = F.col("_rank") - F.size(F.filter("_named", lambda x: x < F.col("_rank")))
    run = lambda k: F.element_at(F.filter("_runs", lambda x: (x.k == k) & (x.rank <= F.col("_rank"))), -1)
    rest = (
        ranked.where(~own)
        .crossJoin(F.broadcast(table))
        .withColumn("_rank", rank)
        .select(
            F.col("source").alias("_source"),
            F.lit(int(default_weight)).cast("long").alias("_quota"),
            F.transform(
                F.sequence(F.lit(0), F.lit(int(default_weight) - 1)), lambda k: run(k)["slot"] + F.col("_rank") - run(k)["rank"]
            ).alias("_slots"),
        )
    )
    return first.unionByName(rest), n * int(default_weight) + sum(q for *_, q in named)


def mix(
    docs: DataFrame,
    weights: dict[str, int],
    default_weight: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """doc_id, source, mix_block, mix_slot and mix_position of each row of ``docs``.

    Weights are positive integers, a parameter; their common divisor is taken out, and those of the
    named sources and the default weight then add up to MAX_PERIOD at most. The number of sources and
    of rows has no limit.
    """
    rows = checkpoint(docs.select("doc_id", "source", F.monotonically_increasing_id().alias("_row")))
    return _positions(rows, weights, default_weight, block_rows).drop("_row")


def _positions(rows: DataFrame, weights: dict[str, int], default_weight: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The columns of mix() for rows of doc_id, source and ``_row``, a number that no two rows share."""
    if all(w > 0 for w in (*weights.values(), default_weight)):
        common = math.gcd(*weights.values(), default_weight)
        weights, default_weight = {k: w // common for k, w in weights.items()}, default_weight // common
    key = F.md5(F.col("doc_id").cast("string"))
    order = [F.asc_nulls_first("_key"), F.asc_nulls_first("doc_id"), F.asc("_row")]
    laid, shifts = numbered(rows.withColumn("_key", key), ["source"], order)
    shifts = checkpoint(shifts)
    plan, total = schedule(shifts.select("source").distinct(), weights, default_weight)
    # the plan goes to the parts of a source, not to its rows: no join gathers the rows of a source
    parts = checkpoint(
        shifts.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
            F.col("_part").alias("_p"), "_source", "_shift", "_quota", "_slots"
        )
    )
    if (parts.agg(F.sum("_quota")).first()[0] or 0) <= MAX_PERIOD:
        parts = F.broadcast(parts)
    placed = (
        laid.join(parts, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_place", F.col("_at") + F.col("_shift"))
        .withColumn("mix_block", F.floor(F.col("_place") / block_rows).cast("long"))
        .withColumn(
            "mix_slot",
            F.floor(F.col("mix_block") / F.col("_quota")).cast("long") * total
            + F.element_at("_slots", (F.col("mix_block") % F.col("_quota") + 1).cast("int")),
        )
        .withColumn("_in_block", F.col("_place") % block_rows)
    )
    # all rows of a slot are one block; slots in order are the mix
    columns = ["doc_id", "source", "mix_block", "mix_slot", "_in_block", "_row"]
    spread, ahead = numbered(placed.select(*columns), [], [F.asc("mix_slot"), F.asc("_in_block")])
    return (
        spread.join(F.broadcast(ahead), "_part")  # a row per partition
        .withColumn("mix_position", (F.col("_at") + F.col("_shift")).cast("long"))
        .select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "_row")
    )


def mixed(docs: DataFrame, weights: dict[str, int], **settings) -> DataFrame:
    """All columns of ``docs``, with rows laid out in the order of the mix (range-partitioned).

    Rows are numbered first, and the numbers fixed in the shared folder; positions are joined to the
    rows by number, so repeated rows and null ids neither multiply, vanish nor gather in one task.
    """
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = checkpoint(docs)
    spots = _positions(rows.select("doc_id", "source", "_row"), weights, **settings).select("_row", F.col("mix_position").alias("_spot"))
    return rows.join(spots, "_row").repartitionByRange("_spot").sortWithinPartitions("_spot").drop("_row", "_spot")


def laid_out(docs: DataFrame) -> DataFrame:
    """``docs``, read from the Parquet files that mixed() was written to, with ``mix_position``.

    Spark reads files by size, not by name, so the order comes from the names: part numbers follow
    the range partitions, and rows of a file keep their order. Only the files' row counts are added up.
    """
    file, number = F.col("_metadata.file_path"), lambda p: F.regexp_extract("_file", p, 1).try_cast("long")
    totals = docs.groupBy(file.alias("_file")).agg((F.max("_metadata.row_index") + 1).alias("_n"))
    before = Window.orderBy(number(r"part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/]*$"), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = docs.select("*", file.alias("_path"), F.col("_metadata.row_index").alias("_index"))
    return (
        rows.join(F.broadcast(starts), F.col("_path") == F.col("_file"))
        .withColumn("mix_position", F.col("_start") + F.col("_index"))
        .select(*docs.columns, "mix_position")
    )


def mix_oracle(weights: dict[str, int], default_weight: int = 1, block_rows: int = BLOCK_ROWS) -> str:
    """DuckDB SQL for (doc_id, source, mix_block, mix_slot, mix_position): EDF slot by slot."""
    cases = " ".join(f"when source = '{s}' then {w}" for s, w in weights.items())
    q = f"case {cases} else {default_weight} end" if cases else str(default_weight)
    return f"""
with recursive src as (
  select source, cast({q} as bigint) as q, row_number() over (order by source nulls first) as i
  from (select distinct source from documents)),
tot as (select cast(sum(q) as bigint) as total, max(i) as n, list(q order by i) as qs from src),
sim(slot, done, pick, k) as (
  select cast(-1 as bigint), (select list_transform(qs, lambda x: cast(0 as bigint)) from tot), cast(0 as bigint), cast(0 as bigint)
  union all
  select slot + 1,
    list_transform(done, lambda d, j: case when j = best then d + 1 else d end),
    best, done[best]
  from (
    select slot, done, (
      list_sort(list_filter(list_transform(done, lambda d, j: case
          when d < qs[j] and (d * total) // qs[j] <= slot + 1
          then ((((d + 1) * total + qs[j] - 1) // qs[j]) * 1000000 + j) end), lambda v: v is not null))[1] % 1000000) as best
    from sim, tot where slot + 1 < total) s),
slots as (select pick as i, k, slot from sim where slot >= 0),
placed as (
  select doc_id, source, (row_number() over (partition by source order by md5(cast(doc_id as varchar)) nulls first, doc_id nulls first) - 1) as place
  from documents),
blocks as (
  select p.doc_id, p.source, p.place % {block_rows} as inb, p.place // {block_rows} as b, s.q, s.i
  from placed p join src s on p.source is not distinct from s.source),
slotted as (
  select doc_id, source, b, inb, (b // q) * (select total from tot) + sl.slot as slot
  from blocks join slots sl on sl.i = blocks.i and sl.k = b % q)
select doc_id, source, cast(b as bigint) as mix_block, cast(slot as bigint) as mix_slot,
  cast(row_number() over (order by slot, inb) - 1 as bigint) as mix_position
from slotted"""
