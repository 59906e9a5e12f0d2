"""Running sums, neighbours and order statistics of keys, spread over tasks whatever the keys hold.

The total order (time, late, txid, event id) is cut into ``parts`` of about equal size at sampled rows. A scan
is then two-level: sums inside each (key, part), and a carry per (key, part) from the parts before, which is
a window over one row per key and part. Rows are shuffled once, by (key, part), so a key with half of
all rows lies in as many tasks as there are parts.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import deque
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txsieve.functions.session import prepare

ORDER = ("ts_us", "txid", "event_id")
EVENT_ORDER = ("ts_us", "late", "txid", "event_id")
SAMPLE_PER_PART, MOST_PARTS, CELLS_PER_PART, BLOCK = 32, 1024, 16, 4096
_SPLIT = "array<struct<ts_us:bigint,late:int,txid:string,event_id:string>>"


class Parts:
    """Cuts of the total order; a bounded sample (32 rows a part) comes to the driver."""

    def __init__(self, rows: DataFrame, parts: int | None = None):
        n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(2, min(n, MOST_PARTS))
        picked = rows.select(*ORDER).orderBy(F.xxhash64("event_id", "txid"), "ts_us").limit(n * SAMPLE_PER_PART).collect()
        sample = sorted({(r.ts_us, 0, r.txid or "", r.event_id or "") for r in picked})
        cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
        self.count = len(cuts) + 1
        self.last = rows.agg(F.max("ts_us")).first()[0]  # when the last of these rows is
        self._times = [c[0] for c in cuts]
        self._cuts = json.dumps([dict(zip(EVENT_ORDER, c, strict=True)) for c in cuts])

    def column(self, late: Column | int = 0) -> Column:
        """The part of a row of ``EVENT_ORDER``: by its time where no cut is near, else a binary search in the cuts."""
        if not self._times or None in self._times:
            return self._searched(late)
        low, high = self._times[0], self._times[-1]
        width = (high - low) // (CELLS_PER_PART * self.count) + 1
        begins = [low + i * width for i in range((high - low) // width + 2)]
        below = [bisect_left(self._times, t) for t in begins]  # cuts before each cell
        cells = ",".join(str(x if x == y else -1) for x, y in pairwise(below))
        cell = F.get(F.split(F.lit(cells), ",").cast("array<int>"), F.expr(f"cast((ts_us - {low}L) div {width}L as int)"))
        by_time = F.when(F.col("ts_us") < low, 0).when(F.col("ts_us") > high, self.count - 1).otherwise(F.when(cell >= 0, cell))
        return F.coalesce(by_time, self._searched(late))

    def _searched(self, late: Column | int) -> Column:
        cuts = F.from_json(F.lit(self._cuts), _SPLIT)
        key = F.struct(F.col("ts_us"), (F.lit(late) if isinstance(late, int) else late).cast("int").alias("late"), F.coalesce("txid", F.lit("")).alias("txid"), F.coalesce("event_id", F.lit("")).alias("event_id"))
        steps = [1 << i for i in range(self.count.bit_length() - 1, -1, -1)]
        step = lambda at, s: F.when(F.get(cuts, at + s - 1) <= key, at + s).otherwise(at)
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def scan(rows: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, order=ORDER, first: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` (which have ``part``) with running sums, and values of the rows before and after, of the same keys.

    ``sums``: name -> what is added up, the row included; ``before``, ``after``: name -> column; ``first``: name -> what the
    first row of the keys says. ``rows`` are read twice: give written ones, or a scan on a scan doubles all below it.
    """
    sums, before, after, first = sums or {}, before or {}, after or {}, first or {}
    here = [*keys, "part"]
    inside = Window.partitionBy(*here).orderBy(*order)
    place = F.struct(*order)
    totals = rows.groupBy(*here).agg(
        F.count(F.lit(1)).alias("_size"),
        *[F.sum(x).alias(f"_sum_{n}") for n, x in sums.items()],
        *[F.max_by(c, place).alias(f"_last_{n}") for n, c in before.items()],
        *[F.min_by(c, place).alias(f"_first_{n}") for n, c in after.items()],
        *[F.min_by(x, place).alias(f"_head_{n}") for n, x in first.items()],
    )
    across = Window.partitionBy(*keys).orderBy("part")
    carries = totals.select(
        *here,
        *[F.sum(f"_sum_{n}").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_sum_{n}") for n in sums],
        *[F.lag(f"_last_{n}").over(across).alias(f"_last_{n}") for n in before],
        *[F.lead(f"_first_{n}").over(across).alias(f"_first_{n}") for n in after],
        *[F.first(f"_head_{n}").over(across).alias(f"_head_{n}") for n in first],
    ).repartition(*here)  # as the rows are: by keys alone, a hot key's rows would meet again
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {n: F.sum(x).over(upto) for n, x in sums.items()} | {n: F.lag(c).over(inside) for n, c in before.items()} | {n: F.lead(c).over(inside) for n, c in after.items()}
    )
    rows = rows.join(carries.hint("merge"), here)  # both lie by these keys, in order; a broadcast would pass through the driver
    given = {n: F.col(n) + F.coalesce(f"_sum_{n}", F.lit(0)) for n in sums}
    given |= {n: F.coalesce(n, f"_last_{n}") for n in before} | {n: F.coalesce(n, f"_first_{n}") for n in after}
    given |= {n: F.col(f"_head_{n}") for n in first}
    return rows.withColumns(given).drop(*[c for c in carries.columns if c not in here])


def trailing(rows: DataFrame, key: str, spans: dict[str, tuple[int, Column, Column | None]], parts: Parts) -> DataFrame:
    """(event_id, name, ...): sums over the same key in [ts_us - span, ts_us], up to each row.

    ``spans``: name -> (span, what a row adds, what it takes away when its time is up; the same if None).
    Arrivals less departures, summed up in order; a departure comes after the arrivals of its instant, and none is made
    after the last of the rows that ``parts`` were cut from, which ``rows`` are of.
    """
    zero = {n: (0 * x) for n, (_, x, _) in spans.items()}
    come = [x.alias(n) for n, (_, x, _) in spans.items()]
    events = rows.select(*ORDER, F.col(key).alias("k"), F.lit(0).alias("late"), *come)
    for span in sorted({s for s, *_ in spans.values()}):
        go = [((-(x if y is None else y)) if s == span else zero[n]).alias(n) for n, (s, x, y) in spans.items()]
        left = rows.where(F.col("ts_us") <= parts.last - span) if parts.last is not None else rows
        events = events.unionByName(left.select((F.col("ts_us") + span).alias("ts_us"), "txid", "event_id", F.col(key).alias("k"), F.lit(1).alias("late"), *go))
    events = events.where("k is not null").withColumn("part", parts.column(F.col("late")))
    summed = scan(events, ["k"], {f"_r_{n}": F.col(n) for n in spans}, order=EVENT_ORDER)
    return summed.where("late = 0").select("event_id", *[F.col(f"_r_{n}").alias(n) for n in spans])


def gathered(tables: list[DataFrame], key: str = "event_id") -> DataFrame:
    """One row per key with the columns of all tables (one row per key at most in each): one shuffle for all."""
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return both.groupBy(key).agg(*[F.max(c).alias(c) for c in both.columns if c != key])


class Sorted:
    """A multiset of the latest ``size`` values, by rank: a sorted list with bisection, and the order of arrival."""

    def __init__(self, size: int):
        self.size, self.ranked, self.queue = size, [], deque()

    def add(self, x: float) -> float:
        """The value that leaves for x; 0 if none does."""
        insort(self.ranked, x)
        self.queue.append(x)
        if len(self.queue) <= self.size:
            return 0
        old = self.queue.popleft()
        del self.ranked[bisect_left(self.ranked, old)]
        return old

    def median(self) -> float | None:
        r, n = self.ranked, len(self.ranked)
        return (r[(n - 1) // 2] + r[n // 2]) / 2 if n else None

    def deviation(self, middle: float) -> float:
        """The median of the distances from ``middle``."""
        n = len(self.ranked)
        a = self._distance(middle, (n - 1) // 2)
        return a if n % 2 else (a + self._distance(middle, n // 2)) / 2

    def _distance(self, middle: float, k: int) -> float:
        """The k-th least distance (from 0): the nearest k + 1 values are neighbours, found by bisection."""
        r, n = self.ranked, len(self.ranked)
        lo, hi = 0, n - k - 1  # where these begin
        while lo < hi:
            at = (lo + hi) // 2
            if middle - r[at] > r[at + k + 1] - middle:
                lo = at + 1
            else:
                hi = at
        return max(abs(middle - r[lo]), abs(r[lo + k] - middle))


def histories(rows: DataFrame, key: str, gaps: int = 100, amounts: int = 200, block: int = BLOCK) -> DataFrame:
    """event_id, gap_mean, gap_median (seconds), amount_median, amount_mad of rows with k, gap_us and amount.

    Gaps: the latest ``gaps`` rows, this one included; amounts: the ``amounts`` rows before it. k numbers the rows of a
    key. A block of a key's rows also gets the rows that its windows reach back to, so each row is sent once
    or twice and no task holds a key; in a partition blocks are read in order, with two windows in memory.
    """
    prepare(rows.sparkSession)
    halo = max(gaps, amounts)
    block = max(block, halo)
    own = F.floor((F.col("k") - 1) / block)
    again = (F.col("k") - 1) % block >= block - halo
    sent = rows.select("event_id", F.col(key).alias("key"), "k", "gap_us", "amount", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"))
    sent = sent.withColumn("mine", F.col("block") == own).repartition("key", "block").sortWithinPartitions("key", "block", "k")

    def run(batches):
        at, near, far, total = None, None, None, 0
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            columns = [batch.column(n).to_pylist() for n in ("event_id", "key", "block", "gap_us", "amount", "mine")]
            for event, name, number, gap, amount, mine in zip(*columns, strict=True):
                if at != (name, number):
                    at, near, far, total = (name, number), Sorted(gaps), Sorted(amounts), 0
                if gap is not None:  # only a key's first row has none
                    total += gap - near.add(gap)
                if mine:
                    n = len(near.ranked)
                    middle, center = near.median(), far.median()
                    values = (event, total / n / 1e6 if n else None, None if middle is None else middle / 1e6, center, far.deviation(center) if len(far.ranked) >= 2 else None)
                    for o, v in zip(out, values, strict=True):
                        o.append(v)
                far.add(amount)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(o, pa.float64()) for o in out[1:]]], names=["event_id", "gap_mean", "gap_median", "amount_median", "amount_mad"])

    return sent.mapInArrow(run, "event_id string, gap_mean double, gap_median double, amount_median double, amount_mad double")
