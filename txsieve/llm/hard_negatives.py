"""Hard negatives by inner product, with LEMP-style pruning on coordinates.

Vectors are integer: each component x is floor(256 x). An anchor's positives are its best rows of the
same label; for each, the negatives are the best rows of other labels whose score lies in a window that the
positive's score gives. Both are searches over all rows, which prune in this way (after Teflioudi et al. 2015):

1. Rows lie in length buckets: classes whose lengths differ by at most a tenth, cut by hash into buckets of about
   ``BUCKET_ROWS``. Labels are dealt to ``LANES``, so that a search for the same label meets one lane only.
2. A bucket holds, for each coordinate, its rows sorted by the coordinate of their direction. A score of at
   least f needs a cosine of at least t = f / (|q| longest); the direction's coordinate j must then lie within
   arccos t of the anchor's, as an angle. For the ``FOCUS`` largest coordinates of the anchor these ranges are
   looked up in the sorted lists, and only rows that lie in all of them are verified, exactly.
3. Each block of anchors first meets one bucket, whose results give f: the least score that can still
   be among the first. Buckets that can't reach it for any anchor of the block are never sent; the
   bucket that was met is not met again.

What that spares depends on the data: much for vectors in groups or of unequal lengths, little for directions
spread evenly over many dimensions (figures in the README). The anchors are a fixed share of the rows, so work is
anchors x rows at worst, in blocks of ``ANCHOR_BLOCK`` x ``BUCKET_ROWS``; no task holds more than one of each.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
of rows with one id the one with the least label and vector stands for it; shorter vectors count as padded with zeros;
vectors of zeros score 0 with all; an anchor alone in its label has no positives, and gives no rows; a positive score
below 0 has an empty window; an empty table gives no rows; scores that might pass 2^53 raise an error.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, prepare
from .topk_search import _matrix, integer_vectors

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
LANES, BUCKET_ROWS, ANCHOR_BLOCK, FOCUS, CLASSES_PER_DOUBLING = 16, 4096, 1024, 4, 8
FOUND = "anchor_id long, positive_id long, vec_id long, score long"


class Bucket:
    """Rows of similar length, with the sorted lists of their directions' coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, vectors.astype(np.float64)
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.longest, self.shortest = self.length.max(initial=0.0), self.length.min(initial=np.inf)
        self.direction = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.order = np.argsort(self.direction, 0, kind="stable")
        self.sorted = np.take_along_axis(self.direction, self.order, 0)

    def feasible(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Rows that may score ``floor`` or more with q: those within the ranges of all focus coordinates."""
        every, size = np.arange(len(self.ids)), math.sqrt(q @ q)
        if floor == -np.inf or not len(every):
            return every
        scale = size * (self.longest if floor > 0 else self.shortest)
        if scale == 0:
            return every if floor <= 0 else every[:0]
        cosine = floor / scale - 1e-9  # the slack covers rounding; it can only let more through
        if cosine > 1:
            return every[:0]
        if cosine <= -1:
            return every
        turn = math.acos(cosine)
        hits = np.zeros(len(every), np.int8)
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        for j in focus.tolist():
            angle = math.acos(max(-1.0, min(1.0, q[j] / size)))
            low, high = math.cos(min(math.pi, angle + turn)) - 1e-9, math.cos(max(0.0, angle - turn)) + 1e-9
            a, b = np.searchsorted(self.sorted[:, j], low, "left"), np.searchsorted(self.sorted[:, j], high, "right")
            hits[self.order[a:b, j]] += 1
        return np.flatnonzero(hits == len(focus))


def probe(bucket: Bucket, anchor_id: int, label, q: np.ndarray, windows: list[tuple[float, float, float]], k: int, same: bool):
    """(window, row, score) of the k best rows in each (low, high, floor) window, and the number of scores computed."""
    live = [(i, max(lo, floor), hi) for i, (lo, hi, floor) in enumerate(windows) if max(lo, floor) <= hi]
    if not live:
        return [], 0
    rows = bucket.feasible(q, min(f for _, f, _ in live))
    rows = rows[((bucket.labels[rows] == label) == same) & (bucket.ids[rows] != anchor_id)]
    score, out = bucket.x[rows] @ q, []
    for i, floor, hi in live:
        fit = np.flatnonzero((score >= floor) & (score <= hi))
        if len(fit) > k:  # no more than can be among the first, with all ties at the edge
            fit = fit[score[fit] >= -np.partition(-score[fit], k - 1)[k - 1]]
        best = fit[np.lexsort((bucket.ids[rows[fit]], -score[fit]))[:k]]
        out += [(i, int(rows[j]), int(score[j])) for j in best.tolist()]
    return out, len(rows)


def _shape(rows: DataFrame, size: int) -> list[tuple[int, int, float, int, int]]:
    """(lane, class, longest, first bucket, buckets) of each lane and class of length: a bounded number of rows."""
    out, first = [], 0
    counts = rows.groupBy("lane", "class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy("lane", F.desc("class")).collect()
    for r in counts:
        out.append((r.lane, r["class"], r.longest, first, -(-r.n // size)))
        first += out[-1][-1]
    return out


def _cells(shape) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("lane", "class", "longest", "first", "n"), strict=True)]) for s in shape])


def _search(asks: DataFrame, rows: DataFrame, shape, k: int, same: bool, width: int, tally) -> DataFrame:
    """The k best rows of each window of each anchor.

    ``asks``: anchor_id, label, lane, vec, length, windows (array of structs positive_id, low, high), block.
    """
    cells = _cells(shape)
    mine = lambda c: (c["lane"] == F.col("lane")) if same else F.lit(True)
    schema = FOUND

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        bucket = Bucket(b.column("vec_id").to_numpy(), np.array(b.column("its").to_pylist()), _matrix(b.column("row"), width))
        q = _matrix(a.column("vec"), width).astype(np.float64)
        longest = math.sqrt((q * q).sum(1).max(initial=0.0))
        if longest * bucket.longest >= 2.0**53:
            raise ValueError("inner products this large aren't exact")  # of doubles, in which they are computed
        out: list[list] = [[], [], [], []]
        for anchor, label, vector, windows in zip(a.column("anchor_id").to_pylist(), a.column("label").to_pylist(), q, a.column("windows").to_pylist(), strict=True):
            spans = [(w["low"], w["high"], w["floor"]) for w in windows]
            found, n = probe(bucket, anchor, label, vector, spans, k, same)
            if tally is not None:
                tally.add(n)
            for i, row, score in found:
                for o, v in zip(out, (anchor, windows[i]["positive_id"], int(bucket.ids[row]), score), strict=True):
                    o.append(v)
        return pa.table({n: pa.array(o, pa.int64()) for n, o in zip(("anchor_id", "positive_id", "vec_id", "score"), out, strict=True)})

    def met(pairs: DataFrame, asks: DataFrame) -> DataFrame:
        """``pairs``: block and bucket, each once."""
        left = asks.join(pairs, "block").groupBy("block", "bucket")
        right = rows.join(pairs.withColumnRenamed("block", "to_block"), "bucket").select("to_block", F.col("bucket").alias("to_bucket"), "vec_id", F.col("label").alias("its"), F.col("vec").alias("row"))
        return left.cogroup(right.groupBy("to_block", "to_bucket")).applyInArrow(meet, schema)

    # every block with its reach: the buckets that hold its lanes, or all
    blocks = asks.groupBy("block").agg(F.max("lane").alias("lane"), F.max("length").alias("length"))
    ids = F.flatten(F.transform(F.filter(cells, mine), lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    opening = blocks.withColumn("ids", ids).where(F.size("ids") > 0).select("block", F.get("ids", F.pmod(F.xxhash64("block"), F.size("ids")).cast("int")).alias("bucket"))
    opening = checkpoint(opening)
    free = asks.withColumn("windows", F.transform("windows", lambda w: F.struct(w["positive_id"].alias("positive_id"), w["low"].alias("low"), w["high"].alias("high"), F.lit(float("-inf")).alias("floor"))))
    first = checkpoint(met(opening, free))
    floors = first.groupBy("anchor_id", "positive_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    floors = floors.where("floor is not null").groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", "floor"))).alias("floors"))
    known = lambda w: F.coalesce(F.try_element_at("floors", w["positive_id"]), F.lit(float("-inf")))
    bounded = asks.join(floors, "anchor_id", "left").withColumn(
        "windows", F.transform("windows", lambda w: F.struct(w["positive_id"].alias("positive_id"), w["low"].alias("low"), w["high"].alias("high"), known(w).alias("floor")))
    )
    # a window is dead when its floor passes its end; an anchor without live windows asks no more
    least = F.array_min(F.transform(F.filter("windows", lambda w: F.greatest(w["low"], w["floor"]) <= w["high"]), lambda w: F.greatest(w["low"], w["floor"])))
    bounded = checkpoint(bounded.withColumn("least", least).where("least is not null").drop("floors"))
    # the longest row that a block needs: below it no anchor of the block can reach its floor
    need = F.min(F.when(F.col("least") > 0, F.col("least") / F.col("length")).otherwise(0.0)) * (1 - 1e-9)
    reach = bounded.groupBy("block").agg(F.max("lane").alias("lane"), need.alias("need"))
    ids = F.flatten(F.transform(F.filter(cells, lambda c: mine(c) & (c["longest"] >= F.col("need"))), lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    rest = reach.select("block", F.explode(ids).alias("bucket")).join(opening.withColumnRenamed("bucket", "met"), "block").where("bucket <> met").select("block", "bucket")
    rest = checkpoint(rest)
    return first.unionByName(met(rest, bounded.drop("least")))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    bucket_rows: int = BUCKET_ROWS, anchor_block: int = ANCHOR_BLOCK, tally=None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, vec. ``low`` and ``high``: ends of the window in hundredths of the positive's score.
    ``tally``: an accumulator that gets the number of scores computed.
    """
    spark = prepare(vectors.sparkSession)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    cls = F.when(F.col("length") > 0, F.floor(F.log2("length") * CLASSES_PER_DOUBLING)).otherwise(F.lit(-1)).cast("int")
    one = vectors.where("vec_id is not null and label is not null and size(vec) > 0").groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    plain = one.select("vec_id", "r.label", "r.vec").withColumn("length", length).withColumn("class", cls)
    plain = checkpoint(plain.withColumn("lane", F.pmod(F.xxhash64("label"), F.lit(LANES)).cast("int")))
    shape = _shape(plain, bucket_rows)
    if not shape:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = plain.agg(F.max(F.size("vec"))).first()[0]
    at = F.element_at(F.filter(_cells(shape), lambda c: (c["lane"] == F.col("lane")) & (c["class"] == F.col("class"))), 1)
    rows = checkpoint(plain.withColumn("_c", at).withColumn("bucket", (F.col("_c.first") + F.pmod(F.xxhash64("vec_id"), F.col("_c.n"))).cast("int")).drop("_c"))
    anchors = plain.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "lane", "vec", "length")
    n_by_lane = {r.lane: -(-r["count"] // anchor_block) for r in anchors.groupBy("lane").count().collect()}  # at most LANES rows
    n_all = max(1, -(-anchors.count() // anchor_block))
    lane_blocks = F.get(F.array(*[F.lit(max(1, n_by_lane.get(i, 1))) for i in range(LANES)]), "lane")
    hashed = F.xxhash64(F.lit(5), "anchor_id")
    window = lambda p, lo, hi: F.struct(p.cast("long").alias("positive_id"), lo.cast("double").alias("low"), hi.cast("double").alias("high"))
    asks = anchors.withColumn("block", (F.col("lane") + LANES * F.pmod(hashed, lane_blocks)).cast("long"))
    asks = checkpoint(asks.withColumn("windows", F.array(window(F.lit(0), F.lit(float("-inf")), F.lit(float("inf"))))))
    best = checkpoint(_ranked(_search(asks, rows, shape, positives, True, width, tally), ["anchor_id"], positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    ends = F.collect_list(window(F.col("positive_id"), F.ceil(F.expr(f"cast({low} * positive_score as decimal(38, 0)) / 100")), F.floor(F.expr(f"cast({high} * positive_score as decimal(38, 0)) / 100"))))
    wanted = best.where(p >= 0).groupBy("anchor_id").agg(ends.alias("windows"))
    asks = checkpoint(anchors.join(wanted, "anchor_id").withColumn("block", F.pmod(hashed, F.lit(n_all)).cast("long")))
    found = _ranked(_search(asks, rows, shape, negatives, False, width, tally), ["anchor_id", "positive_id"], negatives)
    return found.join(best, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def labelled_vectors(table: DataFrame) -> DataFrame:
    """vec_id, label and integer vec of the rows that take part; where 7 divides the id, the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = table.where("label is not null").select("vec_id", "embedding", label.cast("long").alias("label"))
    return integer_vectors(kept, "label")


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select * from v qualify row_number() over (partition by vec_id order by label, v) = 1),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    cast(list_sum(list_transform(list_zip(a.v, c.v), lambda t: t[1] * t[2])) as bigint) as score
  from u a join u c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same
  where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
