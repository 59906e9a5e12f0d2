"""Exact top-k by inner product, with pivot elimination.

Vectors are integer: each component x is floor(256 x). ``pivots`` rows, chosen far apart from a bounded
sample, are the columns of a distance table, which is computed once and stored with the rows. By the
triangle inequality a query q and a row x are at least max over pivots |d(q, p) - d(x, p)| apart, and
as their inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2, that bounds it from above.

1. Rows and queries are dealt by their nearest pivot, and by hash, into blocks (pivots with few rows
   share one); of each block the range of its distances to every pivot is kept.
2. Each query meets one block near it: its k-th best score there is a first threshold, and the pair is done.
3. Pairs of a query block and a row block whose ranges are so far apart that no score can reach the
   least threshold of the block's queries are dropped whole; they are never sent anywhere.
4. In a remaining pair, queries that cannot reach their own threshold are left out; the others take rows
   in the order of their bounds until the bound falls below the k-th best score.

How much that spares depends on the data: vectors in groups spare nearly all, vectors spread evenly
over a sphere of 64 dimensions nothing, as all their distances are alike (figures in the README). Rows
are sent once for each query block that may need them: at worst n / ``row_block`` tasks for each of
n_queries / ``query_block`` blocks.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part;
shorter vectors count as padded with zeros; rows with a null id are no queries and, as ties need
an id, no candidates; a query's own row is every row with its id; of repeated query ids the smallest
vector asks; repeated candidate rows count each; an empty table gives no rows; scores that might
exceed a long raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, prepare

K, PIVOTS, QUERY_BLOCK, ROW_BLOCK, PIVOT_SAMPLE = 5, 48, 1024, 4096, 4000
OUT = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, *others: str) -> DataFrame:
    """vec_id, vec (array of long) and other columns of the rows that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return table.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).cast("array<bigint>").alias("vec"), *others
    )


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
    return np.sqrt(np.maximum(d, 0))


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x, each the farthest from those before it; the first is the farthest from the mean."""
    if not len(x):
        return x
    chosen = [int(_distances(x, x.mean(0, keepdims=True))[:, 0].argmax())]
    gap = _distances(x, x[chosen])[:, 0]
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(x, x[chosen[-1:]])[:, 0])
    rest, order = list(range(1, len(chosen))), [0]
    between = _distances(x[chosen], x[chosen])
    while rest:  # each is followed by the nearest of those left, so that numbers close to each other lie close
        order.append(min(rest, key=lambda i: (between[order[-1], i], i)))
        rest.remove(order[-1])
    return x[chosen][order]


def block_top_k(q_ids, q, dq, c_ids, c, dc, floor, k: int = K, step: int = 256):
    """(query row, candidate row, score) triples: the k best candidates of each query in the block.

    ``dq`` and ``dc`` are distances to the pivots, ``floor`` a score that the k-th best of each query
    is known to reach. Also the number of scores that were computed.
    """
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    qq, cc = (qf * qf).sum(1), (cf * cf).sum(1)
    if len(qq) and len(cc) and np.sqrt(qq.max() * cc.max()) >= 2.0**53:
        raise ValueError("inner products this large aren't exact")  # of doubles, in which they are computed
    best_s, best_c = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    kth, evaluated = floor.astype(np.float64), 0
    # the slack covers rounding in the distances; it can only keep more candidates
    slack = 1e-6 * (1 + qq + (cc.max() if len(cc) else 0))
    outside = np.maximum(dq - dc.max(0), dc.min(0) - dq).max(1, initial=0) if len(cc) else np.zeros(len(q))
    may = np.flatnonzero((qq + (cc.max() if len(cc) else 0) - outside**2) / 2 + slack >= kth)
    for lo in range(0, len(may), 128):  # a few queries at a time, for bounded memory
        at = may[lo : lo + 128]
        gap = np.zeros((len(at), len(c)))
        for j in range(dq.shape[1]):
            np.maximum(gap, np.abs(dq[at, j, None] - dc[None, :, j]), out=gap)
        bound = (qq[at, None] + cc[None, :] - gap * gap) / 2 + slack[at, None]
        order = np.argsort(-bound, 1, kind="stable")
        done = np.zeros(len(at), bool)
        for first in range(0, len(c), step):
            idx = order[:, first : first + step]
            done |= bound[np.arange(len(at)), idx[:, 0]] < kth[at]
            live = np.flatnonzero(~done)
            if not len(live):
                break
            rows, row = idx[live], at[live]
            s = np.einsum("ijd,id->ij", cf[rows], qf[row])
            evaluated += s.size
            s[c_ids[rows] == q_ids[row, None]] = -np.inf
            s_all = np.concatenate([best_s[row], s], 1)
            c_all = np.concatenate([best_c[row], rows], 1)
            id_all = np.where(c_all >= 0, c_ids[np.maximum(c_all, 0)], np.iinfo(np.int64).max)
            top = np.lexsort((id_all, -s_all), 1)[:, :k]
            best_s[row], best_c[row] = np.take_along_axis(s_all, top, 1), np.take_along_axis(c_all, top, 1)
            kth[row] = np.maximum(kth[row], best_s[row, -1])
    rows, cols = np.nonzero(best_s > -np.inf)
    return rows, best_c[rows, cols], best_s[rows, cols].astype(np.int64), evaluated


def with_distances(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` (with vec) with their squared norm, distances to the pivots and nearest pivot."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", norm double, dist array<double>, near int"

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vec"), width)
            d = _distances(x, pivots)
            dist = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(pivots), d.ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((x.astype(float) ** 2).sum(1)), dist, pa.array(d.argmin(1).astype(np.int32))],
                names=[*batch.schema.names, "norm", "dist", "near"],
            )

    return rows.mapInArrow(run, schema)


def _blocks(rows: DataFrame, size: int) -> dict[int, tuple[int, int]]:
    """nearest pivot -> (block, number of blocks from there): one row per pivot comes to the driver.

    Pivots with more rows than ``size`` have several blocks; neighbours with few share one.
    """
    out, block, held = {}, -1, size
    for r in sorted(rows.groupBy("near").count().collect()):
        n = r["count"]
        if n > size:
            out[r.near] = (block + 1, -(-n // size))
            block, held = block + -(-n // size), size
            continue
        if held + n > size:
            block, held = block + 1, 0
        out[r.near] = (block, 1)
        held += n
    return out


def _block(blocks: dict[int, tuple[int, int]], key: str) -> Column:
    """The block of a row, by its nearest pivot and a hash."""
    spots = F.lit(None).cast("struct<a: long, n: long>")
    for near, (first, n) in blocks.items():
        spots = F.when(F.col("near") == near, F.struct(F.lit(first).cast("long").alias("a"), F.lit(n).cast("long").alias("n"))).otherwise(spots)
    return spots["a"] + F.pmod(F.xxhash64(key), spots["n"])


def _ranges(rows: DataFrame, block: str, pivots: int) -> DataFrame:
    """Of each block: the largest norm, the least floor, and the range of distances to each pivot."""
    ends = [f(F.get("dist", F.lit(j))) for f in (F.min, F.max) for j in range(pivots)]
    names = [f"{n}{j}" for n in ("_lo", "_hi") for j in range(pivots)]
    flat = rows.groupBy(block).agg(F.max("norm").alias("norm"), F.min("floor").alias("floor"), *[e.alias(n) for e, n in zip(ends, names, strict=True)])
    return flat.select(block, "norm", "floor", F.array(*names[:pivots]).alias("lo"), F.array(*names[pivots:]).alias("hi"))


def search(
    vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, tally=None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of ``vectors`` (vec_id, vec) that asks.

    ``tally``: an accumulator that gets the number of scores computed.
    """
    prepare(vectors.sparkSession)
    plain = checkpoint(vectors.select("vec_id", "vec", F.monotonically_increasing_id().alias("place")))
    width = plain.agg(F.max(F.size("vec"))).first()[0] or 1
    sample = plain.orderBy(F.xxhash64("vec_id", "place"), "place").limit(PIVOT_SAMPLE).select("vec").toArrow()
    chosen = far_apart(_matrix(sample.column("vec"), width), pivots)
    rows = checkpoint(with_distances(plain, chosen, width))
    n_pivots, row_blocks = len(chosen), _blocks(rows, row_block)
    rows = rows.withColumn("rb", _block(row_blocks, "place"))
    asks = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("vec", "norm", "dist", "near")).alias("q")).select("query_id", "q.*")
    asks = checkpoint(asks)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        q_ids, c_ids = a.column("query_id").to_numpy(), b.column("vec_id").to_numpy()
        table = lambda t: np.array(t.column("dist").to_pylist(), float).reshape(t.num_rows, n_pivots)
        i, j, s, n = block_top_k(
            q_ids, _matrix(a.column("vec"), width), table(a), c_ids, _matrix(b.column("vec"), width), table(b), a.column("floor").to_numpy(), k
        )
        if tally is not None:
            tally.add(n)
        return pa.table({"query_id": q_ids[i], "vec_id": c_ids[j], "score": s})

    by = ["query_id", "vec", "dist", "floor"]
    asks = asks.withColumn("home", _block(row_blocks, "query_id"))
    near = asks.withColumn("rb", F.col("home")).withColumn("floor", F.lit(float("-inf")))
    first = near.select("rb", *by).groupBy("rb").cogroup(rows.select(F.col("rb").alias("to_rb"), "vec_id", "vec", "dist").groupBy("to_rb")).applyInArrow(meet, OUT)
    first = checkpoint(first)
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    asks = asks.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asks = checkpoint(asks.withColumn("qb", _block(_blocks(asks, query_block), "query_id")))
    if not row_blocks:
        return plain.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(max(a + n for a, n in row_blocks.values()) - 1).cast("long"))
    theirs = _ranges(rows.withColumn("floor", F.lit(0.0)), "rb", n_pivots).select("rb", F.col("norm").alias("r_norm"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    ours = _ranges(asks, "qb", n_pivots).withColumn("rb", F.explode(blocks))
    apart = F.array_max(F.concat(F.zip_with("lo", "r_hi", lambda x, y: x - y), F.zip_with("r_lo", "hi", lambda x, y: x - y), F.array(F.lit(0.0))))
    bound = (F.col("norm") + F.col("r_norm") - apart * apart) / 2 + 1e-6 * (1 + F.col("norm") + F.col("r_norm"))
    pairs = checkpoint(ours.join(theirs, "rb").where(bound >= F.col("floor")).select("qb", "rb"))
    met = (
        asks.select("qb", "home", *by).join(pairs, "qb").where("home <> rb").groupBy("qb", "rb")
        .cogroup(rows.select("rb", "vec_id", "vec", "dist").join(pairs, "rb").withColumnsRenamed({"qb": "to_qb", "rb": "to_rb"}).groupBy("to_qb", "to_rb"))
        .applyInArrow(meet, OUT)
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(met).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
