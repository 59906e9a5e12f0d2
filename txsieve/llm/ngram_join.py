"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts are sets of five-word shingles; two documents are linked if their Jaccard similarity is at
least 0.8. Rows with equal sets form a class, which is compared once.

1. One pass over the texts gives each document a 128-bit digest of its set and, from MinHash
   values, ``bands`` band keys. A pair at the threshold shares a band with probability
   1 - (1 - 0.8 ** rows) ** bands = 0.99994.
2. Class representatives that share a band key are joined to the smallest one in it (a star, not
   all pairs). Connected components of the stars bound the comparison: linked pairs that share a
   band lie in one component.
3. Representatives of a component are dealt into cells by set size (classes of ratio 1 / 0.8, so
   only equal and adjacent classes can link) and a hash into chunks of about ``chunk_rows``, or a
   sixteenth of a larger cell, up to eight times that (fewer where sets are so large that a chunk
   would exceed ``CHUNK_SHINGLES``). Pairs of chunks are the
   tasks: a large group is spread over many of them. How many chunks a cell has is counted and
   joined on rows without sets, under ``SALTS`` salted keys, so no task meets a whole cell.
4. In a task, pairs that share a band are compared by ``step`` MinHash values at a time. With m of n
   values equal, the similarity has the posterior Beta(m + 1, n - m + 1); the pair is dropped when
   P(similarity >= threshold) falls below ``tolerance``. What survives is verified exactly on the
   shingle sets. A task returns the links' number per representative and a spanning forest of the
   links, never the pairs themselves.

Result: one row per document with its class, group and number of links (other documents at or over
the threshold, copies included). In one near-copy group of n *different* texts, comparisons are
quadratic, as any exact count of links is: n * n / 2 pairs at most, of those that share a band. So are
the rows sent to the tasks beyond 32,768 texts: each set goes to every chunk that its own one meets, 16
up to there and n / 2048 beyond (up to three times that with the adjacent cells). A task holds two
chunks at a time, and no task or row grows further with n.

Defined cases: null and empty texts, and texts without words, have the empty set and form one class
(similarity 1 among themselves, 0 to all others); rows with a null id are left out, since results
are keyed by id; repeated ids with equal sets are one document, and with different texts the
smallest digest stands for the id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, prepare, written
from .text import mix, shingle_hashes, word_hashes

THRESHOLD, BANDS, ROWS = 0.8, 32, 6
CHUNK_ROWS, CHUNK_SHARE, CHUNK_SHINGLES, SALTS = 256, 16, 1 << 21, 256
FILTER_BITS = 25


def _multipliers(k: int) -> np.ndarray:
    return (mix(np.arange(1, k + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text)))


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set; a block of shingles at a time, for bounded memory."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(best, (x[None, i : i + 4096] * multipliers[:, None]).min(1), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for row in sig.reshape(bands, rows).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h


def survival_table(n_hashes: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, least m) at each look: fewer than m equal values out of n drop the pair.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), so P(s >= t) is the chance of
    at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, n_hashes + 1, step):
        total, least = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((n, least))
    return out


def digests(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, the digest of the shingle set, its size and its band keys."""
    prepare(docs.sparkSession)
    multipliers = _multipliers(bands * rows)
    schema = "doc_id long, d1 long, d2 long, size int, keys array<long>"

    def run(batches):
        for batch in batches:
            d1, d2, sizes, keys = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                sizes.append(len(s))
                keys.append(band_keys(signature(s, multipliers), bands, rows).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "d1", "d2", "size", "keys"],
            )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def id_filter(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A fixed-size bitmap (2 ** bits) of hashed ids: false positives, no false negatives.

    At most 2 ** (bits - 15) rows of 4 KB reach the driver, whatever the number of ids.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    rows = (
        ids.select(slot.alias("s"))
        .groupBy(F.expr("bitmap_bucket_number(s)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8 + 8192, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.bucket - 1) * 4096
        if at < 0:  # slot 0 has bucket 0
            at = 0
        out[at : at + len(part)] |= part
    return out


def member_sets(docs: DataFrame, members: DataFrame, bands: int, rows: int) -> DataFrame:
    """Shingle set and MinHash values of the representatives in ``members`` (rep, d1, d2, ...).

    The texts are read again, but a bitmap of the wanted ids drops nearly all other rows before
    anything is computed or shuffled.
    """
    multipliers = _multipliers(bands * rows)
    slots = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << FILTER_BITS)).alias("slot")
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(members, "rep").tobytes())
    schema = "rep long, d1 long, d2 long, shingles binary, sig binary"

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            slot = batch.column(2).to_numpy()
            # bitmap_bit_position counts from (slot - 1) in buckets that start at slot 1
            at = np.where(slot > 0, slot - 1, 0)
            hit = np.flatnonzero(bits[at >> 3] >> (at & 7) & 1 | (slot == 0))
            batch = batch.take(pa.array(hit))
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text)
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                sig = signature(s, multipliers) if len(s) else np.zeros(0, np.uint32)
                for o, v in zip(out, (int(digest[0]), int(digest[1]), s.tobytes(), sig.tobytes()), strict=True):
                    o.append(v)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(o, t) for o, t in zip(out, types, strict=True)]],
                names=["rep", "d1", "d2", "shingles", "sig"],
            )

    sets = (
        docs.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("rep"), "text", slots)
        .mapInArrow(run, schema)
    )
    # a repeated id may stand for several texts: the digest picks the right one, once
    sets = sets.groupBy("rep", "d1", "d2").agg(F.first("shingles").alias("shingles"), F.first("sig").alias("sig"))
    return members.join(sets, ["rep", "d1", "d2"])


class SharedCounts:
    """Sizes of intersections of sets, by marking one set's elements and adding up the others' marks."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.first = np.cumsum(self.size) - self.size
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids, self.mark = ids.astype(np.int32), np.zeros(len(values), np.int32)

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """For (i, j) rows in the order of i; sets are not empty."""
        out = np.zeros(len(pairs), np.int64)
        turn = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
        for a, b in zip(turn, np.append(turn, len(pairs))[1:], strict=True):
            i, js = pairs[a, 0], pairs[a:b, 1]
            own = self.ids[self.first[i] : self.first[i] + self.size[i]]
            self.mark[own] = 1
            ends = np.cumsum(self.size[js])
            starts = ends - self.size[js]
            out[a:b] = np.add.reduceat(self.mark[self.ids[np.repeat(self.first[js] - starts, self.size[js]) + np.arange(ends[-1])]], starts)
            self.mark[own] = 0
        return out


def compare_chunks(reps, side, sets, sigs, copies, bands, rows, threshold, looks):
    """Links between two chunks (or within one): per row the linked documents, and forest edges.

    ``side``: 0 and 1 for the chunks; all 0 if a chunk meets itself.
    """
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1)
    own = not len(b)
    b = a if own else b
    counts = SharedCounts(sets)
    sizes = counts.size
    keys = np.stack([band_keys(s, bands, rows) for s in sigs])
    links, parent = np.zeros(len(reps), np.int64), np.arange(len(reps))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for lo in range(0, len(a), 64):
        part = a[lo : lo + 64]
        small, large = np.minimum.outer(sizes[part], sizes[b]), np.maximum.outer(sizes[part], sizes[b])
        alive = small >= threshold * large
        if own:
            alive &= np.less.outer(part, b)
        near = np.zeros(alive.shape, bool)
        for k in range(bands):
            near |= keys[part, k][:, None] == keys[b, k][None, :]
        pairs = np.argwhere(alive & near)
        equal, done = np.zeros(len(pairs), np.int64), 0
        for n, least in looks:
            if not len(pairs):
                break
            equal += (sigs[part[pairs[:, 0]], done:n] == sigs[b[pairs[:, 1]], done:n]).sum(1)
            keep = equal >= least
            pairs, equal, done = pairs[keep], equal[keep], n
        i, j = part[pairs[:, 0]], b[pairs[:, 1]]
        shared = counts.of(np.stack([i, j], 1))
        linked = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            links[x] += copies[y]
            links[y] += copies[x]
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
    return links, np.array([root(i) for i in range(len(reps))], np.int64)


def near_copies(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    step: int = 32,
    tolerance: float = 1e-6,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """doc_id, copy_id (smallest id with the same shingles), group_id (smallest id reachable by
    links), n_links (other documents at or over the threshold)."""
    prepare(docs.sparkSession)
    looks = survival_table(bands * rows, step, threshold, tolerance)
    all_rows = checkpoint(digests(docs, bands, rows))
    # one row per id; copies of a set are one class with its smallest id
    ids = all_rows.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("doc_id", "d.d1", "d.d2")
    classes = ids.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = checkpoint(classes)
    keyed = (
        classes.join(
            all_rows.groupBy("doc_id", "d1", "d2").agg(F.first("size").alias("size"), F.first("keys").alias("keys")).withColumnRenamed("doc_id", "rep"),
            ["rep", "d1", "d2"],
        ).where("size > 0")
    )
    banded = keyed.select("rep", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    stars = banded.join(hubs, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    comps = components(stars).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9)).cast("int")
    salt = F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(SALTS)).cast("int")
    members = checkpoint(keyed.drop("keys").join(comps, "rep").withColumn("cell", size_class).withColumn("salt", salt))
    # a cell's number of chunks, from at most SALTS counts, goes back to its rows by salted keys
    counted = members.groupBy("comp", "cell", "salt").agg(F.count(F.lit(1)).alias("n"))
    largest = F.pow(F.lit(1 / threshold), F.col("cell") + 1)
    fair = F.least(F.lit(8 * chunk_rows), F.greatest(F.lit(chunk_rows), F.ceil(F.col("n") / CHUNK_SHARE)))
    per_chunk = F.least(fair, F.greatest(F.lit(16), F.floor(F.lit(CHUNK_SHINGLES) / largest)))
    cells = counted.groupBy("comp", "cell").agg(F.sum("n").alias("n")).select("comp", "cell", F.ceil(F.col("n") / per_chunk).cast("int").alias("m"))
    beside = lambda d, name: cells.select("comp", (F.col("cell") - d).alias("cell"), F.col("m").alias(name))
    around = cells.join(beside(1, "m_up"), ["comp", "cell"], "left").join(beside(-1, "m_down"), ["comp", "cell"], "left").na.fill(0, ["m_up", "m_down"])
    shares = counted.drop("n").join(around, ["comp", "cell"])
    placed = members.join(shares, ["comp", "cell", "salt"]).drop("salt")
    dealt = member_sets(docs, placed, bands, rows)
    sub = F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("m")).cast("int")

    def task(cell_a, sub_a, cell_b, sub_b, side):
        return F.struct(
            cell_a.cast("int").alias("ca"), sub_a.cast("int").alias("sa"),
            cell_b.cast("int").alias("cb"), sub_b.cast("int").alias("sb"), F.lit(side).alias("side"),
        )

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    c, s = F.col("cell"), F.col("sub")
    tasks = F.concat(
        F.transform(upto(F.col("m")), lambda t: F.when(t >= s, task(c, s, c, t, 0)).otherwise(task(c, t, c, s, 1))),
        F.transform(upto(F.col("m_up")), lambda t: task(c, s, c + 1, t, 0)),
        F.transform(upto(F.col("m_down")), lambda t: task(c - 1, t, c, s, 1)),
    )
    spread = dealt.withColumn("sub", sub).withColumn("task", F.explode(tasks)).select(
        "comp", "task.*", "rep", "copies", "shingles", "sig"
    )

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        reps = t.column("rep").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        sigs = np.stack([np.frombuffer(x, np.uint32) for x in t.column("sig").to_pylist()])
        links, roots = compare_chunks(
            reps, t.column("side").to_numpy(), sets, sigs, t.column("copies").to_numpy(), bands, rows, threshold, looks
        )
        hit = np.flatnonzero(links)
        return pa.table({"a": reps[roots[hit]], "b": reps[hit], "links": links[hit]})

    found = checkpoint(
        spread.groupBy("comp", "ca", "sa", "cb", "sb").applyInArrow(run, "a long, b long, links long")
    )
    groups = components(found.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    counts = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("near"))
    info = classes.join(groups, "rep", "left").join(counts, "rep", "left").select(
        "d1", "d2",
        F.col("rep").alias("copy_id"),
        F.coalesce("group_id", "rep").alias("group_id"),
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links"),
    )
    return ids.join(info, ["d1", "d2"]).select("doc_id", "copy_id", "group_id", "n_links")


def dedupe(docs: DataFrame, **settings) -> DataFrame:
    """One row of each group of linked texts, whatever their ids: the one with the smallest id.

    Rows are compared by numbers of their own, so repeated ids, null ids (which come last) and identical rows
    are compared as all others are. Columns of any name stay as they are.
    """
    number, keep = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names that no column has
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(number).alias("doc_id"), "text")
    groups = near_copies(texts, **settings).select(F.col("doc_id").alias(number), "group_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(number).alias("row")))
    kept = numbered.select(number, "doc_id").join(groups, number).groupBy("group_id").agg(first.alias("f")).select(F.col("f.row").alias(keep))
    return numbered.join(kept, F.col(number) == F.col(keep), "left_semi").select(*docs.columns)


#: DuckDB: every pair of texts by brute force, groups by walking the links.
ORACLE = """
with recursive w as (
  select doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '_', ' ', 'g'), '[\\p{L}\\p{N}]+') as w from documents where doc_id is not null),
sh as (
  select distinct doc_id, unnest(case when len(w) = 0 then []
    when len(w) < 5 then [list_aggregate(w, 'string_agg', ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) end) as s
  from w),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (
  select x, y, c = nx.n and c = ny.n as same from common join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  where c >= 0.8 * (nx.n + ny.n - c) - 1e-9
  union all
  select a.doc_id, b.doc_id, true from w a join w b on a.doc_id < b.doc_id where len(a.w) = 0 and len(b.w) = 0),
both_ways as (select x, y, same from link union all select y, x, same from link),
reach(doc_id, seen) as (
  select doc_id, doc_id from w
  union
  select r.doc_id, l.y from reach r join both_ways l on l.x = r.seen)
select w.doc_id,
  least(w.doc_id, (select min(y) from both_ways b where b.x = w.doc_id and b.same)) as copy_id,
  (select min(seen) from reach r where r.doc_id = w.doc_id) as group_id,
  (select count(*) from both_ways b where b.x = w.doc_id) as n_links
from w
"""
