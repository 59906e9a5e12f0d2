"""Document fingerprints by consistent weighted sampling.

A text is a bag of words. For each of ``SAMPLES`` draws j, every distinct word of weight w (its number
of occurrences) gets, with r and c from Gamma(2, 1) and b uniform, all derived from a hash of the word
and j (Ioffe 2010),
    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1),
and the word with the least a is the sample, with its t. Two bags give the same sample with a
probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima, so the
share of equal samples estimates it; its standard error is at most 0.5 / sqrt(SAMPLES).

Every draw is over the whole weighted bag. A code packs ln a over a hash of (word, t), so the least code
of a bag is its sample. Codes depend on (word, weight) alone, so each distinct pair of a batch is
computed once. That part runs in numpy on Arrow batches: a form in DataFrame functions did not meet the
limits (figures in the README). Everything else is DataFrame operations.

Texts are shuffled once, by id; the head that an edit needs comes from the next text in a second, smaller
shuffle; samples are shuffled as 256 bytes a text.

Defined cases: null text is empty; texts without words have the fingerprint of dots, alike (1) to one
another and unlike (0) any other; equal texts have equal fingerprints. Rows with one id follow another
id's rows as one: the text with the least hash stands for them; a null id sorts last, and the rows
without id are spread over ``SPREAD`` keys. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, prepare
from .text import mix, word_hashes

SAMPLES, SPREAD, PAIRS = 128, 64, 1_000_000
_NONE = -(1 << 63)


def pair_codes(term: np.ndarray, weight: np.ndarray, j: int, block: int = 8192) -> np.ndarray:
    """The j-th codes (int64) of (term, weight) pairs: ln a above, a hash of (term, t) below."""
    out = np.empty(len(term), np.int64)
    scale, least, one = np.float32(2**-32 * (1 - 2**-23)), np.float32(2**-33), np.float32(1)
    salt = np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)

    def uniform(x, half):
        return x.view(np.uint32)[half::2].astype(np.float32) * scale + least

    for lo in range(0, len(term), block):  # small enough for the processor's cache
        h = mix(term[lo : lo + block] ^ salt)
        g = mix(h + np.uint64(0xD1B54A32D192ED03))
        e = mix(g + np.uint64(0x8CB92BA72F3D8DD7))
        r = -np.log(uniform(h, 0) * uniform(h, 1))
        c = -np.log(uniform(g, 0) * uniform(g, 1))
        b = uniform(e, 1)
        t = np.floor(weight[lo : lo + block] / r + b)
        rank = (np.log(c) - r * (t - b + one)).view(np.int32)
        rank ^= (rank >> 31) & np.int32(0x7FFFFFFF)  # floats in the order of integers
        code = out[lo : lo + block]
        np.left_shift(rank, 32, out=code, dtype=np.int64)
        code |= e.view(np.uint32)[::2] ^ (t.astype(np.uint32) * np.uint32(0x9E3779B1))
    return out


def signatures(texts: list[str], samples: int = SAMPLES) -> list[np.ndarray | None]:
    """16 bits of each sample of each text; None for a text without words."""
    out: list[np.ndarray | None] = [None] * len(texts)
    group: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def settle():
        if not group:
            return
        sizes = np.array([len(t) for _, t, _ in group])
        term, weight = np.concatenate([t for _, t, _ in group]), np.concatenate([w for *_, w in group])
        _, first, back = np.unique(term ^ mix(weight.astype(np.uint64)), return_index=True, return_inverse=True)
        order = np.argsort(first)  # in the order of appearance: frequent pairs lie close to each other
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        first, back, starts = first[order], place[back], np.cumsum(sizes) - sizes
        term, log_weight = term[first], np.log(weight[first].astype(np.float32))
        signs = np.empty((len(group), samples), np.uint16)
        for j in range(samples):
            signs[:, j] = np.minimum.reduceat(pair_codes(term, log_weight, j)[back], starts).astype(np.uint16)
        for (i, *_), s in zip(group, signs, strict=True):
            out[i] = s
        group.clear()

    for i, text in enumerate(texts):
        h = word_hashes(text)
        if not len(h):
            continue
        term, weight = np.unique(h, return_counts=True)
        group.append((i, term, weight))
        held += len(term)
        if held >= PAIRS:
            settle()
            held = 0
    settle()
    return out


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two packed fingerprints (four samples in a long)."""
    part = lambda x, k: F.when(F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1.0).otherwise(0.0)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0.0), lambda s, x: s + part(x, 0) + part(x, 1) + part(x, 2) + part(x, 3))
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, same / (4 * F.size(a))).otherwise(F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).otherwise(0.0))


def as_string(column: str, samples: int) -> Column:
    hexes = F.array_join(F.transform(column, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")
    return F.coalesce(hexes, F.lit("." * (4 * samples)))


def ring(rows: DataFrame) -> DataFrame:
    """(key, row, of, need): each distinct key's row that stands for it, and the key that it follows.

    Keys in descending order; the largest follows the smallest. ``need`` is the number of characters of
    the longest text of ``of``. Keys are range-partitioned; each partition looks back in itself, and its
    first key follows the last of the partition before that has any.
    """
    stands = F.min(F.struct("hash", "row"))["row"]
    dealt = rows.groupBy("key").agg(F.max("n").alias("n"), stands.alias("row"))
    dealt = checkpoint(dealt.repartitionByRange(F.col("key").desc()).withColumn("part", F.spark_partition_id()))
    tails = dealt.groupBy("part").agg(F.min_by(F.struct("key", "n"), "key").alias("tail"))
    order = Window.orderBy("part")  # one row per partition
    tails = tails.select("part", F.lag("tail").over(order).alias("before"), F.last("tail").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    within = Window.partitionBy("part").orderBy(F.col("key").desc())
    follows = F.coalesce(F.lag(F.struct("key", "n")).over(within), "before", "end")
    return dealt.join(F.broadcast(tails), "part").withColumn("_f", follows).select("key", "row", F.col("_f.key").alias("of"), F.col("_f.n").alias("need"))


def marked(rows: DataFrame, samples: int) -> DataFrame:
    """key, salt, row, n_chars, edited_sha256, fp and efp of rows with text and head."""
    schema = "key long, salt long, row long, n_chars long, edited_sha256 string, fp array<long>, efp array<long>"
    packed = lambda s: None if s is None else s.view(np.int64)

    def run(batches):
        for batch in batches:
            texts, heads = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            edits = [t[: len(t) - len(t) // 2] + h[: len(t) // 2] for t, h in zip(texts, heads, strict=True)]
            signs = [packed(s) for s in signatures([x for p in zip(texts, edits, strict=True) for x in p], samples)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
                 pa.array(signs[::2], pa.list_(pa.int64())), pa.array(signs[1::2], pa.list_(pa.int64()))],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return rows.select("key", "salt", "row", "text", "head").mapInArrow(run, schema)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``samples`` is a multiple of 4.
    """
    if samples <= 0 or samples % 4:
        raise ValueError("samples come in fours")
    prepare(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    links = checkpoint(ring(rows.select("key", "row", F.char_length("text").alias("n"), F.xxhash64("text").alias("hash"))))
    salt = F.coalesce(F.when(F.col("key") == _NONE, F.pmod(F.xxhash64("row"), F.lit(SPREAD))), F.lit(0)).cast("long")
    spread = F.explode(F.when(F.col("of") == _NONE, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0))).cast("array<long>"))
    stands = links.withColumn("salt", salt)
    dealt = rows.withColumn("salt", salt).repartition("key", "salt")  # once; both branches below read it
    # what each key's stand-in gives to the key before it: the head of its text
    heads = (
        dealt.join(stands.withColumnRenamed("row", "stand").hint("shuffle_hash"), ["key", "salt"])
        .where("row - stand = 0")  # not a join key: the branches then share one exchange
        .select(F.col("of").alias("key"), F.expr("substring(text, 1, need div 2)").alias("head"), spread.alias("salt"))
    )
    done = checkpoint(marked(dealt.join(heads.hint("merge"), ["key", "salt"]), samples))
    given = done.join(stands.hint("shuffle_hash"), ["key", "salt", "row"]).select(F.col("of").alias("key"), F.col("fp").alias("next_fp"), spread.alias("salt"))
    return done.join(given, ["key", "salt"]).select(
        F.when(F.col("key") != _NONE, F.col("key")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string("fp", samples).alias("fingerprint"),
        as_string("efp", samples).alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
