"""Packing token sequences by best-fit decreasing.

A document is its ids and an end id. Documents longer than a window are first cut into full
windows, each a sequence of its own; what is left of every document is packed. Token counts
and checksums are made where the text is read, so only small rows (one per leftover) are
shuffled: they are dealt by a hash of their place into blocks of about ``block_rows``, and each
block is packed in one task, longest first, into the open window with the least room that
suffices. A segment tree over remaining capacities finds that window.

With an order (the positions of a mix), a block is ``block_rows`` consecutive positions instead,
full windows included. Sequence ids rise with the blocks, and within a block with the first
position that a sequence holds, so any range of ids has the sources of a range of positions.

Documents are never cut to fill gaps: the padding is what best-fit decreasing leaves.

Defined cases: a null text is an empty one and gives the end id alone; repeated ids and rows are
packed one by one; strings of the vocabulary's special tokens have these tokens' ids, as in
``tokenizers``; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prepare

WINDOW, END_ID, BLOCK_ROWS = 2048, 1, 2048
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, place long"
)
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level vocabulary of a ``tokenizers`` file, for tiktoken, which is several times as fast.

    The ranks are in the file of the same name for tiktoken, the special tokens in the ``tokenizers``
    file itself; tests compare the ids.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path) as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _encoders[path]


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text, special tokens in it included, and the end id; unsigned 32-bit."""
    ids = encoder(path).encode(text, allowed_special="all") if text else []
    ids.append(END_ID)
    return np.array(ids, "<u4")


class CapacityTree:
    """Counts of open windows by remaining room; finds the least room of at least ``need``.

    An implicit binary tree over the rooms 0 .. size - 1; a node holds the windows below it.
    """

    def __init__(self, size: int):
        self.leaf = 1 << max(1, (size - 1).bit_length())
        self.count = [0] * (2 * self.leaf)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaf
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest room >= need that an open window has, or -1."""
        count, i = self.count, need + self.leaf
        if count[i]:
            return need
        while i > 1:  # climb until a right sibling holds windows, then go down to its leftmost
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaf:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaf
            i >>= 1
        return -1


def best_fit_decreasing(lengths, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) for each length; ties go to the earlier piece and window."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree, by_room, opened = CapacityTree(window + 1), [[] for _ in range(window + 1)], 0
    for k in np.argsort(-np.asarray(lengths), kind="stable"):
        need = int(lengths[k])
        room = tree.tightest(need)
        if room < 0:
            w, room, opened = opened, window, opened + 1
        else:
            w = by_room[room].pop()
            tree.add(room, -1)
        where[k], offset[k] = w, window - room
        if room > need:
            by_room[room - need].append(w)
            tree.add(room - need, 1)
    return where, offset


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, order: Column | None = None) -> DataFrame:
    """Full windows and leftovers of each document. ``place`` numbers the rows of a split.

    Full windows have their sequence id, odd, and offset 0; leftovers have none yet. With an order,
    ``place`` is the order's value, and no piece has a sequence id yet.
    """
    prepare(docs.sparkSession)
    ordered = order is not None

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        full = row
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = token_ids(text, vocabulary)
                place = place if ordered else row
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    whole = len(part) == window and not ordered
                    out.append(
                        (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids),
                         2 * full + 1 if whole else None, 0 if whole else None, place)
                    )
                    full += whole
                row += 1
            cols = list(zip(*out, strict=True)) or [[]] * 8
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    place = F.lit(None) if order is None else order
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.cast("long")).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, block_rows: int = BLOCK_ROWS, order: Column | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``order``: positions of the rows, from 0 without gaps or repeats, that sequence ids shall follow.
    """
    ordered = order is not None
    cut = pieces(docs, vocabulary, window, order)
    if ordered:
        block = F.floor(F.col("place") / block_rows).cast("long")
    else:
        blocks = max(1, -(-docs.count() // block_rows))
        block = F.when(F.col("sequence_id").isNull(), F.pmod(F.xxhash64("place"), F.lit(blocks)))
    cut = cut.withColumn("block", block)

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("place", "ascending"), ("start", "ascending")])
        where, offset = best_fit_decreasing(part.column("length").to_numpy(), window)
        block = part.column("block")[0].as_py()
        if ordered:  # number the windows by the first piece that each holds
            first = np.full(where.max() + 1, len(where))
            np.minimum.at(first, where, np.arange(len(where)))
            where = np.argsort(np.argsort(first))[where]
        for name, values in (("sequence_id", ((block << 32) + where) * 2), ("offset", offset)):
            part = part.set_column(part.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return part

    if ordered:
        return cut.groupBy("block").applyInArrow(run, cut.schema).drop("block", "place")
    # full windows and leftovers come from one pass: it is written once, and read by both branches
    cut = checkpoint(cut)
    packed = cut.where("block is not null").groupBy("block").applyInArrow(run, cut.schema)
    return cut.where("block is null").unionByName(packed).drop("block", "place")
