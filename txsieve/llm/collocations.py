"""Phrase collocations, counted over a prefix-free parse.

1. ``parse``: a text is the stream of its words, with a mark between pieces. Where the hash of ``OVERLAP`` tokens
   in a row is 0 modulo ``MODULUS``, a chunk ends after these tokens and the next begins with them: chunk
   borders depend on the words around them alone, so copied passages give the same chunks wherever they
   lie. A chunk without such a place is cut after ``LONGEST`` tokens. Each chunk owns the tokens up to the
   beginning of the next.
2. ``dictionary``: the distinct chunks of a language with their frequencies; the only shuffle of texts.
3. ``grams``: n-grams of each distinct chunk, weighted by its frequency. An n-gram belongs to the chunk that
   owns its first word; with an overlap of four tokens the chunk holds all of its five words, so each
   occurrence is counted once. No n-gram crosses a mark.
   Three passes go up in length: a phrase reaches the minimum only if all its parts do, so pairs are counted only
   of words, and longer n-grams only of pairs, that a bitmap of the frequent ones holds. The bitmap has a bit for each phrase's
   hash, 16 a phrase, at most 2^27 (16 MB): it may let a phrase through in vain, never the reverse, and
   the counts themselves are of words, exact.
4. ``scored``: cuts meet the frequencies of their parts in joins, all in integer or decimal arithmetic.

Defined cases: null and empty texts have no words; a null language is ``und``; null and repeated ids and
repeated rows count each; other columns are ignored; an empty table gives no rows; texts and pieces may have
any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written
from .text import mix, slice_hashes

LEAST, WORDS, TOP = 100, 5, 2000
OVERLAP, MODULUS, LONGEST, SALTS = 4, 48, 512, 64
BITS_A_PHRASE, MOST_BITS, BATCH_ROWS = 16, 27, 30_000
_MARK = "\n"
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each string, and the distinct strings that the numbers stand for, one to one."""
    d = strings.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary.cast(pa.large_string())


def hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of large strings."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return slice_hashes(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], ends[1:])


class Stream:
    """The tokens of some texts: words of the lower-cased text, and a mark between pieces, as numbers into ``words``."""

    def __init__(self, texts: list[str | None]):
        plain = [(t or "").encode("utf-8", "replace").translate(_TO).replace(b"\n", b" \n ") for t in texts]
        split = pc.split_pattern(pa.array(plain, pa.large_binary()), " ")
        ids, words = numbered(split.values)
        text = np.repeat(np.arange(len(plain)), np.diff(split.offsets.to_numpy()))
        kept = (pc.binary_length(words).to_numpy() > 0)[ids]
        ids, text = ids[kept], text[kept]
        mark = (pc.equal(words, _MARK).to_numpy(zero_copy_only=False))[ids]
        once = ~(mark & np.r_[True, mark[:-1]] & np.r_[True, text[1:] == text[:-1]]) if len(ids) else mark
        self.words, self.ids, self.text = words, ids[once], text[once]

    def chunks(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of each chunk: its text's number, its tokens joined by spaces, and how many of them it owns."""
        n = len(self.ids)
        if not n:
            return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int32)
        begins = np.flatnonzero(np.r_[True, np.diff(self.text) != 0])
        stop = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n]))  # where each token's text ends
        h = hashes(self.words)[self.ids]
        window = np.zeros(max(0, n - OVERLAP), np.uint64)
        for i in range(OVERLAP):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(window)] + np.uint64(1)
        at = np.flatnonzero(mix(window) % np.uint64(MODULUS) == 0)
        at = at[at + OVERLAP < stop[at]]
        starts = np.union1d(begins, at)
        size = np.diff(np.r_[starts, n])
        if (long := np.flatnonzero(size > LONGEST)).size:
            starts = np.union1d(starts, np.concatenate([np.arange(starts[i], starts[i] + size[i], LONGEST) for i in long]))
        owned = np.diff(np.r_[starts, n])
        held = np.minimum(starts + owned + OVERLAP, stop[starts]) - starts
        offsets = np.r_[0, np.cumsum(held)]
        tokens = self.words.take(pa.array(self.ids[np.repeat(starts - offsets[:-1], held) + np.arange(offsets[-1])]))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), tokens), pa.scalar(" ", pa.large_string()))
        return self.text[starts], joined.cast(pa.string()), owned.astype(np.int32)


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, chunk, owned, n: the distinct chunks and how often the parse has them."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                langs, texts = (batch.column(i).slice(lo, 128) for i in (0, 1))
                text, chunk, owned = Stream(texts.to_pylist()).chunks()
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(text)), chunk, pa.array(owned)], names=["lang", "chunk", "owned"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    parsed = docs.select(lang, F.col("text").cast("string")).mapInArrow(run, "lang string, chunk string, owned int")
    return parsed.groupBy("lang", "chunk", "owned").agg(F.count(F.lit(1)).alias("n"))


class Batch:
    """The tokens of many chunks as numbers: exact, as numbers stand for words one to one."""

    def __init__(self, table: pa.Table):
        lang, chunk, owned, times = (table.column(n).combine_chunks() for n in ("lang", "chunk", "owned", "n"))
        split = pc.split_pattern(chunk, " ")
        self.ids, self.words = numbered(split.values)
        begins = split.offsets.to_numpy()
        lang = lang.dictionary_encode()
        self.langs = lang.dictionary
        chunk_of = np.repeat(np.arange(len(chunk)), np.diff(begins))
        self.lang = lang.indices.to_numpy().astype(np.int64)[chunk_of]
        self.weight = np.where(np.arange(len(self.ids)) < (begins[:-1] + owned.to_numpy())[chunk_of], times.to_numpy()[chunk_of], 0)
        self.word = ~pc.equal(self.words, _MARK).to_numpy(zero_copy_only=False)[self.ids]
        # a pair lies in one chunk, without a mark
        self.pair = self.word & np.r_[self.word[1:], False]
        self.pair[begins[1:] - 1] = False
        # hashes of (language, word), for the bitmaps
        self.hash = hashed(self.langs, self.words)[self.lang, self.ids]

    def summed(self, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each code: a place that has it, and the sum of weights; and a small number for the code of each place."""
        order = np.argsort(code, kind="stable")
        turn = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(order) else np.zeros(0, np.int64)
        small = np.empty(len(code), np.int64)
        small[order] = np.repeat(np.arange(len(turn)), np.diff(np.r_[turn, len(order)]))
        sums = np.add.reduceat(self.weight[at[order]], turn) if len(turn) else np.zeros(0, np.int64)
        return at[order[turn]], sums, small

    def pairs(self) -> np.ndarray:
        """Hashes of the two-word phrases at each place."""
        return paired(self.hash, np.r_[self.hash[1:], np.uint64(0)])

    def counted(self, at: np.ndarray, sums: np.ndarray, n: int) -> pa.RecordBatch:
        hit = np.flatnonzero(sums)
        at = at[hit]
        phrases = pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[at + i])) for i in range(n)], pa.scalar(" ", pa.large_string()))
        return _batch(self.langs.take(pa.array(self.lang[at])), phrases, n, sums[hit])


def _batch(langs: pa.Array, phrases: pa.Array, n: int, sums: np.ndarray) -> pa.RecordBatch:
    columns = [langs.cast(pa.string()), phrases.cast(pa.string()), pa.array(np.full(len(sums), n), pa.int32()), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])


def hashed(langs: pa.Array, words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word in each language."""
    return mix(hashes(words)[None, :] ^ mix(hashes(langs.cast(pa.large_string())))[:, None])


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def bitmap(frequent: DataFrame, count: int) -> tuple[bytes, int]:
    """A bit for the hash of each (lang, phrase) of one or two words, and the number of bits; at most 16 MB.

    Each of four tasks fills a bitmap of its own; they come to the driver one after the other, in pages of 4 KB.
    """
    size = 1 << min(MOST_BITS, max(16, (BITS_A_PHRASE * max(count, 1)).bit_length()))

    def run(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            if batch.num_rows:
                lang, langs = numbered(batch.column(0))
                words = pc.split_pattern(batch.column(1), " ")
                n = len(words.values) // len(words)  # words of each phrase
                h = [hashed(langs, pc.list_element(words, k).cast(pa.large_string()))[lang, np.arange(len(lang))] for k in range(n)]
                bits[(h[0] if n == 1 else paired(*h)) & np.uint64(size - 1)] = True
        pages = np.packbits(bits, bitorder="little").reshape(-1, min(4096, size // 8))
        full = np.flatnonzero(pages.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([pages[i].tobytes() for i in full], pa.binary())], names=["page", "bits"])

    out = np.zeros(size // 8, np.uint8)
    for r in frequent.select("lang", "phrase").coalesce(4).mapInArrow(run, "page long, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.page * len(part) : (r.page + 1) * len(part)] |= part
    return out.tobytes(), size


def grams(chunks_: DataFrame, level: int, known: tuple[bytes, int] | None = None) -> DataFrame:
    """lang, phrase, words, n: occurrences of n-grams. Level 1: words, and a row with an empty phrase for their number;
    level 2: pairs of words that ``known``, a bitmap, has; level 3: three to five words whose pairs it has."""
    spark = chunks_.sparkSession
    held = spark.sparkContext.broadcast(known[0]) if known else None
    size = known[1] if known else 0

    def has(h: np.ndarray) -> np.ndarray:
        bits, slot = np.frombuffer(held.value, np.uint8), h & np.uint64(size - 1)
        return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def count(b: Batch):
        v = len(b.words)
        if level == 1:
            at = np.flatnonzero(b.word)
            first, sums, _ = b.summed(at, b.lang[at] * v + b.ids[at])
            yield b.counted(first, sums, 1)
            by = np.bincount(b.lang[at], b.weight[at].astype(np.float64), len(b.langs)).astype(np.int64)
            yield _batch(b.langs, pa.array([""] * len(by)), 1, by)
            return
        if level == 2:
            good = has(b.hash)
            at = np.flatnonzero(b.pair & good & np.r_[good[1:], False])
            first, sums, _ = b.summed(at, (b.lang[at] * v + b.ids[at]) * v + b.ids[at + 1])
            yield b.counted(first, sums, 2)
            return
        two = b.pair & has(b.pairs())
        at = np.flatnonzero(two[:-1] & two[1:])
        code = b.summed(at, (b.lang[at] * v + b.ids[at]) * v + b.ids[at + 1])[2]
        for n in range(3, WORDS + 1):
            first, sums, code = b.summed(at, code * v + b.ids[at + n - 1])
            yield b.counted(first, sums, n)
            on = np.flatnonzero(two[at + n - 1])  # the pair that a longer phrase ends with
            at, code = at[on], code[on]

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def settle():
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            yield from count(Batch(t))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BATCH_ROWS:
                yield from settle()
        if waiting:
            yield from settle()

    found = chunks_.select("lang", "chunk", "owned", "n").mapInArrow(run, "lang string, phrase string, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, n: all phrases of 1 to 5 words with n >= least, and each language's total as ''."""
    parsed = written(dictionary(docs))
    often = lambda g: written(g.where((F.col("n") >= least) | (F.col("phrase") == "")))
    ones = often(grams(parsed, 1))
    twos = often(grams(parsed, 2, bitmap(ones.where("phrase <> ''"), ones.count())))
    more = often(grams(parsed, 3, bitmap(twos, twos.count())))
    return ones.unionByName(twos).unionByName(more)


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer candidate contains as often."""
    of = lambda name, by: found.select("lang", F.col("phrase").alias(by), F.col("n").alias(name))
    # a language may hold most candidates: its total meets them under salted keys
    total = found.where("phrase = ''").select("lang", F.col("n").alias("total"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wide = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, n: F.array_join(F.slice(F.col("w"), a, n), " ")
    cuts = wide.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"first": joined(F.lit(1), F.col("k")), "rest": joined(F.col("k") + 1, F.col("words") - F.col("k"))})
    cuts = cuts.join(of("l", "first"), ["lang", "first"]).join(of("r", "rest"), ["lang", "rest"])
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(total, ["lang", "salt"])
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(cast(1000 as decimal(4, 0)) * ({exact('a')} * {exact('total')}) div ({exact('l')} * {exact('r')}) as long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r", "total")).alias("c"))
    within = F.explode(F.expr("filter(flatten(transform(sequence(1, words - 1), i -> transform(sequence(2, words - i + 1), m -> if(m < words, array_join(slice(w, i, m), ' '), '')))), x -> x <> '')"))
    inner = wide.where("words > 2").select("lang", within.alias("phrase"), "a").distinct()
    return best.join(inner, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.total").alias("n"), F.col("c.score").alias("score")
    )


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(frequencies(docs, least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with d as (
  select row_number() over () as i, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
g as (
  select lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') as phrase
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as m))),
f as (select lang, m, phrase, count(*) as n from g group by all),
n as (select lang, sum(n) as n from f where m = 1 group by lang),
c as (select lang, m, phrase, n as a, string_split(phrase, ' ') as w from f where m > 1 and n >= 100),
k as (select *, unnest(range(1, m)) as k from c),
s as (
  select k.lang, k.phrase, k.a, k.k, l.n as l, r.n as r, n.n, 1000::hugeint * k.a * n.n // (l.n::hugeint * r.n) as score
  from k join f l on l.lang = k.lang and l.phrase = array_to_string(k.w[1:k.k], ' ')
    join f r on r.lang = k.lang and r.phrase = array_to_string(k.w[k.k + 1:], ' ') join n on n.lang = k.lang),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select distinct lang, array_to_string(w[i:i + len - 1], ' ') as phrase, a
  from (select lang, w, a, m, len, unnest(range(1, m - len + 2)) as i from c, (select unnest([2, 3, 4]) as len) where len < m)),
kept as (select * from best b where not exists (select 1 from inner_ i where i.lang = b.lang and i.phrase = b.phrase and i.a >= b.a)),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, cast(rank as integer) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from z where rank <= 2000
"""
