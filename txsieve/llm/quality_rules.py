"""Quality rules with adaptive fences: quantile sketches per language and source, then a joined filter.

1. ``measured``: counts of each whole text, by array and string functions alone. Repeated words come from
   the text's own three-word windows: windows are sorted with their positions, equal neighbours are the
   repeated ones, and the positions they cover are added up.
2. ``sketch``: of each measure, the number of rows per bucket. Measures are integers (thousandths); a bucket
   holds values that agree in their first eight binary digits, so it is exact below 256 and within 1 / 128
   above, and it has at most some thousand buckets, however many rows there are. Sketches merge by
   adding counts, in any order and with the same result; ``merged`` adds those of the sources of a language,
   and of all languages.
3. ``fences``: quartiles of a group's sketch give its limits, q25 - 3 s and q75 + 3 s, where s is the
   quartiles' distance, and at least the measure's ``floor``, so that a measure that is the same in half of all
   rows has some room. A group of fewer than ``LEAST_ROWS`` rows takes its language's limits, and a
   language of fewer those of all rows.
4. ``judged``: rows meet their group's limits in a join and lose if a measure lies outside. The limits are one
   row per group; where they are too many to broadcast, ``SALTS`` copies of them spread a hot group.

The base rules (too few words; more than half of the words in repeated windows) are fixed and come first.

Defined cases: null text has no words, and fails; texts without words are in no sketch; a null language or
source is a group of its own; null and repeated ids and repeated rows are judged row by row; other
columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST_WORDS, REPEAT_PERCENT, LEAST_ROWS, SALTS, REACH = 50, 50, 200, 16, 3
_BLANK = "[\\x20\\x09-\\x0D]+"

#: measure -> (numerator, denominator, least spread in thousandths, whether low values lose too)
MEASURES = {
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 150, False),
    "repeats": ("n_repeat_words", "n_words", 100, False),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text holds twice or more."""
    n = F.size(words)
    word = lambda i: F.get(words, i)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i")))
    window = lambda s, j: F.get(s, j)["w"]
    # one-element arrays hold an intermediate result, so that it is computed once
    let = lambda x, f: F.transform(F.array(x), f)[0]
    twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, j: (x["w"] == F.when(j > 0, window(s, j - 1))) | (x["w"] == window(s, j + 1))))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n >= 3, covered).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang_key, source_key, the counts of each text and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a key for each value and one for null, which no value has
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select("doc_id", key("lang").alias("lang_key"), key("source").alias("source_key"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _BLANK), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    long = lambda x: x.cast("long")
    rows = rows.select(
        "doc_id", "lang_key", "source_key", long(F.size("words")).alias("n_words"),
        long(F.char_length(F.translate("text", " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        long(F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def measure(name: str) -> Column:
    """In thousandths, rounded down; null without words."""
    above, below, *_ = MEASURES[name]
    return F.when(F.col("n_words") > 0, F.expr(f"{above} * 1000 div greatest({below}, 1)"))


def bucket(x: Column) -> Column:
    """The least value that shares its first eight binary digits with x >= 0."""
    shift = F.greatest(F.length(F.bin(x)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketch(rows: DataFrame) -> DataFrame:
    """level 0, lang_key, source_key, measure, bucket, n."""
    tall = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(measure(m)).alias("bucket")) for m in MEASURES])).alias("m")
    counts = rows.where("n_words > 0").select("lang_key", "source_key", tall).groupBy("lang_key", "source_key", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit(0).alias("level"), "lang_key", "source_key", "measure", "bucket", "n")


def _level(level: int, lang: Column, source: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), lang.alias("lang_key"), source.alias("source_key"))


def levels() -> Column:
    """A group itself (0), all of its language (1), and all rows (2)."""
    return F.explode(F.array(_level(0, F.col("lang_key"), F.col("source_key")), _level(1, F.col("lang_key"), F.lit("")), _level(2, F.lit(""), F.lit(""))))


def merged(sketches: DataFrame) -> DataFrame:
    """The sketches, with those of each language (level 1) and of all rows (level 2)."""
    keys = ["level", "lang_key", "source_key", "measure", "bucket"]
    return sketches.select(levels().alias("g"), "measure", "bucket", "n").select("g.*", "measure", "bucket", "n").groupBy(*keys).agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame) -> DataFrame:
    """level, lang_key, source_key, measure, rows, q25, q75: the least bucket that so many rows reach."""
    keys = ["level", "lang_key", "source_key", "measure"]
    up = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sketches.withColumns({"upto": F.sum("n").over(up), "rows": F.sum("n").over(Window.partitionBy(*keys))})
    reach = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("rows"), F.col("bucket")))
    return sums.groupBy(*keys).agg(F.max("rows").alias("rows"), reach(1).alias("q25"), reach(3).alias("q75"))


def fences(sketches: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang_key, source_key and <measure>_low, <measure>_high: one row per group."""
    known = quartiles(merged(sketches))
    groups = sketches.select("lang_key", "source_key").distinct()
    asked = groups.select("lang_key", "source_key", levels().alias("g")).select("g.level", F.col("g.lang_key").alias("l"), F.col("g.source_key").alias("s"), "lang_key", "source_key")
    found = asked.join(known.withColumnsRenamed({"lang_key": "l", "source_key": "s"}), ["level", "l", "s"]).where((F.col("rows") >= least_rows) | (F.col("level") == 2))
    best = found.groupBy("lang_key", "source_key", "measure").agg(F.min_by(F.struct("q25", "q75"), "level").alias("q"))
    ends = []
    for m, (*_, floor, both) in MEASURES.items():
        spread = REACH * F.greatest(F.col("q.q75") - F.col("q.q25"), F.lit(floor))
        at = F.col("measure") == m
        ends += [F.max(F.when(at, F.col("q.q25") - spread if both else F.lit(0))).alias(f"{m}_low"), F.max(F.when(at, F.col("q.q75") + spread)).alias(f"{m}_high")]
    return best.groupBy("lang_key", "source_key").agg(*ends)


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with outside (the measures outside their group's limits, joined by commas) and kept."""
    copies = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    met = spread.join(copies, ["lang_key", "source_key", "salt"], "left").drop("salt")
    out = [F.when(~measure(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]
    met = met.withColumn("outside", F.concat_ws(",", *out))
    return met.withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))


def rules(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, kept and outside, of each row."""
    rows = written(measured(docs))
    limits = written(fences(written(sketch(rows)), least_rows))
    return judged(rows, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outside"
    )


def filtered(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of ``docs`` (all columns) that are kept, by a semi-join on ids; rows with a null id go."""
    keep = rules(docs, least_rows).groupBy("doc_id").agg(F.bool_and("kept").alias("_kept")).where("_kept").select("doc_id")
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns)


def _oracle() -> str:
    value = {m: f"(n.{a} * 1000 // greatest(n.{b}, 1))" for m, (a, b, *_) in MEASURES.items()}
    tall = " union all ".join(f"select l, s, '{m}' as measure, {v} as x from n where n_words > 0" for m, v in value.items())
    floors = "case measure " + " ".join(f"when '{m}' then {f}" for m, (*_, f, _b) in MEASURES.items()) + " end"
    low = "case when measure in (" + ", ".join(f"'{m}'" for m, (*_, b) in MEASURES.items() if b) + f") then q25 - {REACH} * greatest(q75 - q25, {floors}) else 0 end"
    outside = ", ".join(
        f"case when n.n_words > 0 and not {v} between (select low from lim where lim.l = n.l and lim.s = n.s and measure = '{m}') "
        f"and (select high from lim where lim.l = n.l and lim.s = n.s and measure = '{m}') then '{m}' end"
        for m, v in value.items()
    )
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce('=' || lang, '') as l, coalesce('=' || source, '') as s, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
tri as (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) as g from w),
twice as (select r, i from (select *, count(*) over (partition by r, g) as c from tri) where c > 1),
cover as (select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
n as (
  select r, doc_id, l, s, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words
  from w left join cover using (r)),
v as ({tall}),
b as (select *, (x >> greatest(length(bin(x)) - 8, 0)) << greatest(length(bin(x)) - 8, 0) as bucket from v),
lev as (select 0 as level, l, s, measure, bucket from b union all select 1, l, '', measure, bucket from b union all select 2, '', '', measure, bucket from b),
q as (select level, l, s, measure, count(*) as rows, quantile_disc(bucket, 0.25) as q25, quantile_disc(bucket, 0.75) as q75 from lev group by all),
g as (select distinct l, s from b),
pick as (
  select g.l, g.s, q.measure, q25, q75 from g join q on q.level = 2 or q.level = 1 and q.l = g.l or q.level = 0 and q.l = g.l and q.s = g.s
  where q.rows >= {LEAST_ROWS} or q.level = 2 qualify row_number() over (partition by g.l, g.s, q.measure order by q.level) = 1),
lim as (select l, s, measure, {low} as low, q75 + {REACH} * greatest(q75 - q25, {floors}) as high from pick),
o as (select n.*, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed, concat_ws(',', {outside}) as outside from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and outside = '' as kept, outside from o
"""


ORACLE = _oracle()
