"""Adaptive quality rules, hard negatives and collocations against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from txsieve.llm import collocations, hard_negatives, quality_rules

from .test_operators import ODD, docs, prose

# ---- 11 quality rules

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def counts(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(SYMBOL.findall(text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_of_rules_against_brute_force(spark):
    r = random.Random(2)
    texts = [*ODD, "a b c a b c", "a a a a", "a b c d a b", "x\nx\n \ny\nx", "\x0b\x0c # & |<>", "é😀 é😀\té😀 b", None]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(0, 12))) for _ in range(200)]
    got = {x.doc_id: x for x in quality_rules.rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts(t), t
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_fences_follow_their_group(spark):
    """A share of symbols that is usual in one source is an outlier in another; small groups take their language's limits."""
    tables = [prose(100, i) + " |" * 20 for i in range(300)]
    plain = [prose(100, 1000 + i) for i in range(300)]
    odd = [prose(100, 5000) + " |" * 20, prose(100, 5001) + " |" * 20, prose(100, 5002)]
    d = docs(spark, [*tables, *plain, *odd], sources=["t"] * 300 + ["p"] * 300 + ["p", "new", None]).withColumn("salt", F.lit("clash"))
    got = {x.doc_id: x for x in quality_rules.rules(d).collect()}
    assert all(got[i].kept for i in range(600))
    assert not got[600].kept and got[600].outside == "symbols"
    assert got[601].kept and got[602].kept  # half of the language has such tables
    assert quality_rules.filtered(d).columns == d.columns and quality_rules.filtered(d).count() == 602
    again = quality_rules.rules(d.unionByName(d).withColumn("lang", F.lit(None).cast("string")))
    assert again.count() == 1206 and again.where("kept").count() > 0
    assert quality_rules.rules(docs(spark, [])).count() == 0


def test_sketches_merge_and_are_close(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("="), (F.col("id") % 2).cast("string")).alias("lang_key"), F.concat(F.lit("="), (F.col("id") % 5).cast("string")).alias("source_key"),
        F.lit(1000).cast("long").alias("n_words"), (F.col("id") * F.col("id")).alias("word_chars"), F.col("id").alias("n_symbols"),
        F.lit(1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"),
    )
    q = {(x.level, x.lang_key, x.source_key, x.measure): x for x in quality_rules.quartiles(quality_rules.merged(quality_rules.sketch(rows))).collect()}
    every = q[2, "", "", "word_length"]
    assert every.rows == 4000 and abs(every.q75 - 2999**2) <= 2999**2 / 128 and abs(every.q25 - 999**2) <= 999**2 / 128
    assert q[0, "=1", "=3", "symbols"].rows == 400 and len(q) == 4 * (10 + 2 + 1)
    halves = quality_rules.sketch(rows.where("n_symbols < 1500")).unionByName(quality_rules.sketch(rows.where("n_symbols >= 1500")))
    merged = {(x.level, x.lang_key, x.source_key, x.measure): x for x in quality_rules.quartiles(quality_rules.merged(halves)).collect()}
    assert merged == q


# ---- 12 hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    rows = sorted({i: (i, label, v) for i, label, v in sorted(rows, reverse=True)}.values())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m) for j, m, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, k) for s, k, m in scored if m != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("bucket_rows", "anchor_block"), [(4096, 1024), (16, 4)])
def test_hard_negatives_against_brute_force(spark, bucket_rows, anchor_block):
    r = np.random.default_rng(4)
    centres = r.normal(0, 60, (6, 8))
    rows = [(i, int(r.integers(0, 4)), np.floor(centres[r.integers(0, 6)] * r.choice([0.2, 1, 1.5]) + r.normal(0, 15, 8)).astype(int).tolist()) for i in range(240)]
    rows += [(i, 1, [3] * 8) for i in range(240, 260)]  # ties
    rows += [(260, 9, [5] * 8), (265, 2, [0] * 8), (270, 2, [-7] * 3), (275, 2, [])]
    d = spark.createDataFrame([*rows, (None, 1, [1]), (280, None, [1]), (5, 3, [9] * 8)], "vec_id long, label long, vec array<long>").withColumn("lane", F.lit("clash"))
    got = hard_negatives.mine(d, F.col("vec_id") % 5 == 0, bucket_rows=bucket_rows, anchor_block=anchor_block).collect()
    want = brute_negatives([x for x in [*rows, (5, 3, [9] * 8)] if x[2]], lambda i: i % 5 == 0)
    assert sorted(tuple(x) for x in got) == want and len(want) > 500
    assert hard_negatives.mine(d.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(d.where("vec_id = 260"), F.lit(True)).count() == 0


def test_feasible_ranges_keep_all_that_reach():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 50, (500, 16)) * r.choice([0.9, 1.0], (500, 1)))
    b = hard_negatives.Bucket(np.arange(500), np.zeros(500), x)
    spared = 0
    for q in np.floor(r.normal(0, 50, (20, 16))):
        scores = x @ q
        for floor in (-np.inf, -1e4, 0.0, 1.0, np.quantile(scores, 0.9), scores.max(), scores.max() + 1):
            rows = set(b.feasible(q, floor).tolist())
            assert set(np.flatnonzero(scores >= floor).tolist()) <= rows
            spared += 500 - len(rows)
    assert spared > 1000


def test_coordinates_spare_work(spark):
    """Vectors in groups: some of the scores need not be computed."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 100, (40, 24))
    rows = [(i, i // 40 % 2, np.floor(centres[i % 40] + r.normal(0, 4, 24)).astype(int).tolist()) for i in range(2000)]
    d = spark.createDataFrame(rows, "vec_id long, label long, vec array<long>")
    tally = spark.sparkContext.accumulator(0)
    out = hard_negatives.mine(d, F.col("vec_id") % 20 == 0, positives=3, negatives=3, low=80, high=100, bucket_rows=400, tally=tally)
    assert out.count() > 500 and tally.value < 0.8 * 100 * 2000


# ---- 13 collocations


def brute_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            c.update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        wide = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {(p[i : i + m], a) for p, a in wide.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        found = []
        for p, a in wide.items():
            if (p, a) not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations_against_brute_force(spark):
    r = random.Random(9)
    frames = ["New York City is big", "in the end of the day", "a\tb c", "Éa b. c,d;e", "x y z w v"]
    texts = list(ODD)
    for _ in range(150):
        w = []
        for _ in range(r.randrange(1, 30)):
            w += r.choice(frames).split(" ") if r.random() < 0.5 else [r.choice("abcdefg")]
        texts.append(" ".join(w) + r.choice(("", ".", "\n", " !?")))
    texts += texts[-20:] * 3 + ["a " * 3000, "b, " * 500, " q \x00 q", "\n\n..", " . a ."]
    langs = [None if i % 7 == 0 else ("en" if i % 3 else "fr") for i in range(len(texts))]
    d = docs(spark, texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id").withColumn("words", F.lit("clash"))
    for least, top in ((3, 2000), (10, 15)):
        got = collocations.mine(d, least, top).collect()
        want = brute_collocations(list(zip(langs, texts, strict=True)), least, top)
        assert sorted(tuple(x) for x in got) == want and len(want) > 20
    assert collocations.mine(docs(spark, [])).count() == 0


def test_chunks_cover_each_token_once(monkeypatch):
    monkeypatch.setattr(collocations, "LONGEST", 40)
    texts = [prose(700, 1), "a " * 300, "", None, prose(3, 2), "x. y", prose(700, 1) + " tail"]
    s = collocations.Stream(texts)
    text, chunk, owned = s.chunks()
    words = s.words.to_pylist()
    for i in range(len(texts)):
        tokens = [words[k] for k in s.ids[s.text == i].tolist()]
        at = 0
        for t, c, o in zip(text.tolist(), chunk.to_pylist(), owned.tolist(), strict=True):
            if t == i:
                assert c.split(" ") == tokens[at : at + o + collocations.OVERLAP] and 0 < o <= 40
                at += o
        assert at == len(tokens)
    first, last = (set(chunk.filter(np.equal(text, i)).to_pylist()) for i in (0, 6))
    assert len(first & last) >= 0.8 * len(first)  # borders follow the words, so a copy has the same chunks


def test_large_products_are_exact(spark):
    big = 10**13
    found = spark.createDataFrame([("en", "", 1, 10**14), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 3)], "lang string, phrase string, words int, n long")
    got = collocations.scored(found).collect()
    assert [(x.phrase, x.score) for x in got] == [("a b", 1000 * (big - 3) * 10**14 // (big * (big + 7)))]
    assert math.isclose(got[0].score, 10_000, rel_tol=0.01)
