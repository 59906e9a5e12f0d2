"""The corpus pipeline, stage by stage, on the smallest test tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    from txsieve.llm import ngram_join, packing, queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    columns = kept["start"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert kept[name].columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"].collect()}
    wrong = [d for d, q in labels.items() if q is not None and (d in good) != (q == 1)]
    assert len(wrong) <= 0.02 * len(labels)
    groups = ngram_join.near_copies(kept["quality"]).collect()
    assert {r.doc_id for r in kept["near_copies"].collect()} == {r.group_id for r in groups}
    assert kept["pii"].count() == kept["near_copies"].count() == kept["mixing"].count()
    assert not any("@" in r.text and ".example.com" in r.text for r in kept["pii"].collect())
    texts = {r.doc_id: r.text for r in kept["mixing"].collect()}
    total, seqs = {}, {}
    for r in kept["packing"].collect():
        tok = packing.token_ids(texts[r.doc_id], queries.vocabulary())
        assert zlib.crc32(tok[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == {d: len(packing.token_ids(t, queries.vocabulary())) for d, t in texts.items()}
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])


def test_sequences_follow_the_mix(spark, tmp_path):
    """Documents of one source are most of the rows; sequence ids rise with the weights' order."""
    from txsieve.llm import mixing, queries

    n = {"src0": 4400, "src1": 900, "src2": 700, "src3": 700}
    rows = [(s, "word " * (60 if s == "src0" else 8), "en") for s, k in n.items() for _ in range(k)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, (s, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", docs.doc_id - 1).withColumn("text", F.repeat(F.lit("long "), 9000)))
    corpus_pipeline.mixing_stage(spark, docs, SF).write.option("maxRecordsPerFile", 900).parquet(str(tmp_path / "mixing"))
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    want = {r.doc_id: r.mix_position for r in mixing.mix(docs, queries.MIX_WEIGHTS).collect()}
    assert {r.doc_id: r.mix_position for r in mixing.laid_out(mixed).collect()} == want
    packed = corpus_pipeline.packing_stage(spark, mixed, SF).collect()
    first = {}
    for r in sorted(packed, key=lambda r: r.sequence_id):
        first.setdefault(r.doc_id, r.sequence_id)
    order = sorted(first, key=first.get)
    assert len(order) == len(want)
    source = {i: s for i, (s, _, _) in enumerate(rows)} | {-1: "src0"}
    for lo, hi in ((0, 2048), (2048, 3000)):
        share = [sum(source[d] == s for d in order[lo:hi]) / (hi - lo) for s in n]
        assert lo or all(abs(x - q / 11) < 0.03 for x, q in zip(share, (4, 3, 2, 2), strict=True)), share
    ranges = {}
    for r in packed:
        ranges.setdefault(want[r.doc_id] // 2048, []).append(r.sequence_id)
    for k in range(max(ranges)):
        assert max(ranges[k]) < min(ranges[k + 1])
