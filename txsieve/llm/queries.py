"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprint, hard_negatives, license_scan, mixing, ngram_join, packing, pii, quality, quality_rules, topk_search, toxicity, url_filter
from .common import crc_mod, table

#: Target weights of the mix; every other source has weight 1.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 4) == 2
    model = quality.fit(docs, labels, "quality", ~held)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op6_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.fit(docs, labels, "toxic", ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.spans_of(docs, pii.fit(docs)))


def op9_bayes_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0)


def op11_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_gam,
        op3_best_fit_packing,
        op4_url_filter,
        op5_pfair_mixing,
        op6_weighted_fingerprint,
        op7_subword_toxicity,
        op8_pii_semi_markov,
        op9_bayes_jaccard_join,
        op10_pivot_top_k,
        op11_adaptive_rules,
        op12_hard_negatives,
        op13_collocations,
        pipeline,
    )
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle(),
    "op5_pfair_mixing": mixing.mix_oracle(MIX_WEIGHTS),
    "op9_bayes_jaccard_join": ngram_join.ORACLE,
    "op10_pivot_top_k": topk_search.ORACLE,
    "op11_adaptive_rules": quality_rules.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
