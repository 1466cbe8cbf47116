"""Queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations



from . import curriculum, decontaminate, id_store, quality_lm, secret_scan, simhash_dedup, token_prefix, toxicity, warc_normalise, weak_rules


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash_dedup.near_duplicates(_t(spark, sf_dir, "documents")).drop("ckey", "rid")


def op2_toxicity(spark, sf_dir):
    return toxicity.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_quality_classifier(spark, sf_dir):
    return quality_lm.classify(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op4_secret_scans(spark, sf_dir):
    return secret_scan.findings(_t(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op6_mixing_sources(spark, sf_dir):
    return curriculum.positions(_t(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    return token_prefix.prefix_counts(_t(spark, sf_dir, "documents"))


def op8_token_id_store(spark, sf_dir):
    return id_store.store(_t(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc_normalise.pages_index(spark, _t(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return weak_rules.posteriors(_t(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_toxicity, op3_quality_classifier, op4_secret_scans, op5_benchmark_decontamination,
        op6_mixing_sources, op7_token_counts, op8_token_id_store, op9_warc, op10_quality_rules, pipeline,
    )
}

ORACLES = {"op6_mixing_sources": curriculum.POSITIONS_SQL}
