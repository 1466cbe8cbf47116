import os

import pytest
from pyspark.sql import functions as F

from tidewake.llm import quality_lm

D = "/root/testdata/sf0.1"


def test_limit_is_a_quantile_of_trusted_rates(spark):
    rows = [("a", 100.0 + i, 100) for i in range(1000)] + [("b", 300.0 + i * i, 100) for i in range(200)]
    scored = spark.createDataFrame(rows, "lang string, nll double, n long")
    got = {r.tw_of: (r.mean_rate, r.limit_rate) for r in quality_lm._rates(scored, "lang", "nll", "n", quality_lm.QUANTILE, 50.0).collect()}
    for lang, total in (("a", 1000), ("b", 200)):
        mean, limit = got[lang]
        over = sum((x + 50.0 * mean) / (k + 50.0) > limit + 1e-12 for of, x, k in rows if of == lang)
        assert over == round(total * (1 - quality_lm.QUANTILE))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_held_out_documents_of_both_labels(spark):
    d = spark.read.parquet(f"{D}/documents.parquet").where("lang = 'en'")
    lab = spark.read.parquet(f"{D}/labels.parquet")
    got = quality_lm.classify(d, lab.where("pmod(xxhash64(doc_id), 2) = 0"))
    held = got.join(lab.where("pmod(xxhash64(doc_id), 2) = 1 or quality = 0").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    held = held.join(d.select("doc_id", "text"), "doc_id").where("n_chars_scored > 0").toPandas()
    words = held.text.str[:60].str.split()
    one_word = words.map(lambda w: len(w) >= 6 and len(set(w[1:-1])) == 1) & (held.quality == 0)
    assert held.keep[held.quality == 1].mean() > 0.98
    assert held.keep[held.quality == 0].mean() < 0.08
    assert one_word.sum() >= 30 and held.keep[one_word].mean() < 0.3
