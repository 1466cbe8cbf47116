"""The pipeline's stages, chained, against versions in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewake.llm import bpe, decontaminate, quality_lm

WORDS = "river stone walk light green house winter north slow old paper water cloud road table seven bread garden train music".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n)) + "."


ITEM = "janet buys 12 kg of green stone for 30 dollars and walks slow north in winter light"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(80, i) for i in range(60)]
    texts += [texts[3], texts[3], texts[5] + " extra", f"{prose(20, 91)} {ITEM} {prose(20, 92)}", f"{prose(20, 93)} {ITEM.replace('12', '9')} {prose(20, 94)}", "xq zzkw qqpl wrrt vvbn kkjh xxzz qpwo " * 10]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (900, "", "en", "a", 0), (None, prose(70, 77), "en", "a", 5)]
    spark.createDataFrame(rows, SCHEMA).withColumn("tw_key", F.lit("x")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def chained(spark, folder, docs=None, tmp=None):
    docs = spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], folder).write.parquet(f"{tmp}/{name}")
        out.append(spark.read.parquet(f"{tmp}/{name}"))
    return out


def test_each_stage_decides_on_all_rows(spark, folder, tmp_path):
    docs, good, unique, clean, mixed, store = chained(spark, folder, tmp=tmp_path)
    for d in (good, unique, clean, mixed):
        assert d.columns == docs.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    keep = {r.doc_id for r in quality_lm.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    assert ids(good) == keep and 65 not in keep and len(keep) >= 60
    assert good.where("text is null").count() == 1
    dropped = {60, 61, 62} & ids(good)
    assert not dropped & ids(unique) and {3, 5} <= ids(unique) | (ids(docs) - ids(good))
    assert ids(unique) == ids(good) - dropped
    index = decontaminate.Index([1], [ITEM], decontaminate.WINDOW, decontaminate.LITERALS, decontaminate.SHORT_LITERALS)
    assert index.t.first.tolist()[-1] >= 13
    assert ids(clean) == ids(unique) - {63, 64}
    assert ids(mixed) <= ids(clean) and mixed.where("text is null or text = ''").count() == 0
    # the store holds each use's ids, in the order of the mix
    coder = bpe.encoding(bpe.default_ranks())[0]
    rows = [r for f in sorted({x for x in mixed.inputFiles()}) for r in spark.read.parquet(f).collect()]
    order = store.where("kind = 'recipe'").orderBy("position").collect()
    assert [r.doc_id for r in order] == [r.doc_id for r in rows]
    assert [r.n_ids for r in order] == [len(coder.encode_ordinary(r.text)) for r in rows]


def test_run_gives_the_same_store(spark, folder, tmp_path):
    want = chained(spark, folder, tmp=tmp_path)[-1].where("kind = 'recipe'").groupBy("doc_id", "root").count()
    got = corpus_pipeline.run(spark, folder).where("kind = 'recipe'").groupBy("doc_id", "root").count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_table(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert chained(spark, folder, empty, tmp_path)[-1].count() == 0
