import random

import pytest
from pyspark.sql import functions as F

from tidewake.llm import id_store


@pytest.fixture(scope="module")
def rows(spark):
    text = lambda i: " ".join(random.Random(i).choice(["river", "stone", "walk", "light"]) + str(i * j) for j in range(200))
    return id_store.store(spark.createDataFrame([(i, text(i)) for i in range(6)] + [(None, text(9)), (None, None), (7, ""), (1, text(1))], "doc_id long, text string")).cache()


def problems(rows):
    return {r.problem for r in id_store.verify(rows).collect()}


def test_whole_store_holds(rows):
    assert problems(rows) == set()


def test_lost_and_swapped_recipes_and_counts(rows):
    recipe = F.col("kind") == "recipe"
    assert problems(rows.where(~(recipe & F.col("doc_id").eqNullSafe(3)))) == {"a leaf has no recipe"}
    other = rows.where(recipe & (F.col("doc_id") == 2)).withColumn("doc_id", F.lit(3).cast("long"))
    assert problems(rows.where(~(recipe & F.col("doc_id").eqNullSafe(3))).unionByName(other)) == {"a leaf has no recipe", "the recipe isn't in the manifest"}
    assert problems(rows.where("kind <> 'manifest'")) == {"the recipe isn't in the manifest"}
    assert problems(rows.withColumn("n_ids", F.when(recipe, F.col("n_ids") + 1).otherwise(F.col("n_ids")))) == {"n_ids differ from the chunks"}


def test_streams_fail_without_a_chunk(rows):
    key = rows.where("kind = 'chunk'").orderBy("key").first().key
    less = rows.where(~((F.col("kind") == "chunk") & (F.col("key") == F.lit(bytes(key)))))
    assert "a chunk is missing" in problems(less)
    with pytest.raises(Exception, match="a chunk of the recipe is missing"):
        id_store.streams(less).collect()
