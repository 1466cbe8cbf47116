from tidewake.llm import curriculum


def test_a_small_source_is_used_until_its_demand_is_met(spark):
    rows = [(i, "w " * 50, f"big{i % 19}") for i in range(19 * 100)] + [(10_000 + i, "w " * 10, "small") for i in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = curriculum.positions(d).toPandas()
    total, p = 95_100, 100 / 95_100
    s = 19 * (5000 / 95_100) ** 0.5 + p**0.5
    demand = total * (0.25 * p + 0.75 * p**0.5 / s)
    small = got[got.source == "small"]
    assert demand > 500 and abs(small.n_tokens.sum() - demand) <= 10
    assert small.epoch.max() == int(demand // 100) and small.position.max() > 0.95
    assert curriculum.positions(d, max_epochs=4).where("source = 'small'").count() == 40
    assert curriculum.mixed(d).where("source = 'small'").count() == len(small)
