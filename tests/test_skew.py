import random

from pyspark.sql import functions as F

from mailweave.operators import skew


def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", rng.randint(0, 50), i, rng.randint(1, 9))
            for i in range(3000)]
    data += [(None, 1, 5000, 1), (None, 0, 5001, 2)]
    return spark.createDataFrame(data, "k string, o int, i int, v int").repartition(7)


def test_hot_keys_are_the_large_ones(spark):
    assert [r.k for r in skew.hot_keys(rows(spark), "k", 500).collect()] == ["hot"]
    assert skew.hot_keys(rows(spark), "k", 10_000) is None


def test_split_keeps_every_row(spark):
    cold, hot = skew.split_by_keys(rows(spark), "k", skew.hot_keys(rows(spark), "k", 500))
    assert cold.count() + hot.count() == 3002
    assert cold.where("k is null").count() == 2
    assert skew.split_by_keys(rows(spark), "k", None)[1] is None


def test_ranged_equals_window(spark):
    df = rows(spark).where("k is not null")
    order = [F.col("o"), F.col("i")]
    pick = ["k", "i", "ordinal", "running"]
    want = {tuple(r) for r in skew.window_positions(df, "k", order, F.col("v")).select(pick).collect()}
    ranged = skew.ranged_positions(df, "k", order, F.col("v"))
    assert {tuple(r) for r in ranged.select(pick).collect()} == want
    # The hot key is spread over several tasks.
    assert ranged.where("k = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_number_rows(spark):
    df = rows(spark)
    got = skew.number_rows(df, [F.desc("o"), F.col("i")]).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(1, 3003))
    assert [(r.o, r.i) for r in got] == sorted(((r.o, r.i) for r in got), key=lambda x: (-x[0], x[1]))
