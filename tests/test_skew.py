import random

from pyspark.sql import functions as F

from palimpsest.operators import skew


def test_positions_and_ranks_of_large_groups(spark):
    rnd = random.Random(1)
    rows = [("big", rnd.randrange(40), i) for i in range(400)] + [("small", i % 3, i) for i in range(9)] + [(None, 1, 0)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(4)
    order = [F.col("v").desc(), F.col("i")]
    whole = {(r.g, r.i): r.position for r in skew.positions(df, ["g"], order).collect()}
    split = {(r.g, r.i): r.position for r in skew.positions(df, ["g"], order, sort_rows=50).collect()}
    assert whole == split and len(whole) == len(rows)
    a = {(r.g, r.i): round(r.rank_share, 9) for r in skew.mean_ranks(df, ["g"], "v").collect()}
    b = {(r.g, r.i): round(r.rank_share, 9) for r in skew.mean_ranks(df, ["g"], "v", sort_rows=50).collect()}
    assert a == b


def test_join_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 30)], "k int, v int")
    per = df.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    assert sorted(map(tuple, skew.join_per_key(df, per, "k", "n").collect())) == sorted(map(tuple, df.join(per.drop("n"), "k").collect()))
    kept, best = skew.keep_highest(df, "k", "v")
    assert kept.count() == 29 and best.count() == 29
