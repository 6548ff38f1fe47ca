import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators.ordering import exact_quantile, unique_names, with_ordinal
from lumenfold.session import join_stats


def rows(spark, n=600):
    # key 0 owns a third of all rows and many equal positions
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).alias("key"),
        F.floor(F.col("id") * 7919 % 101).cast("bigint").alias("pos"), F.col("id").alias("tie"))


def test_ordinal_hot_key_equals_plain(spark):
    d = rows(spark)
    plain = with_ordinal(d, "key", F.col("pos"), ["tie"]).select("key", "pos", "tie", "k")
    split = with_ordinal(d, "key", F.col("pos"), ["tie"], hot_rows=20).select("key", "pos", "tie", "k")
    assert "_s" in split._jdf.queryExecution().analyzed().toString()  # the sliced path was taken
    assert sorted(plain.collect()) == sorted(split.collect())


def test_ordinal_is_a_numbering(spark):
    d = with_ordinal(rows(spark), "key", F.col("pos"), ["tie"], hot_rows=20)
    g = d.groupBy("key").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.countDistinct("k").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in g)


def test_ordinal_empty(spark):
    assert with_ordinal(rows(spark).limit(0), "key", F.col("pos"), ["tie"]).count() == 0


def test_exact_quantile_refines_to_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=300), np.full(200, 0.25), [1e6]])
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    for q in (0.0, 0.1, 0.5, 0.93, 1.0):
        assert np.isclose(exact_quantile(d, "v", q, bins=8, small=5), np.quantile(v, q))
    assert exact_quantile(d.limit(0), "v", 0.5) is None


def test_salted_join_equals_broadcast(spark):
    d = rows(spark)
    stats = d.groupBy("key").agg(F.avg("pos").alias("m"))
    a = join_stats(d, stats, ["key"]).select("key", "tie", "m")
    b = join_stats(d, stats, ["key"], rows=3).select("key", "tie", "m")
    assert sorted(a.collect()) == sorted(b.collect())
    assert "_salt" in b._jdf.queryExecution().analyzed().toString()


def test_unique_names(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4)], "name string, o int")
    got = {r["o"]: r["unique_name"] for r in unique_names(d, "name", ["o"]).collect()}
    assert got == {1: "a", 2: "a_2", 3: "b", 4: "a_3"}
