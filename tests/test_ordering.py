"""Global row numbers with payload columns, over several files and partitions."""

from pyspark.sql import functions as F

from muralis.operators.ordering import global_rank


def test_numbers_are_unique_and_in_order(spark, tmp_path):
    rows = spark.range(300_000, numPartitions=8).select(
        (F.col("id") * 7919 % 300_007).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 5).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.rand(3).alias("other"))
    rows.write.parquet(f"{tmp_path}/rows")
    got = global_rank(spark.read.parquet(f"{tmp_path}/rows"), ["g", "k"], "place", start=5)
    assert got.columns == ["k", "g", "payload", "other", "place"]
    r = got.agg(F.count("*").alias("n"), F.count_distinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b")).first()
    assert tuple(r) == (300_000, 300_000, 5, 300_004)
    places = [(x.g is not None, x.g or 0, x.k) for x in got.orderBy("place").select("g", "k").collect()]
    assert places == sorted(places)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(2, "a", "x"), (None, "b", "y"), (1, "c", "z")], "part long, row string, n string")
    assert [tuple(r) for r in global_rank(df, ["part"], "place").orderBy("place").collect()] == [(None, "b", "y", 1), (1, "c", "z", 2), (2, "a", "x", 3)]
    assert global_rank(df.limit(0), ["part"], "place").collect() == []
