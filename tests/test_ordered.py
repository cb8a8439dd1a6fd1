"""Sums in chunks are those of one window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ordered import running_sums


def test_sums_by_key_over_many_chunks(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 16).alias("bin"), "o_orderkey")
    got = running_sums(rows, F.shiftright("o_orderkey", 6), ["o_orderkey"], {"slot": F.lit(1)}, exclusive=True, by=["bin"])
    want = rows.withColumn("slot", F.row_number().over(Window.partitionBy("bin").orderBy("o_orderkey")) - 1)
    kept = lambda df: sorted(map(tuple, df.select("bin", "o_orderkey", F.col("slot").cast("long")).collect()))
    assert kept(got) == kept(want)
