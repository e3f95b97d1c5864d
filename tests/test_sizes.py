"""Sizes as text, beyond those of the small tables."""

import duckdb
from pyspark.sql import functions as F

from quadrille.operators.views import human_size
from quadrille.plans.queries import ORACLES, QUERIES


def test_sizes_of_large_keys_are_those_of_the_sql(spark, tmp_path):
    # Around the limits of bytes, kB and MB, and of TB, which the SQL hasn't.
    keys = [0, 10, 11, 328, 329, 330, 10_521, 10_522, 149_999, 336_686, 336_687, 600_000, 9_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["fn22_human_size"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["fn22_human_size"]).fetchall())


def test_largest_unit(spark):
    size = spark.createDataFrame([(10 * 1024**4 - 1,), (10 * 1024**4,), (None,)], "size long")
    got = size.select(human_size(F.col("size")).alias("t"), human_size(F.col("size"), "GB").alias("g"), human_size(F.col("size"), "bytes").alias("b")).collect()
    assert [tuple(r) for r in got] == [("10240 GB", "10240 GB", "10995116277759 bytes"), ("10 TB", "10240 GB", "10995116277760 bytes"), (None, None, None)]
