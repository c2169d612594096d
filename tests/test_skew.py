"""Joins on a hot key: one key holds a third of the rows, no side may be broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallywright.operators import ranking
from tallywright.operators.joins import attach_account_map, attach_headers
from tallywright.schema import ACCOUNT_MAP, conform

#: Makes small test data count as skewed.
TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for key, value in TIGHT.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def lines(spark, rows=60_000):
    return spark.range(0, rows, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("code"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )


def final_plan(df) -> tuple[int, str]:
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(rows), plan


def test_hot_document(tight):
    gl = lines(tight)
    headers = gl.select("code").distinct().withColumn("kind", F.lit("SA"))
    rows, plan = final_plan(attach_headers(gl, headers, ["code"]))
    assert rows == 60_000 and "skew=true" in plan


def test_hot_account(tight):
    gl = lines(tight).withColumnRenamed("code", "account_code")
    accounts = gl.select(F.col("account_code").alias("detail_code"), F.lit("line").alias("fs_name"))
    accounts = conform(accounts.distinct(), ACCOUNT_MAP)
    rows, plan = final_plan(attach_account_map(gl, accounts))
    assert rows == 60_000 and "skew=true" in plan


def test_flood_of_equal_changes(tight):
    df = lines(tight).select(
        F.lit("g").alias("g"),
        F.col("text"),
        F.when(F.col("code") == "hot", F.lit(0))
        .otherwise(F.xxhash64("text") % 10**9)
        .cast("decimal(28,2)")
        .alias("v"),
    ).withColumn("v", F.abs("v"))
    rows, plan = final_plan(ranking.rank_all(df, ["g"], "v"))
    assert rows == 60_000 and "skew=true" in plan


def test_one_group_of_sizes_with_equal_leading_digits_spreads(spark):
    from tallywright.operators.ranking import PARTS, parts_of

    n = 200_000
    df = spark.range(n).select(
        F.lit("g").alias("g"), F.col("id"), (F.lit(123_400_000_000) + F.col("id")).cast("decimal(18,2)").alias("v")
    )
    ranked = ranking.rank_all(df, ["g"], "v")
    assert ranked.where(F.col("rank") != F.lit(n) - F.col("id")).count() == 0
    sizes = parts_of(df.groupBy("g", "v").count().withColumnRenamed("count", "_n"), ["g"], "v").groupBy("_part").count()
    counts = [r["count"] for r in sizes.collect()]
    assert len(counts) == PARTS and max(counts) <= 3 * n // PARTS
