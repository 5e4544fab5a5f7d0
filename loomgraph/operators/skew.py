"""Joins in which one key may hold a third of all rows of one side, the other side having one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than this and more than a thousandth of all: there are at most HOT_SHARE of them.
HOT_ROWS, HOT_SHARE, SALTS = 100_000, 1000, 64


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys that hold so many rows that one task should not get them all; counted with partial aggregation."""
    total = df.count()
    if total <= HOT_ROWS:
        return []
    most = max(HOT_ROWS, total // HOT_SHARE)
    return [r[0] for r in df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > most) & F.col(key).isNotNull()).select(key).collect()]


def left_join_unique(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: list, spread_by: Column) -> DataFrame:
    """Left join to a side with one row per key. Rows of hot keys are spread over salts, their few matches repeated."""
    if not hot:
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    salt = F.when(F.col(left_key).isin(hot), F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col(right_key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = right.withColumn("_right_salt", F.explode(every))
    on = (F.col(left_key) == F.col(right_key)) & (F.col("_left_salt") == F.col("_right_salt"))
    return left.withColumn("_left_salt", salt).join(salted, on, "left").drop("_left_salt", "_right_salt")
