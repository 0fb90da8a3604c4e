"""The given tables in the roles of the data model, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions.levels import clip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def second_of_day(c: str):
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("double")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric facts from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 3).alias("dataset"), F.col("user_id").alias("unit"), F.col("event_id").alias("trial"), second_of_day("ts").alias("t"), F.col("event_type").alias("level"), "value")


FACTS = "facts AS (SELECT user_id % 3 AS dataset, user_id AS unit, event_id AS trial, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS t, event_type AS level, value FROM events)"


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model signatures from ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), (F.col("l_suppkey") % 20).alias("replicate"), F.col("l_linenumber").alias("bin"), (F.col("l_linestatus") == "F").alias("correct"),
                     (F.col("l_extendedprice") / 1000).alias("gain"), clip(F.col("l_discount") * 5 + 0.05, 0.0, 1.0).alias("broadcast"), (F.col("l_tax") * 5 + 0.05).alias("persistence"), (F.col("l_quantity") / 51).alias("concentration"))


SIGNATURES = """sig AS (SELECT l_returnflag AS model, l_suppkey % 20 AS replicate, l_linenumber AS bin, l_linestatus = 'F' AS correct, l_extendedprice / 1000 AS gain,
 greatest(0.0, least(1.0, l_discount * 5 + 0.05)) AS broadcast, l_tax * 5 + 0.05 AS persistence, l_quantity / 51 AS concentration FROM lineitem)"""

METRICS = ["gain", "broadcast", "persistence", "concentration"]
