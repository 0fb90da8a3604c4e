"""Places of rows within groups of any size, and one row per group beside all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.sources.files import scratch


def numbered_rows(df: DataFrame, by: list[str], order: list[str], out: str = "i", size: str | None = None) -> DataFrame:
    """``df`` with ``out``: the place (from 0) of a row in its group by ``order``; with ``size`` also the group's rows.

    Rows are dealt to ranges of (``by``, ``order``), sorted and written once; a
    row's place is its number in the range, less that of its group's first row
    there, plus the group's rows in earlier ranges. So no group and no table is
    one window. Null keys are a group; ties have any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "numbered")
    d = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_row", F.monotonically_increasing_id())
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path).withColumn("_part", F.shiftright("_row", 33))
    per = d.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))  # a row for each range and group in it
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*by, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_size"))
    d = beside(d, per, [*by, "_part"]).withColumn(out, F.col("_row") + F.col("_shift"))
    return d.select(*df.columns, out, *([F.col("_size").alias(size)] if size else []))


def beside(df: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    """Every row of ``df`` with the other columns of ``per``, which has one row for each group; null keys are a group. ``per`` is broadcast where Spark finds it small."""
    per = per.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(by)], *[c for c in per.columns if c not in by])
    same = F.lit(True)
    for n, k in enumerate(by):
        same = same & df[k].eqNullSafe(per[f"_k{n}"])
    return df.join(per, same).drop(*[f"_k{n}" for n in range(len(by))])
