"""Helpers shared by the corpus operators: intermediate tables, hashing, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder
    is made; on a cluster an unset folder is an error, as executors would not
    see each other's files.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="evenkeel-")
    return _OWN[app]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what
    came before, and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of a value's text, modulo ``m``; null stays null."""
    return F.crc32(col.cast("string").cast("binary")) % m


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a, b)``: returns ``(node, root)``, root = least node.

    Alternating large-star and small-star rounds: every round is two
    aggregations and two joins on the edge table, which is cut after it; the
    number of rounds is logarithmic in the longest path. Isolated nodes do not
    appear. A hub with very many links is one key of a plain equi-join, which
    adaptive execution splits.
    """
    def sign(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return (r["n"], r["h"])

    e = cut(edges.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    last = sign(e)
    while last[0]:
        # every node's larger neighbours go to its least neighbour (or itself) ...
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        far = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), name)
        # ... and every node's smaller neighbours, with the node, to the least of them
        low = far.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(far.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = sign(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
