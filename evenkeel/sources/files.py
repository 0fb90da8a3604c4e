"""Scans and sinks: partitioned sets, run documents, file inventories, link tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.sealed import write_missing  # noqa: F401  part of this module's interface


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share (``spark.checkpoint.dir``); a temporary one in local runs without that setting."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        given = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="evenkeel-")
        _OWN[app] = given
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitioned_set(spark: SparkSession, root: str, roster: DataFrame | None = None, key: str = "participant_id") -> DataFrame:
    """A Parquet set partitioned by ``key``; with a roster only its partitions are read (a join on the partition column prunes them)."""
    df = spark.read.parquet(root)
    return df if roster is None else df.join(roster.select(key).distinct(), key, "left_semi")


def recursive_parquet(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """CSV or TSV with a header; rows without any value go."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, encoding="UTF-8").dropna("all")


def run_documents(spark: SparkSession, root: str, schema: str, attributes: dict[str, str]) -> DataFrame:
    """One JSON document per file as a row, with attributes taken from its path by patterns (first group)."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(root)
    return df.select("*", *[F.regexp_extract(F.col("_metadata.file_path"), p, 1).alias(n) for n, p in attributes.items()])


def flattened(df: DataFrame, column: str, sep: str = "__") -> DataFrame:
    """A struct column as ``column__field`` columns; an array of structs gives a row for each item."""
    kind = df.schema[column].dataType
    if kind.typeName() == "array":
        df, kind = df.withColumn(column, F.explode(column)), kind.elementType
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[f].alias(f"{column}{sep}{f}") for f in kind.fieldNames()])


def documents_of(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """``key, document``: each group's other columns as one JSON document with an array ``name`` of objects, in order of their values. A group is one report's rows."""
    rest = [c for c in df.columns if c not in key]
    rows = F.array_sort(F.collect_list(F.struct(*rest)))
    return df.groupBy(*key).agg(F.to_json(F.struct(rows.alias(name))).alias("document"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes, sha256`` of every file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """``n_files, size_bytes, sha256``: one digest over the sorted ``path`` below ``root`` and ``sha256`` of all files.

    Lines are sorted and hashed in 4,096 shares by their own hash, then the
    shares' digests in order, so that no task holds the lines of all files.
    """
    line = F.concat_ws(" ", F.element_at(F.split("path", F.lit(root.split("://")[-1].strip("/")), 2), -1), "sha256")
    d = files.select("size_bytes", line.alias("line")).withColumn("share", F.substring(F.sha2("line", 256), 1, 3))
    share = d.groupBy("share").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("share", "digest"))), lambda x: x["digest"]), "\n")  # 4,096 at most
    return share.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"), F.sha2(every, 256).alias("sha256"))


def profile(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes by suffix; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def headers(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """``path, header``: the first line of every delimited file, read as text."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    d = df.select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    return d.groupBy("path").agg(F.min_by("value", "at").alias("header"))


def report(df: DataFrame, path: str, form: str = "csv") -> int:
    """Write a report as CSV or JSON; returns the rows that lie there. Line ends within values are kept in quotes."""
    out = df.write.mode("overwrite")
    out.option("header", True).csv(path) if form == "csv" else out.json(path)
    read = df.sparkSession.read.schema(df.schema)
    return (read.csv(path, header=True, multiLine=True, enforceSchema=True) if form == "csv" else read.json(path)).count()


def checked_report(df: DataFrame, path: str, form: str = "csv") -> DataFrame:
    """``report`` and what lies there after it: ``n_rows, n_files, size_bytes, sha256`` (``tree_digest``)."""
    n = report(df, path, form)
    return tree_digest(inventory(df.sparkSession, path), path).select(F.lit(n).cast("long").alias("n_rows"), "*")


def links(pages: DataFrame, html: str = "html", keep: str = ".*") -> DataFrame:
    """``href`` and ``label`` of every anchor of a page whose target matches ``keep``."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    d = pages.withColumn("_a", F.explode(anchors))
    d = d.withColumn("href", F.regexp_extract("_a", r'(?is)href="([^"]*)"', 1)).withColumn("label", F.trim(F.regexp_replace(F.regexp_extract("_a", r"(?is)>(.*)</a>$", 1), r"<[^>]*>", "")))
    return d.where(F.col("href").rlike(keep)).drop("_a", html)


def roster(listing: DataFrame, unit: str, required: dict[str, str], excluded: DataFrame | None = None) -> DataFrame:
    """``unit, include, reason`` from a file listing with ``path``: a unit needs a file for every pattern of ``required``; excluded units go."""
    found = [F.max(F.col("path").rlike(p).cast("int")).alias(n) for n, p in required.items()]
    out = listing.groupBy(unit).agg(*found)
    if excluded is not None:
        out = out.join(excluded.select(unit).distinct(), unit, "left_anti")
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(n) == 0, F.lit(n)) for n in required]), lambda x: x.isNotNull()), ",")
    return out.select(unit, (missing == "").alias("include"), F.when(missing != "", F.concat(F.lit("missing "), missing)).alias("reason"))
