"""Restartable partitioned writes in two phases.

An attempt writes its partitions to a folder of its own (``path.attempts/<id>/data``)
and then, in one rename, its manifest: every partition with its rows, files,
sizes and a digest over these. Only an attempt with a manifest is published. For
each of its partitions it claims a name (``path.claims``), which only one
attempt can, and moves what it has claimed into ``path``; a folder that lies
there without a claim is what a broken run left, and gives way. Last, the claimed
partitions go into the index (``path.index``), and the attempt is marked.

A run that breaks before its manifest leaves nothing that counts. One that
breaks later is finished by the next call, as claims and moves can be repeated.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources import store


def _written(spark: SparkSession, data: str, schema, keys: list[str]) -> DataFrame:
    """``keys, folder, n_rows`` of the partitions in an attempt; key values have the types of ``schema``, as they were written."""
    d = spark.read.schema(schema).parquet(data)
    below = F.element_at(F.split(F.col("_metadata.file_path"), "/data/", -1), -1)
    return d.select(*keys, F.regexp_replace(below, "/[^/]*$", "").alias("folder")).groupBy(*keys, "folder").agg(F.count(F.lit(1)).alias("n_rows"))


def prepare(df: DataFrame, path: str, keys: list[str]) -> str | None:
    """First phase: the partitions of ``df`` in an attempt of their own, with its manifest; returns its id, None for no rows."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    root = f"{path}.attempts/{attempt}"
    df.write.partitionBy(*keys).option("compression", "zstd").parquet(f"{root}/data")
    found = []
    for r in _written(spark, f"{root}/data", df.schema, keys).select("folder", "n_rows").collect():  # one row for each partition
        folder = unquote(r["folder"])
        size = store.sizes(spark, f"{root}/data/{folder}")
        lines = "\n".join(f"{n} {b}" for n, b in sorted(size.items()))
        found.append({"folder": folder, "n_rows": r["n_rows"], "files": size, "digest": hashlib.sha256(lines.encode()).hexdigest()})
    if not found:
        return None
    store.write_whole(spark, f"{root}/manifest", json.dumps(found))
    return attempt


def manifest(spark: SparkSession, path: str, attempt: str) -> list[dict]:
    return json.loads(store.read_text(spark, f"{path}.attempts/{attempt}/manifest"))


def publish(spark: SparkSession, path: str, attempt: str, schema, keys: list[str]) -> None:
    """Second phase of an attempt; may be repeated, and by several at once."""
    root = f"{path}.attempts/{attempt}"
    won = []
    for part in manifest(spark, path, attempt):
        folder = part["folder"]
        claim = f"{path}.claims/{hashlib.sha256(folder.encode()).hexdigest()}"
        if not store.write_once(spark, claim, attempt) and store.read_text(spark, claim) != attempt:
            continue  # another attempt has it
        won.append(part)
        if store.exists(spark, f"{root}/data/{folder}"):
            store.move(spark, f"{path}/{folder}", f"{root}/replaced/{folder}")  # what a broken run left
            store.move(spark, f"{root}/data/{folder}", f"{path}/{folder}")
        there = store.sizes(spark, f"{path}/{folder}")
        if there != part["files"]:
            raise ValueError(f"{path}/{folder} does not hold the files of its manifest")
    if won:
        rows = spark.createDataFrame([(p["folder"], p["n_rows"]) for p in won], "folder string, n_rows long")
        parts = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{p['folder']}" for p in won])
        inside = parts.select(*keys, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("at")).dropDuplicates(["at"])
        steps = -len(keys)
        inside = inside.withColumn("folder", F.url_decode(F.replace(F.substring_index("at", "/", steps), F.lit("+"), F.lit("%2B"))))
        inside.join(rows, "folder").select(*keys, "n_rows").coalesce(1).write.mode("append").parquet(f"{path}.index")
    store.write_once(spark, f"{root}/sealed", "")
    store.remove(spark, f"{root}/data")  # partitions that another attempt had claimed


def sealed_index(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """``keys, n_rows`` of the sealed partitions, None where there are none yet; an attempt that was finished twice counts once."""
    return spark.read.parquet(f"{path}.index").dropDuplicates(keys) if store.exists(spark, f"{path}.index") else None


def write_missing(df: DataFrame, path: str, keys: list[str], configuration: dict | None = None) -> DataFrame:
    """Write the partitions of ``df`` (by ``keys``) that ``path`` has not sealed; returns the index of all (``keys``, ``n_rows``).

    Finished partitions are those of the index, and only what an attempt wrote
    and counted gets there: partitions that lie in ``path`` otherwise don't
    count and are replaced whole once a call brings them. Several writers may
    run at once; of a partition that two of them write one's rows stay, whole.
    ``path.meta`` holds the digest of the configuration, and another
    configuration is an error. Null keys are a partition of their own. What
    comes to the driver is one row for each partition and file.
    """
    spark = df.sparkSession
    digest = hashlib.sha256(json.dumps(configuration or {}, sort_keys=True, default=str).encode()).hexdigest()
    meta = f"{path}.meta"
    if not store.write_once(spark, meta, json.dumps({"configuration_sha256": digest}) + "\n"):
        before = spark.read.json(meta).first()["configuration_sha256"]
        if before != digest:
            raise ValueError(f"{path} was written with another configuration: {before}, not {digest}")
    for attempt in store.names(spark, f"{path}.attempts"):
        root = f"{path}.attempts/{attempt}"
        if store.exists(spark, f"{root}/manifest") and not store.exists(spark, f"{root}/sealed"):
            publish(spark, path, attempt, df.schema, keys)
    done, rest = sealed_index(spark, path, keys), df
    if done is not None:
        done = done.select(*[F.col(k).alias(f"_{k}") for k in keys])
        rest = df.join(done, [df[k].eqNullSafe(done[f"_{k}"]) for k in keys], "left_anti")
    attempt = prepare(rest, path, keys)
    if attempt:
        publish(spark, path, attempt, df.schema, keys)
    found = sealed_index(spark, path, keys)
    return found if found is not None else df.limit(0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
