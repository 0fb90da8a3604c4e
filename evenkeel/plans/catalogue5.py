"""Queries over sources, sinks and streams: written copies of the given tables, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.plans.catalogue import SQL, query
from evenkeel.plans.tables import table
from evenkeel.sources import files
from evenkeel.streaming import ingest


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderstatus, o_orderpriority, count(*) n_rows FROM orders GROUP BY ALL")
def sealed_write(spark, sf_dir):
    """Two runs of one restartable write: half of the partitions, then all."""
    path, keys = files.scratch(spark, "sealed"), ["o_orderstatus", "o_orderpriority"]
    files.write_missing(_orders(spark, sf_dir).where("o_orderpriority < '3'"), path, keys, {"source": "orders"})
    return files.write_missing(_orders(spark, sf_dir), path, keys, {"source": "orders"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')")
def partitioned_read(spark, sf_dir):
    """A partitioned set through a roster of its partitions."""
    path = files.scratch(spark, "set")
    _orders(spark, sf_dir).write.partitionBy("o_orderstatus").parquet(path)
    roster = spark.createDataFrame([("F",), ("P",)], "o_orderstatus string")
    return files.partitioned_set(spark, path, roster, "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def recursive_read(spark, sf_dir):
    path = files.scratch(spark, "tree")
    _orders(spark, sf_dir).write.partitionBy("o_orderpriority", "o_orderstatus").parquet(path)
    return files.recursive_parquet(spark, path).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_read(spark, sf_dir):
    path = files.scratch(spark, "tsv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path, sep="\t")
    return files.delimited(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT r_regionkey::VARCHAR AS region, r_name AS name FROM region")
def run_document_read(spark, sf_dir):
    """One JSON document per file, with an attribute from its path."""
    path = files.scratch(spark, "runs")
    table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("name")).write.partitionBy("r_regionkey").json(path)
    return files.run_documents(spark, path, "name string", {"region": "r_regionkey=([^/]+)"})


@query("SELECT o_orderstatus, count(*) n, true AS written FROM orders GROUP BY ALL")
def report_sink(spark, sf_dir):
    """A report, its row count as observed on the way, and the digest of its files."""
    path = files.scratch(spark, "report")
    kinds = _orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    seen = files.checked_report(kinds, path).first()  # one row
    back = files.delimited(spark, path, "o_orderstatus string, n bigint", ",")
    return back.withColumn("written", F.lit(len(seen["sha256"]) == 64 and seen["n_rows"] == back.count()))


@query("SELECT true AS same, true AS differs, true AS headed")
def tree_integrity(spark, sf_dir):
    """Digest of a written tree: the same when read again, another once a file is added; every delimited file starts with the header."""
    path = files.scratch(spark, "files")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.write.option("header", True).partitionBy("n_regionkey").csv(path)
    digest = lambda: files.tree_digest(files.inventory(spark, path), path).first()["sha256"]  # noqa: E731  one row
    first, again = digest(), digest()
    headed = files.headers(spark, path).agg(F.bool_and(F.col("header") == "n_nationkey,n_name").alias("headed"))
    headed = headed.select(F.lit(first == again).alias("same"), "headed").first()
    nation.limit(1).write.mode("append").option("header", True).partitionBy("n_regionkey").csv(path)
    return spark.createDataFrame([(headed["same"], digest() != first, headed["headed"])], "same boolean, differs boolean, headed boolean")


@query("SELECT event_id, user_id, event_type FROM events")
def streamed_append(spark, sf_dir):
    """The log ingested as a stream, twice; the second pass adds nothing."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    source, target = files.scratch(spark, "log"), files.scratch(spark, "ingested")
    e.write.parquet(source)
    for _ in range(2):
        ingest.append_new(spark, source, e.schema, target, ["event_id"], files.scratch(spark, "progress"))
    return spark.read.parquet(target)


def streamed_windows(spark, sf_dir):
    """Trigger windows with state over the log as a stream; a user's last window goes out only when the watermark passes it, so it is left out here."""
    e = table(spark, sf_dir, "events").select("user_id", F.timestamp_micros(F.col("event_id") * 1_000_000).alias("at"), "event_type")
    source, out = files.scratch(spark, "log"), files.scratch(spark, "windows")
    e.write.parquet(source)
    stream = spark.readStream.schema(e.schema).parquet(source)
    opens, hit = F.col("event_type") == "signup", F.col("event_type").isin("purchase", "error")
    found = ingest.trigger_windows_stream(stream, "user_id", "at", opens, F.col("event_type"), hit)
    found.writeStream.format("parquet").option("checkpointLocation", files.scratch(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    last = e.where(opens).groupBy("user_id").agg(F.max("at").alias("last"))
    w = spark.read.parquet(out).join(last, "user_id").where(F.col("start") < F.col("last"))
    second = lambda c: F.unix_seconds(c)
    return w.select("user_id", "window", second("start").alias("start"), "n_rows", second("outcome_at").alias("outcome_at"), "first_code")


query(f"""SELECT user_id, "window", start, n_rows, outcome_at, first_code FROM ({SQL['trigger_windows']}) t
WHERE start < (SELECT max(event_id) FROM events e WHERE e.user_id = t.user_id AND e.event_type = 'signup')""")(streamed_windows)
