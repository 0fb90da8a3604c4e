"""Streams whose first rows lie at 1970 or before, where Spark's watermark begins."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import prep
from evenkeel.plans import catalogue, catalogue2, catalogue3, catalogue4, catalogue5, catalogue6  # noqa: F401
from evenkeel.streaming import ingest

KINDS = ["signup", "view", "purchase", "error", "click"]


@pytest.mark.parametrize("name", ["streamed_late_windows", "streamed_windows"])
def test_first_event_opens_a_window(spark, tmp_path, name):
    rows = [(i, i % 3, KINDS[(i * i + i // 7) % 5]) for i in range(200)]
    assert rows[0][2] == "signup"
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rel = c.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    want = Counter(rel.fetchall())
    assert any(r[names.index("start")] == 0 for r in want)
    assert Counter(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).select(*names).collect()) == want


@pytest.mark.parametrize("late", [False, True])
def test_rows_before_1970(spark, tmp_path, late):
    """Two batches around 1970; late rows of the first come with the second."""
    rows = [(i, i % 3, KINDS[(i * i + i // 7) % 5]) for i in range(-100, 100)]
    e = spark.createDataFrame(rows, "s long, k long, kind string").withColumn("at", F.timestamp_micros(F.col("s") * 1_000_000))
    src, kind = str(tmp_path / "log"), F.col("kind")
    second = (F.col("s") >= 20) | ((F.col("s") % 10 == 1) if late else F.lit(False))
    marks = {"opening": kind == "signup", "outcome": kind == "purchase", "code": kind}
    for part in (e.where(~second), e.where(second), spark.sql("SELECT 0L s, null::long k, 'end' kind, timestamp_micros(900000000) at")):
        part.coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    found = ingest.window_decisions_stream(s, "k", "at", delay="150 seconds", **marks) if late else ingest.trigger_windows_stream(s, "k", "at", marks["opening"], kind, marks["outcome"], "150 seconds")
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    want = prep.window_decisions(e, ["k"], "at", **marks) if late else prep.trigger_windows(e, ["k"], "at", marks["opening"], marks["outcome"], kind)
    cols = ["k", "window", F.unix_seconds("start"), "n_rows", F.unix_seconds("outcome_at"), "first_code"]
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).select(*cols).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.select(*cols).collect()))
