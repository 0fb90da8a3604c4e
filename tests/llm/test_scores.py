import random

from pyspark.sql import functions as F

from evenkeel.llm import quality, toxicity
from evenkeel.llm.common import crc_mod

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, label, m, held):
    y = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(y, "doc_id").where(crc_mod(F.col("doc_id"), m) == held).select(label, "predicted").collect()
    return rows, sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, right = held_out(spark, quality.score_quality(docs, labels, crc_mod(F.col("doc_id"), 4) != 2), "quality", 4, 2)
    assert right > 0.97


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, right = held_out(spark, toxicity.score_toxicity(docs, docs, labels, crc_mod(F.col("doc_id"), 5) != 0), "toxic", 5, 0)
    assert right > 0.96
    assert sum(r.predicted for r in rows if r.toxic) > 0.7 * sum(r.toxic for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)


def test_nulls_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, (" ".join(rng.choice(["good", "fine", "kind"]) for _ in range(30)) + (" awful!!!" * 5 if i % 2 else "")), i) for i in range(60)] + [(100, None, 1), (101, "", 1), (101, "", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(3, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for f, name in ((toxicity.score_toxicity, "toxic"), (quality.score_quality, "quality")):
        args = (df, df, labels) if name == "toxic" else (df, labels)
        got = f(*args, F.lit(True)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
        assert sum(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60) >= 58
        empty = (df.limit(0), df.limit(0), labels) if name == "toxic" else (df.limit(0), labels)
        assert f(*empty, F.lit(True)).count() == 0
        none = (df, df, labels.limit(0)) if name == "toxic" else (df, labels.limit(0))
        assert {r.score for r in f(*none, F.lit(True)).collect()} == {0.5}
