"""Corpus preparation in five stages over ``documents``; each is written and reread as the next one's input.

toxicity        drops the documents that the toxicity model rejects;
near_duplicates keeps one document of each group of near-duplicates (five words, similarity 0.8);
repeats         cuts strings of over 50 words that repeat within or across documents out of the texts;
mixture         puts the documents in the order of a mixture of the sources;
packing         packs their tokens into sequences (one row per piece), stretch after stretch of the mixture.

The first four return the columns they get. All keep clean documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bwt, mixing, neardup, packing, toxicity
from evenkeel.llm.common import crc_mod, cut, documents

#: Repeats are searched as byte strings of this length, which 99 % of all runs of 51 words have, and removed if they hold so many words.
REPEAT_BYTES, REPEAT_WORDS = 240, 51
#: Pieces of a stretch of the mixture that is packed together.
STRETCH = 20_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The model learns from ``labels`` and the texts in ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score_toxicity(docs, docs, labels, crc_mod(F.col("doc_id"), 5) != 0, nested=True)  # whole rows, so that no column can clash
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; of several with that id the text with the least hash, and of repeated rows the row with the least hash."""
    found = neardup.near_duplicates(docs, num=4, den=5).where("kept")
    alone = F.when(F.col("root").isNull(), F.struct("id", "k1", "k2"))  # blank texts have no group
    found = found.groupBy("root", alone.alias("alone")).agg(F.first("id").alias("_id"), F.min(F.struct("k1", "k2")).alias("k")).select("_id", "k.k1", "k.k2")
    keyed = neardup.with_text_key(docs.select(F.struct("*").alias("row"), "text", F.col("doc_id").alias("_key"))).drop("text")
    kept = keyed.join(found, (keyed.k1 == found.k1) & (keyed.k2 == found.k2) & keyed["_key"].eqNullSafe(found["_id"]), "left_semi")
    return kept.groupBy("_key", "k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings of over 50 words; characters cut in two go. Other texts stay as they are; n_chars follows."""
    found = bwt.remove_repeats(docs, length=REPEAT_BYTES, words=REPEAT_WORDS, as_text=True, nested=True)
    length = F.length("kept").cast(docs.schema["n_chars"].dataType)
    row = F.when(F.col("n_removed") > 0, F.col("row").withField("text", F.col("kept")).withField("n_chars", length)).otherwise(F.col("row"))
    return found.select(row.alias("row")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files in order of their slots, and each file within."""
    mixed = mixing.mix_sources(docs, nested=True)
    return mixed.repartitionByRange("slot", "start").sortWithinPartitions("slot", "start").select("row.*")


def _places(docs: DataFrame) -> list[Column]:
    """Where each row stands in the files of ``docs``, in the order in which they were written; without files, in its partitions."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return [F.monotonically_increasing_id()]
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; each comes from one stretch of the mixture, and their ids ascend with the stretches."""
    return packing.pack_documents(docs, group=STRETCH, order=_places(docs))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("mixture", mix), ("packing", pack)]

#: No SQL: a trained model decides in the first stage; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
