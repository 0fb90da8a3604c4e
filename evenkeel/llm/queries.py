"""The thin ``opN_`` queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import bwt, collocations, forest, licences, media, merkle, mixing, neardup, packing, ppm, quality, toxicity, urlfilter
from evenkeel.llm.common import crc_mod, documents


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_payloads(documents(spark, sf_dir))
    return media.media_features(stored).withColumn("feature", F.lower(F.hex("phash"))).drop("phash", "error")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ppm.score_texts(documents(spark, sf_dir), crc_mod(F.col("doc_id"), 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bwt.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), passages=bwt.PASSAGES)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(documents(spark, sf_dir), num=85, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op3_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)
    return found.withColumnRenamed("id", "vec_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(df: DataFrame, m: int, held: int) -> DataFrame:
    return df.select("doc_id", (crc_mod(F.col("doc_id"), m) == held).alias("held_out"), "score", "predicted")


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.score_quality(documents(spark, sf_dir), _labels(spark, sf_dir), crc_mod(F.col("doc_id"), 4) != 2), 4, 2)


def op7_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(toxicity.score_toxicity(docs, docs, _labels(spark, sf_dir), crc_mod(F.col("doc_id"), 5) != 0), 5, 0)


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", "start", "block", "release", "deadline", "slot")


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir)).drop("reserved")  # the SQL has no such column


#: Rules of the URL filter's query.
URL_RULES = [urlfilter.Rule("allow", "com"), urlfilter.Rule("block", "example.com", "/en/"), urlfilter.Rule("allow", "www.example.com", "/en/"), urlfilter.Rule("block", "net", "/es/"), urlfilter.Rule("block", "net", "/fr/")]
#: What ``urlfilter.GLOBS`` say, as regular expressions for SQL.
URL_PATTERNS = [(r".*\.(exe|zip|jpg|png|mp4|css|js)|.*/wp-login\.php|.*/cart/.*", "block")]


def op11_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_phrase_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = merkle.leaf_of(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in MANIFEST_FIELDS])
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, bare)
    found = merkle.merkle_manifest(documents(spark, sf_dir), MANIFEST_FIELDS, carry={"tampered": tampered})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries():
    return {f.__name__: f for f in (op1_media_columns, op2_best_fit_packing, op3_projection_forest, op4_quality_discriminant, op5_pfair_mixing, op6_licence_digests, op7_toxicity_ftrl, op8_ppm_scores, op9_bwt_dedup, op10_minhash_near_dedup, op11_url_automaton, op12_phrase_streams, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op6_licence_digests": licences.oracle(), "op11_url_automaton": urlfilter.oracle(URL_RULES, URL_PATTERNS), "op12_phrase_streams": collocations.oracle(), "op13_merkle_manifest": merkle.oracle(MANIFEST_FIELDS)}
