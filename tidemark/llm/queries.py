"""The queries of this subpackage: opN_<name> for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, lines, main_text, passages, pieces, pii, quality, runs, simhash, spotsigs, toxicity, whitening
from tidemark.llm.common import table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_and_next(table(spark, sf_dir, "documents"))


def spotsigs_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of SpotSigs: classes of alike fingerprints, by length partitions and pruned Jaccard."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs, ~language_id.held_out()))
    return found.withColumn("held_out", language_id.held_out())


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_and_decode(table(spark, sf_dir, "documents"), pieces.read_model())
    return found.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.main_texts(pages, main_text.fit(pages, table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.scores(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.scores(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.decisions(table(spark, sf_dir, "documents"))


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_planted(table(spark, sf_dir, "documents"))))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_language_id": op2_language_id,
    "op3_pieces": op3_pieces,
    "op4_main_text": op4_main_text,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_passages": op7_passages,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_disclosure": op11_disclosure,
    "op12_runs": op12_runs,
    "op13_whitening": op13_whitening,
    "spotsigs_near_duplicates": spotsigs_near_duplicates,
}

ORACLES: dict[str, str] = {}
