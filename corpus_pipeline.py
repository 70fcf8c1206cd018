"""The corpus pipeline: quality filter, near-duplicate removal, secret removal, packing.

Every stage takes what its predecessor kept. All but the last return the columns
of ``documents``; the last returns the pieces of packed sequences. Null and
empty texts pass as the operators define it, an empty table gives an empty
result, and other columns are carried along. Every row is a document, whatever
its id: rows with equal ids and different texts are kept or dropped each for
itself, and of equal ids in a SimHash group the first by fingerprint, hash of
the text and place stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import packing, quality, secrets, simhash
from cartulary.llm.queries import table, tokenizer_path
from cartulary.llm.shared import materialize, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_score(F.col("text"), model) >= quality.THRESHOLD)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows of each SimHash group keep the one with the smallest id; one without an id only if none has one.

    Rows are chosen by id, fingerprint and two hashes of the text, which alone
    are stored; texts take part in the last join. Of rows with the same id and
    text, which are told apart by nothing, any one is kept.
    """
    small_batches(spark)
    key = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("check")]
    names = ["id", "hash", "check"]
    prints = materialize(docs.select(*key, simhash.fingerprint(F.col("text")).alias("fp")).groupBy(*names, "fp").agg(F.count("*").alias("copies")))
    order = F.struct(F.isnull("id"), "id", "fp", "hash", "check")
    first = materialize(simhash.with_components(prints).groupBy("class").agg(F.min_by(F.struct(*names, "copies"), order).alias("row")).select("row.*"))
    rows = docs.select(F.struct("*").alias("doc"), *key)
    same = lambda other: [rows["id"].eqNullSafe(other["id"]), rows["hash"] == other["hash"], rows["check"] == other["check"]]
    once, often = first.where("copies = 1"), first.where("copies > 1")
    kept = rows.join(once, same(once), "left_semi").select("doc.*")
    if often.take(1):
        kept = kept.unionByName(rows.join(often, same(often), "left_semi").groupBy(names).agg(F.first("doc").alias("doc")).select("doc.*"))
    return kept


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark that names its kind; n_chars follows the new text."""
    small_batches(spark)
    clean = docs.withColumn("text", secrets.redacted_text(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into training sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("secret_scan", remove_secrets),
    ("retrieval_packing", pack),
]

#: A learned classifier, SimHash classes and greedy packing are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
