"""The corpus pipeline: each stage works on all that the one before kept, and its decisions take effect.

All stages but the last return the columns of ``documents``. Between stages the documents are written as
Parquet and read again, so a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bpe_segment, decontaminate, lsh_forest, quality_resample, secret_scan
from tarnlake.session import scratch_path


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Texts cross to Python in batches of fewer rows: less memory on both sides for long documents. A stage is only run
    after it returns, so the option stays set; ``run``, which runs them all, sets it back."""
    spark.conf.set(BATCH, "600")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against good labelled text rejects go."""
    _small_batches(spark)
    return quality_resample.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def _one_each(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(the rows with an id, of several rows of one id the one of least hash over all columns; whether equal rows may remain)."""
    known = docs.where("doc_id is not null")
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return known, False
    # The row travels as one column, so that no name of its own can clash.
    rows = known.select("doc_id", F.struct(*docs.columns).alias("row"), F.xxhash64(*docs.columns).alias("hash"))
    least = rows.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("hash").alias("least"))
    return rows.join(least, "doc_id", "left").where("least is null or hash = least").select("row.*"), True


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    An id is one document: of rows that repeat it the one of least hash stands for it, and its text alone decides. Rows without an id stay.
    """
    _small_batches(spark)
    known, repeats = _one_each(docs)
    kept = lsh_forest.near_duplicates(known).where("kept").select("doc_id")
    one = known.join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    return (one.dropDuplicates(["doc_id"]) if repeats else one).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    _small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported secret in a text is replaced by a marker, and n_chars follows; all documents stay."""
    _small_batches(spark)
    # A name that no column has.
    repo = "_" * (1 + max(map(len, docs.columns)))
    named = docs.withColumn(repo, F.concat_ws("/", "source", "lang"))
    masked = secret_scan.mask(named, repo_col=repo, max_owners=secret_scan.MAX_OWNERS, max_repos=secret_scan.MAX_REPOS)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded: doc_id, n_tokens, and the digests of the ids and of the text that they give back."""
    _small_batches(spark)
    return bpe_segment.round_trip(docs, bpe_segment.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]
#: Hashed models and signatures have no SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return docs
