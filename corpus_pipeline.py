"""From raw documents to packed training sequences: filter, deduplicate, clean and pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import neardup, packing, quality, secrets, suffix
from lodestar.llm.common import Scratch, tokenizer_path

ORACLE_SQL = None  # the model stages have no SQL form; tests/llm hold the pipeline against a plain version


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` less the rows that `gone` names by doc_id and row_hash, whatever other columns `docs` has."""
    doc_id, row_hash = (next(f"{c}{'_' * k}" for k in range(99) if f"{c}{'_' * k}" not in docs.columns) for c in ("_gone_id", "_gone_hash"))
    named = gone.select(F.col("doc_id").alias(doc_id), F.col("row_hash").alias(row_hash)).distinct()
    return docs.join(named, docs["doc_id"].cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(row_hash)), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all others stay as they are.

    Null and empty texts stay, and so does everything if `labels` trusts nothing. Rows that repeat a doc_id are judged each by
    its own text. An empty table gives an empty table.
    """
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, judged.where(~F.col("keep")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id.

    Null, empty and blank texts and rows without an id stay. Rows that repeat a doc_id are judged each by its own text: one goes if
    its group has a smaller doc_id. An empty table gives an empty table.
    """
    groups = neardup.near_duplicates(docs, width=5, percent=80)
    return _without(docs, groups.where(~F.col("kept")))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents lose the passages that a document of a smaller doc_id also has; n_chars follows.

    Null texts stay null. Rows without an id lose nothing; rows of one doc_id take nothing from each other. An empty table
    gives an empty table.
    """
    return _sized(suffix.repeats(docs, span=50, keep_text=True))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts that hold them; n_chars follows. All rows stay, null and empty texts as they are."""
    return _sized(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; null and empty texts are the end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("suffix-array dedup", suffix_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
