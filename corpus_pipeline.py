"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run`
writes each stage's result as Parquet in the shared folder and reads it again as
the next stage's ``docs``.  A stage's folder goes when the next one is written; the
last one holds the result and stays.

Defined cases of all stages: ``docs`` may hold nulls in any column, empty and very
long texts (read whole), ties, repeated rows and further columns of any name, which
are left out; an empty table gives an empty result with the columns of
``documents``.  What a stage does with each is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm._spark import drop_path, scratch_path
from skyloom.llm.decontaminate import decontaminate
from skyloom.llm.jaccard import one_of_each
from skyloom.llm.mixing import mix
from skyloom.llm.quality import classify_quality, held_out_of
from skyloom.llm.suffix_dedup import remove_repeats
from skyloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; those without words have nothing to reject and stay.

    Null texts and ids stay as they are; repeated rows share their fate, as a score is
    the text's alone; a score of exactly a half is kept.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify_quality(docs, labels, learn=lambda key: ~held_out_of(key, 3, 1), keep=COLUMNS)
    return scored.filter((F.col("predicted") == 1) | (F.coalesce(F.trim("text"), F.lit("")) == "")).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, Jaccard of 0.8 or more.

    It is the one of the smallest id; of rows that repeat an id, each group that their
    own texts are in keeps the first by text and then by the other columns.  Null and
    empty texts are in no group and stay (but for repeats of id and text), and so do
    rows without id.
    """
    ship(spark)
    return one_of_each(docs, k=5, p=80, q=100).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut; a document of which nothing is left goes.

    Earlier is a smaller id: rows of one id, and rows without id, cut nothing from each
    other.  Null and empty texts stay as they are; ``n_chars`` is counted anew where
    bytes went.
    """
    ship(spark)
    cut = remove_repeats(docs, length=50, keep=COLUMNS, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or a whole shorter item) go.

    Null and empty texts hold none and stay; repeated rows share their fate; an empty
    benchmark, or items without words, take nothing away.
    """
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, window=10, keep=COLUMNS).filter(F.col("n_hit") == 0).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document with its ``repeats``; those that the mix does not take go.

    A null source is one of its own; null and empty texts have size 0 and are repeated
    as their hash says, adding no words; rows with equal ids share their fate in a source.
    """
    ship(spark)
    mixed = mix(docs, keep=COLUMNS)
    return mixed.filter(F.col("repeats") > 0).select(*COLUMNS, "size", "source_size", "target", "repeats", "taken")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier's decisions cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
