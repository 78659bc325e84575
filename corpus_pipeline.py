"""A training corpus from raw documents: each stage is written as Parquet and reread as the next one's input.

Defined results of all stages: a null or empty text has no words, so quality rules reject it, and a stage called by
itself keeps it (near_dedup, decontaminate, mix_sources) or encodes it as the end id alone (token_store); rows with a
null or repeated doc_id are judged each by itself; of rows that repeat a text near_dedup keeps one; an empty table
gives an empty table; further columns, whatever their names, pass through all but the last stage, which does not
read them; texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import mixing, quality
from docflow.llm.common import Scratch
from docflow.llm.decontaminate import contaminated
from docflow.llm.minhash import near_duplicates
from docflow.llm.token_store import store_round_trip


def free(docs: DataFrame, name: str = "_row") -> str:
    """A name for the column that tells rows apart inside a stage, which no column of ``docs`` has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps. The verdict is a condition on the row itself, so nothing is joined."""
    return quality.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the smallest doc_id (null last), of its rows any one.

    Rows are told apart by a number of their own, so repeated rows and rows without an id are members like
    others. Texts without words are in no group and stay.
    """
    row = free(docs)
    numbered = Scratch(spark, "near_dedup").keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id")
    first = groups.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    return numbered.join(first.select(f"first.{row}"), row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Texts are named by their hash: ids may be null or shared."""
    row, named = free(docs), F.xxhash64("text")
    found = contaminated(docs.select(named.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("doc_id").alias(row)), named == F.col(row), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn with their calibrated probabilities, each by itself; a row without an id draws by its text."""
    return mixing.drawn(docs)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a token store, as read back from its files."""
    return store_round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_store", token_store),
]
#: Near-duplicate components and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
