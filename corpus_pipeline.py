"""The corpus pipeline: quality filter, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`. Stages bound the session's Arrow batches (`small_batches`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, packing, quality, secrets
from tidemark.llm.queries import table
from tidemark.llm.shared import materialise, small_batches


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled rows of `documents` that aren't held out.

    Null and empty texts are judged by their statistics alone; repeated rows and rows with a null doc_id are judged each.
    """
    small_batches(spark)
    machine = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=~quality.held_out(F.col("doc_id")))
    return quality.filter_documents(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (of several the first); rows with a null doc_id stay.

    Rows are linked by a number of their own, as a doc_id may be repeated, with the same text or another. They are numbered by
    partition and place, which are the same whenever a stage's files are read.
    """
    small_batches(spark)
    own = docs.withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()))
    linked = jaccard.join(own.select(F.col("_row").alias("doc_id"), "text")).where("doc_id is not null").select(F.col("doc_id").alias("_row"), "component_id")
    kept = linked.join(own.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    kept = materialise(kept, "kept")  # so that adaptive execution can split the join on a large group
    gone = linked.join(kept, "component_id").where("_row <> kept._row").select("_row")
    return own.join(gone, "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands. Null and empty texts stay; repeated rows stay or go alike."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark. Null and empty texts stay as they are; repeated rows are changed alike."""
    small_batches(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Null and empty texts are one token; repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: No stage but the joins can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
