"""A corpus pipeline of five stages, each calling one operator of corpusjobs.llm.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusjobs.llm import decontam, lines, packing, simhash, toxicity
from corpusjobs.llm.common import free_name, removed, shared_folder, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores 0.5 or more go; it learns from all labelled documents, not from docs.

    Null and empty texts stay, as they score nothing of their own; rows with a null id and repeated rows are judged like
    any other, by their whole text. Without labels every score is an even one, and all documents with text go. An empty
    table stays empty. All columns stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document goes if nothing but white space is left of what had been more.

    The first of a group of alike lines by (document id, line number) stays. Null and empty texts and rows with a null
    id stay as they are; rows of one id lose the same lines. n_chars counts the characters that are left where lines
    went; a table without it has none. All columns stay, whatever their names.
    """
    count, dropped = free_name(docs, "n_lines"), free_name(docs, "dropped")
    found = lines.deduped(docs, count_col=count, dropped_col=dropped)
    fewer = F.size(dropped) > 0
    left = found.filter(~fewer | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(fewer, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and empty texts are one group. Rows with a null id stay; where rows share the id that stays, all of them do. An
    empty table stays empty. All columns stay, whatever their names.
    """
    return simhash.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: of an id all rows if any row is contaminated; rows with a null id stay.

    Null and empty texts have no words and stay unless another row of their id goes. Empty tables take nothing away. All
    columns stay, whatever their names.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    Null and empty texts are one piece with the end id; rows with a null id and repeated rows are packed each on its own;
    an empty table gives no rows. Columns other than the id and the text are not read.
    """
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again, and removed when the next one's is there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs
