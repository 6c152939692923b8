"""Corpus pipeline: language ID, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
``documents`` for the rows that they keep; each works on all that its predecessor kept. Null or empty
texts are rejected by the first stage, repeated rows stay until the third keeps one document of a group.
Rows without id stay in the third, as they are in no group; of rows that share an id it keeps one.
An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import jaccard_join, language_id, packing, quality
from lakeloom.llm.common import materialise, table
from lakeloom.llm.queries import vocabulary

#: None: the stages train a model, join by similarity and pack, which SQL does not express.
ORACLE_SQL = None


def _with_row(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column's name can clash with one of an operator's."""
    return docs.select(F.struct(*docs.columns).alias("__row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the language classifier, fitted on these documents, does not reject."""
    found = language_id.identify(_with_row(docs), language_id.fit(docs), ["__row"])
    return found.where(~F.col("rejected")).select("__row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base measures and every rule of the cascade."""
    return quality.judge(_with_row(docs)).where("kept").select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents.

    A row without id is in no group and stays. Of rows that share an id, which count as one document, the
    one with the least text stays (of equal texts, the least of the other columns as JSON).
    """
    groups = jaccard_join.near_duplicates(docs)
    gone = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = materialise(again, "again")
    if not again.limit(1).count():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text"), F.to_json(row))).alias("row"))
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(one.select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, with Parquet between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
