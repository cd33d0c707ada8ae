"""Corpus pipeline: toxicity, quality classifier, near-duplicates, packing; each stage works on what the one before kept.

Defined results of every stage: null and empty texts are judged as texts of no words, stay apart as duplicates and are packed as
one id; a row with a null id goes on unless its text is rejected; repeated rows are judged alike, and rows that share an id
stay or go together; an empty table gives an empty one; extra columns, whatever their names, go through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asofline.llm import minhash, packing, quality, toxicity
from asofline.llm.common import apart, saved, table
from asofline.llm.queries import VOCABULARY

#: Columns that stages read; others go through as they are.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier, fitted on the labelled ones among them, scores below its threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = apart(docs, COLUMNS)
    return back(toxicity.annotate(rows, model).where("predicted = 0"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    rows, back = apart(docs, COLUMNS)
    rows = quality.featured(rows)  # once, for the fit and for the scores
    model = quality.fit(rows, table(spark, sf_dir, "labels"))
    return back(quality.annotate(rows, model).where("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): that with the smallest id."""
    drop = minhash.deduplicate(docs).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, VOCABULARY)


STAGES = [("toxicity", clean_of_toxicity), ("quality", good_quality), ("near_duplicates", one_of_each), ("packing", packed)]
#: Trained models, hashing and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage_{name}")
    return docs
