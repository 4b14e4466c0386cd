"""A pipeline over documents: quality, repeated lines, near copies, mixing, packing.

Null and empty texts pass each stage as texts without words; null doc_ids have no copies and share no lines; repeated rows
are rows of their own, but near copies keeps all rows of the doc_id that stays; an empty table gives an empty result; columns of documents of any
name pass through the first four stages untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import line_dedup, mixing, ngram_join, packing, quality
from trellis.llm.common import materialize, table
from trellis.llm.queries import TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that a smaller doc_id holds."""
    return line_dedup.line_dedup(docs, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id. Documents
    without words (or without doc_id) have no copies and stay."""
    groups = ngram_join.jaccard_join(docs)
    extra = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: The classifier and the tokenizer aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
