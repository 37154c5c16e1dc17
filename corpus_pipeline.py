"""From documents to packed token sequences: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.
``run`` writes each stage's result to the shared folder and reads it again for the next, and deletes what no later stage reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeglyph.llm import linededup, minhash, packing, quality, suffixes
from treeglyph.llm.common import drop_since, free_shuffles, shared_table, table, tables_so_far
from treeglyph.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs, fitted on the labelled ones of docs, let pass."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the last of them only."""
    return linededup.line_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return minhash.keep_first(docs, words=5, percent=80)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier go."""
    return suffixes.suffix_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), special_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]

#: SQL can't express the banding, the substring or the tokenizer stages; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), tables_so_far()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, name.replace(" ", "-"))
            drop_since(spark, since, docs)
            free_shuffles(spark)
    return docs
