"""A corpus pipeline from five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread for the next.
All but the last return the columns of documents; the last returns packed pieces. Every stage gives no rows for an empty
table and leaves columns it does not name as they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, language, lines, packing, shared, simhash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter and texts in none of the learned languages go (language.LEAST_LIKENESS)."""
    return language.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in the last of them only; n_chars is counted anew."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles in common, the one with the smallest doc_id stays.

    Rows with a null doc_id stay. Of rows that repeat a doc_id one stays. Null and blank texts are one group."""
    return simhash.drop_near_copies(docs, words=5, alike=(4, 5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and wordless texts stay; rows that repeat are judged each for itself; an empty
    benchmark lets every document stay."""
    return decontamination.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens. A null text is the end id alone; rows that repeat are packed
    each for itself; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the near copies, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage made on its way, and what it read from the stage before, goes once it is written."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared.scratch(spark, name)
        with shared.discarded(spark):
            docs = shared.stored(stage(spark, docs, sf_dir), name, path)
        if before:
            shared.remove(spark, before)
        before = path
    return docs
