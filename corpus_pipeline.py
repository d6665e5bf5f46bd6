"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A stage judges all that its predecessor kept.

quality: rows that the quality rules reject go. line_dedup: repeated lines go from the text (n_chars follows); no
document goes. simhash: of each group of near-duplicates the row with the smallest doc_id (nulls last) stays, and no other.
decontamination: contaminated rows go, others stay as they are. These three judge rows, so a null or repeated doc_id neither
keeps nor drops one. packing: one row for each piece of a document in a sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabletide.llm import decontam, line_dedup, packing, quality, simhash
from tabletide.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs, every=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: SQL has no robust covariance, bit-parallel join, FM-index or linear program. The stages' operators are tested against brute
#: force, numpy and the tokenizer, and run() stage by stage, in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
