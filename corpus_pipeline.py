"""The corpus pipeline: language, lines, near duplicates, benchmark leaks, packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, lang_hd, line_dedup, near_dup, packing
from quillstone.llm.shared import materialize, table


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("language_id", lang_hd.stage),
    ("line_dedup", line_dedup.stage),
    ("near_duplicates", near_dup.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packed),
]

#: Sketches and a trained language model are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
