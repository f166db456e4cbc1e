"""A training-data pipeline: each stage reads what the one before wrote, and all but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twintrack.llm import decontaminate, linededup, piececoding, quality, simhash
from twintrack.llm.common import read, settle

STAGES = [
    ("quality classifier", quality.stage),
    ("line dedup", linededup.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("SentencePiece encoding and decoding", piececoding.stage),
]

#: SQL can express neither the fitted model nor the fingerprints nor the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs)
    return docs
