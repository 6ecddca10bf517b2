"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

1. language ID: documents that the nearest-centroid model rejects go;
2. near-duplicates: of each Order-MinHash class the document of least doc_id stays;
3. substring dedup: bytes of 100-byte strings that also start earlier are cut out;
4. decontamination: documents contaminated by ``benchmark`` go;
5. mixing: each document as often as the mix of sources takes it, with its number ``copy``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the
last return the columns of ``documents``.  The stages' cases (nulls, empty and long texts, ties,
repeated rows, empty tables) are those of their operators.  Languages, pivotal draws and Order
MinHash have no SQL form, so there is no ORACLE_SQL; tests hold each stage against its operator,
and the operators against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldzones.llm import base, decontamination, language_id, mixing, near_dedup, suffix_dedup

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = base.stored(stage(spark, docs, sf_dir))
    return docs
