"""Training-corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage gets its predecessor's output as Parquet and works on all of it. All but the last return documents with
their own columns: quality drops rejected documents and removes boilerplate lines (copies of a
text count once there, or all of a large group would go before one of it is chosen); near-duplicates keeps the least
doc_id of each component; personal data is replaced in the texts; mixing takes each document once for every
epoch that its budget allows. Packing returns a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import staged
from leafmill.llm.mixing import mix_documents
from leafmill.llm.neardup import keep_one
from leafmill.llm.packing import pack
from leafmill.llm.pii import redact_documents
from leafmill.llm.quality import filter_documents

STAGES = [
    ("quality", lambda spark, docs, sf_dir: filter_documents(docs, copies_once=True)),
    ("near_duplicates", lambda spark, docs, sf_dir: keep_one(docs)),
    ("personal_data", lambda spark, docs, sf_dir: redact_documents(docs)),
    ("mixing", lambda spark, docs, sf_dir: mix_documents(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Sub-word ids and near-duplicate components have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last staged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
