"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Between stages the documents are written as Parquet to the shared
folder and read again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from srcprism.llm import common, langid, packing, secrets, simhash

STAGES = [
    ("language", langid.stage),
    ("near_duplicates", simhash.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]

#: SQL cannot express cross-parsing, XXH64 shingles or byte-level BPE; the tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
