"""A training-data pipeline of corpus operators (part of the llm subpackage, where its stages are).

Each stage gets all rows its predecessor kept; its result is written as Parquet and read again. A
stage's result is deleted when the next one is written; the last one stays in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wavegrid.llm.common import documents, shared_dir
from wavegrid.llm.stages import stage_bpe, stage_mixing, stage_near_duplicates, stage_pii, stage_quality

STAGES = [
    ("quality rules", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("PII", stage_pii),
    ("mixing sources to target weights", stage_mixing),
    ("BPE encoding and decoding", stage_bpe),
]

#: The entity model is trained, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:  # the stage is committed: what it has read is no longer needed
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
