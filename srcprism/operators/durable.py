"""Tables written once where a plan would compute them again, and lineage cut with them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: list[str] = []


def _folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _roots:
            _roots.append(tempfile.mkdtemp(prefix="srcprism-facts-"))
            atexit.register(shutil.rmtree, _roots[0], True)
        root = _roots[0]
    path = f"{root.rstrip('/')}/srcprism-facts-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_removed, spark, path)
    return path


_made: set[str] = set()


def _removed(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone first
        pass


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (a local master may have one of its own)."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
