"""Structured Streaming: churn by window, a streaming ratchet, a drop folder of sources.

The reference's scans are batch; these are extensions that keep its measures current.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import measure
from ..sources import extract as X
from ..sources import files as S


def _shared(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="srcprism-stream-")
    return f"{root.rstrip('/')}/srcprism-stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a file stream, its schema read from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(folder)


def windowed_churn(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Changes per window and key; state older than the watermark is dropped."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("changes"), F.sum("value").alias("weight"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "changes", F.round("weight", 4).alias("weight"))
    )


def worst_so_far(current: DataFrame) -> DataFrame:
    """The ledger as a stream: the worst value per metric, path and unit, grown in place."""
    return current.groupBy("metric", "path", "unit").agg(F.max("value").alias("value"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run what is available, keep each batch's complete or new rows, and read the last state."""
    spark = stream.sparkSession
    base = _shared(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = stream.schema
    rows = spark.read.option("basePath", f"{base}/rows").schema(T.StructType([*schema, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")
    return rows.drop("batch")


def measured_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements of Python files as they are dropped into a folder; copies are read once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.py").load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.withColumn("text", text).where("text is not null").withColumn("hash", F.md5("content"))
    once = rows.withWatermark("modificationTime", "7 days").dropDuplicatesWithinWatermark(["hash"])
    sources = once.select("path", F.lit("py").alias("lang"), "text", S.is_test_path(F.col("path")).alias("is_test_file"), S.is_script_path(F.col("path")).alias("is_script_file"))
    return measure.unit_measures(X.extract(sources))
