"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together (here: equal texts) are sorted by size and go, largest
first, to the least-loaded shard through a heap.

The heap runs on the driver over a bounded number of parcels: every group of at least one
``FINE``-th of all bytes is a parcel of its own (there are at most ``FINE``), and the smaller
groups are hashed into ``FINE`` bundles. Shards then differ by about the smallest bundles, a
small part of one ``FINE``-th of the bytes, unless a single group exceeds a shard's share.

Edge cases: a null text has the size of a row without text and groups with no empty text;
empty texts are one group; repeated rows are one group; ties in size go by the group's key,
ties in load to the lower shard; a null doc_id is placed like any other row, first in its
block of slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Bytes that a row takes besides its text.
OVERHEAD = 16
#: Parcels of small groups, and the share of the bytes from which a group is its own parcel.
FINE = 20_000
#: Rows that get their slots in one task, about.
SLOTS = 20_000


def schedule(parcels: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Longest processing time first: parcel -> shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(parcels, key=lambda p: (-p[1], p[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key): equal texts have one key."""
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5(data)).alias("key"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = 40, fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, key, shard, slot): slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    rows = common.cut(measured(docs))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = total // fine + 1
    bundle = F.pmod(F.xxhash64("key"), F.lit(fine)).cast("string")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    # A heavy group is its own parcel: there are at most ``fine`` of them.
    own = common.cut(groups.where(F.col("bytes") >= heavy).select("key", F.col("key").alias("own"), "bytes"))
    small = groups.where(F.col("bytes") < heavy).groupBy(bundle.alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    parcels = [(f"{r[0]}", r[1]) for r in own.select("own", "bytes").collect()]
    parcels += [(f"#{r[0]}", r[1]) for r in small.collect()]
    placed = schedule(parcels, shards)
    table = spark.createDataFrame(
        [(p, s) for p, s in placed.items()], T.StructType([T.StructField("parcel", T.StringType()), T.StructField("shard", T.IntegerType())])
    )
    # Both look-up tables have at most ``2 * fine`` rows.
    named = rows.join(F.broadcast(own.select("key", "own")), "key", "left")
    named = named.withColumn("parcel", F.coalesce("own", F.concat(F.lit("#"), bundle)))
    sharded = named.join(F.broadcast(table), "parcel").select("doc_id", "size", "text_crc32", "key", "shard")
    return with_slots(sharded, count)


def with_slots(rows: DataFrame, count: int) -> DataFrame:
    """Number the rows of each shard from 0 without gathering a shard into one task.

    Each shard's rows are dealt into blocks by a hash of the whole row's place; blocks are
    counted, and a row's slot is its block's start plus its number in the block.
    """
    blocks = max(16, min(5000, count // SLOTS))
    rows = common.cut(
        rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    )
    counts = rows.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    # One row for each shard and block, at most 5000 blocks a shard.
    return numbered.join(F.broadcast(starts), ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "key", "shard", (F.col("first") + F.col("at")).alias("slot")
    )
