"""Shared helpers: durable cuts of lineage, text batches, components, blocked self-joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block in a blocked self-join; a task holds the blocks of one pair at a time.
BLOCK = 1024

_cleaning: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is unset and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/srcprism-{spark.sparkContext.applicationId}"
    if path not in _cleaning:
        _cleaning.add(path)
        atexit.register(_remove_quietly, spark, path)
    return path


_root: list[str] = []


def _local_root() -> str:
    if not _root:
        _root.append(tempfile.mkdtemp(prefix="srcprism-"))
    return _root[0]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may have gone first
        pass


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path: lineage is cut durably."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    return written(df)[0]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str
) -> DataFrame:
    """Apply ``fn`` to each Arrow batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                del batch
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
                give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: several workers share an executor's bound."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict[str, tuple] = {}


def worker_state(name: str, key: object, build: Callable[[], object]) -> object:
    """What one operator keeps in a Python worker between batches.

    Workers serve one operator after another; only the latest keeps its tables, so their sizes
    never add up.
    """
    if name not in _held or _held[name][0] != key:
        _held.clear()
        gc.collect()
        give_back()
        _held[name] = (key, build())
    return _held[name][1]


# -- connected components -------------------------------------------------------------


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges, in steps of bounded size; emits stars."""
    a, b, held = [], [], 0

    def flush() -> pa.RecordBatch:
        x, y = np.concatenate(a), np.concatenate(b)
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        u, v = at[: len(x)], at[len(x) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = label != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
        if held >= 1_000_000:
            yield flush()
            a, b, held = [], [], 0
    if held:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node reachable.

    Alternating large-star and small-star steps: each halves the distances to the smallest
    node, so the number of rounds grows with the logarithm of a component's width. Minima are
    partially aggregated before each shuffle and brought back by a join, so a node with very
    many neighbours is never gathered into one task. Every round is a written table.
    """
    spark = edges.sparkSession
    edges = edges.where("u <> v").mapInArrow(_local_stars, "u long, v long").distinct()
    now, path = written(edges)
    print_of = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = print_of(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, mid = written(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        new, new_path = written(small.where("u <> v").distinct())
        remove(spark, path)
        remove(spark, mid)
        now, path = new, new_path
        mark = print_of(now)
        if mark == seen:
            break
        seen = mark
    # Every edge is now (node, root); the roots name themselves.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )


# -- joins with hot keys --------------------------------------------------------------

#: Rows from which a key is hot.
HOT = 50_000


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], counts: DataFrame, ident: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has at most one row of a key of longs (left join).

    ``counts`` (key, n) tells how many rows each key has. Rows of hot keys do not meet: the
    entries of hot keys, at most one for every HOT rows, are broadcast, and such rows take part
    in the other join by their own ``ident``, spread over all tasks.
    """
    values = [c for c in table.columns if c not in key]
    hot = cut(counts.where(F.col("n") > HOT).select(*key).join(table, key))
    if hot.isEmpty():
        return rows.join(table, key, "left")
    near = hot.select(*key, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in values])
    near = rows.join(F.broadcast(near), key, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    places = {f"__at{i}": F.when(F.col("__hot"), F.xxhash64(ident, F.lit(i))).otherwise(F.col(k)) for i, k in enumerate(key)}
    rest = table.select(F.lit(False).alias("__hot"), *[F.col(k).alias(f"__at{i}") for i, k in enumerate(key)], *values)
    joined = near.withColumns(places).join(rest, ["__hot", *places], "left")
    return joined.select(*rows.columns, *[F.when(F.col("__hot"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])


# -- blocked self-joins ---------------------------------------------------------------


def block_pairs(rows: DataFrame, key: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """Deal the rows of each key into blocks and the blocks into pairs.

    Adds ``bi <= bj`` (a pair of blocks) and ``own`` (the block of the row): each row goes once
    to every pair that holds its block. A key with up to ``block`` rows has one pair, (0, 0);
    a hot key is spread over as many tasks as it has pairs of blocks, and no task gathers it.
    """
    hot = (
        rows.groupBy(*key)
        .count()
        .where(F.col("count") > block)
        .select(*key, F.ceil(F.col("count") / block).cast("int").alias("nb"))
    )
    dealt = rows.join(hot, key, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("nb")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        *rows.columns,
        "own",
        F.least("own", "other").alias("bi"),
        F.greatest("own", "other").alias("bj"),
    )


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in a 2-d array, with the end appended."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], change, [len(keys)]])


def whole_groups(
    batches: Iterator[pa.RecordBatch], n_keys: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the groups' starts.

    The first ``n_keys`` columns are integers; a group that a batch cuts is carried over.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = np.stack([table.column(i).to_numpy() for i in range(n_keys)], axis=1)
        starts = runs(keys)
        if len(starts) > 2:
            yield table.slice(0, starts[-2]), starts[:-1]
        rest = table.slice(starts[-2])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def bipartite_roots(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest index reachable for the rows and columns of a boolean matrix of links.

    ``same``: rows and columns are the same items (a square, symmetric matrix); otherwise
    columns are numbered after the rows.
    """
    n, m = link.shape
    far = np.int32(n + m)
    rows = np.arange(n, dtype=np.int32)
    cols = rows if same else np.arange(n, n + m, dtype=np.int32)
    while True:
        new_cols = np.minimum(cols, np.where(link, rows[:, None], far).min(axis=0, initial=far))
        new_rows = np.minimum(rows, np.where(link, new_cols[None, :], far).min(axis=1, initial=far))
        if same:
            new_rows = new_cols = np.minimum(new_rows, new_cols)
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols
