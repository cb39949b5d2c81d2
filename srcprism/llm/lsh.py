"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables cuts ``k`` Gaussian projections of the unit vectors into cells of
``WIDTH``. A query visits its own cell and perturbed ones in the order of their estimated
success: the chance that a neighbour at the distance expected of it lies there, a product over
the projections. It stops when the cells visited hold the share of that chance that, over all
tables, makes ``SUCCESS``. Candidates of all tables are merged and ranked by exact cosine.
The expected distance comes from a bounded sample, in which neighbours are rarer and so
farther: the estimate is on the safe side. Queries that meet fewer than k rows are compared with
all rows, both dealt into blocks, so there are always k answers where k rows exist.

Each dimension that occurs has tables of its own; vectors of different dimensions have no
cosine and are no candidates of each other.

Buckets are dealt into blocks, so a hot bucket is spread over tasks; each task keeps the k
best per query.

Edge cases: vectors that are null, zero, or hold null or non-finite components and rows without
vec_id take no part; rows that repeat a query's vec_id are its own; ties go to the smaller vec_id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, vectors

TABLES, WIDTH, SUCCESS = 8, 2.5, 0.985
#: Rows of a cell, about, if rows were spread evenly; projections at most.
CELL, MOST = 256, 12
#: Vectors that estimate the distance of neighbours.
SAMPLE = 8_192
MEMBERS = 1024
#: Rows and queries of a block of the exact scan.
SCAN, ASKED = 8_192, 1_024


class Tables:
    """Projections, offsets and the distance that neighbours are expected at."""

    def __init__(self, dim: int, count: int, distance: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.k = min(MOST, max(1, math.ceil(math.log2(max(2, count / CELL)))))
        self.lines = rng.standard_normal((TABLES, dim, self.k))
        self.offsets = rng.uniform(0, WIDTH, (TABLES, self.k))
        self.distance = max(distance, 1e-3)
        self.share = 1 - (1 - SUCCESS) ** (1 / TABLES)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of cells: (table, row, projection)."""
        return np.stack([(x @ a + b) / WIDTH for a, b in zip(self.lines, self.offsets, strict=True)])

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One integer for the cells of all projections."""
        shifted = np.clip(cells, -16, 15).astype(np.int64) + 16
        return (shifted << (5 * np.arange(self.k))).sum(axis=-1)

    def probes(self, place: np.ndarray) -> np.ndarray:
        """Keys of the cells that one query visits in one table, by falling success."""
        base = np.floor(place).astype(np.int64)
        steps = np.arange(-3, 4)
        low = (base[:, None] + steps[None, :] - place[:, None]) * WIDTH / self.distance
        high = low + WIDTH / self.distance
        chance = _normal(high) - _normal(low)
        best = chance.max(axis=1)
        after = np.concatenate([np.cumprod(best[::-1])[::-1][1:], [1.0]])
        least = best.prod() / 16
        while True:
            p, key = np.ones(1), np.zeros(1, dtype=np.int64)
            for j in range(self.k):
                pj = p[:, None] * chance[j][None, :]
                keep = pj * after[j] >= least
                cell = np.clip(base[j] + steps, -16, 15) + 16 << 5 * j
                p, key = pj[keep], (key[:, None] + cell[None, :])[keep]
            if p.sum() >= self.share or least < 1e-12:
                order = np.lexsort((key, -p))
                n = int(np.searchsorted(np.cumsum(p[order]), self.share)) + 1
                return np.unique(key[order[:n]])
            least /= 4


def _normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))


def expected_distance(x: np.ndarray, k: int) -> float:
    """Nine in ten vectors of the sample have their k-th neighbour in it no farther off."""
    if len(x) < 2:
        return math.sqrt(2)
    some = x[:: max(1, len(x) // 256)]
    k = min(k, len(x) - 1)
    cos = np.sort(some @ x.T, axis=1)[:, -1 - k]
    return float(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * cos)), 0.9))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then id."""
    return np.lexsort((ids, -scores))[:k]


def _answers(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a block for one query: ids and scores.

    A matrix product may round equal vectors differently, so it only narrows the block down;
    the scores that rank are summed row by row, in one order.
    """
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        near = rough[at]
        at = at[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
    scores = (x[at] * query).sum(axis=1)
    b = _best(ids[at], scores, k)
    return ids[at][b], scores[b]


def _merged(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Keeper:
    """The k best candidates of each query within one task."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, {}, 0

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.held.setdefault(query, []).append((ids, scores))
        self.size += len(ids)

    def flush(self) -> pa.RecordBatch:
        rows = []
        for query, parts in self.held.items():
            ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, first = np.unique(ids, return_index=True)
            scores = scores[first]
            at = _best(ids, scores, self.k)
            rows.append((np.full(len(at), query), ids[at], scores[at]))
        self.held, self.size = {}, 0
        q, i, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.record_batch([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def search(df: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by cosine."""
    spark = df.sparkSession
    rows = vectors.doubles(df).where("vec_id is not null").withColumn("asks", F.coalesce(is_query, F.lit(False)))
    counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    fit = vectors.sample(rows, sum(counts.values()), SAMPLE, "vec_id")
    near = {d: expected_distance(vectors.unit(fit[d]), k) if d in fit else math.sqrt(2) for d in counts}
    tables = spark.sparkContext.broadcast({d: Tables(d, n, near[d]) for d, n in sorted(counts.items())})

    def place(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for d, at, x in vectors.by_dimension(batch.column(1)):
            t, x = tables.value[d], vectors.unit(x)
            asks = batch.column(2).to_numpy(zero_copy_only=False)[at]
            places = t.places(x)
            keys = t.keys(np.floor(places)).T
            probes = [[[*t.probes(places[j, i]).tolist()] for j in range(TABLES)] if asks[i] else None for i in range(len(x))]
            kind = pa.list_(pa.list_(pa.int64()))
            out.append(pa.record_batch(
                [batch.column(0).take(pa.array(at)), pa.array(np.full(len(x), d)), vectors.vectors_column(x), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(probes, kind)],
                names=["vec_id", "d", "x", "keys", "probes"],
            ))
        return pa.Table.from_batches(out)

    placed = common.cut(common.map_batches(rows.select("vec_id", "v", "asks"), place, "vec_id long, d long, x array<double>, keys array<bigint>, probes array<array<bigint>>"))
    table = F.col("d") * TABLES + F.col("t")
    member = placed.select("vec_id", "d", "x", F.posexplode("keys").alias("t", "cell")).withColumn("t", table)
    asked = placed.where("probes is not null").select("vec_id", "d", "x", F.posexplode("probes").alias("t", "cells"))
    asked = asked.select("vec_id", "x", table.alias("t"), F.explode("cells").alias("cell"))
    # Cells with more rows than a block are few: at most TABLES * rows / MEMBERS.
    hot = member.groupBy("t", "cell").count().where(F.col("count") > MEMBERS).select("t", "cell", F.ceil(F.col("count") / MEMBERS).alias("nb"))
    hot = common.cut(hot)
    blocks = lambda d: d.join(hot, ["t", "cell"], "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long")))
    m = blocks(member).withColumn("mb", F.pmod(F.xxhash64("vec_id", F.lit(1)), "nb"))
    q = blocks(asked).withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    found = common.cut(_merged(_dealt(m, q, k), k))
    met = found.groupBy("query_id").agg(F.count("*").alias("met"))
    sizes = F.create_map(*[F.lit(x) for pair in (counts or {0: 0}).items() for x in pair])
    short = placed.where("probes is not null").join(met, F.col("vec_id") == F.col("query_id"), "left")
    short = common.cut(short.where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), F.element_at(sizes, F.col("d").cast("int")) - 1)).select("vec_id", "d", "x"))
    lacking = short.count()
    if lacking:
        exact = common.cut(_merged(_scanned(placed, short, sum(counts.values()), lacking, k), k))
        found = found.join(exact.select("query_id").distinct(), "query_id", "left_anti").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scanned(placed: DataFrame, short: DataFrame, rows: int, lacking: int, k: int) -> DataFrame:
    """Candidates of the queries that the tables left short, from all rows of their dimension."""
    nm, nq = -(-rows // SCAN), -(-lacking // ASKED)
    part = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asking = short.select("d").distinct()
    m = placed.join(asking, "d", "left_semi").select("vec_id", "x", F.col("d").alias("t"), part(nm).alias("mb"), every(nq).alias("cell"))
    q = short.select("vec_id", "x", F.col("d").alias("t"), part(nq).alias("cell"), every(nm).alias("mb"))
    return _dealt(m, q, k)


def _dealt(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each block (t, cell, mb) that holds it."""
    names = lambda d, role: d.select(F.col("t").cast("long").alias("t"), "cell", "mb", F.lit(role).cast("long").alias("role"), "vec_id", "x")
    dealt = names(members, 0).union(names(queries, 1)).repartition("t", "cell", "mb").sortWithinPartitions("t", "cell", "mb", "role")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = _Keeper(k)
        for table, starts in common.whole_groups(batches, 3):
            role, ids = table.column("role").to_numpy(), table.column("vec_id").to_numpy()
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                n = s + int((role[s:e] == 0).sum())
                if n in (s, e):
                    continue
                own = table.column("x").slice(s, e - s)
                x = vectors.matrix(own, len(own[0]))
                x, q = x[: n - s], x[n - s :]
                for at in range(0, len(q), 512):
                    scores = q[at : at + 512] @ x.T
                    for i, me in enumerate(ids[n + at : min(e, n + at + 512)]):
                        keeper.add(int(me), *_answers(q[at + i], me, ids[s:n], x, scores[i], k))
            if keeper.size > 500_000:
                yield keeper.flush()
        if keeper.size:
            yield keeper.flush()

    return dealt.mapInArrow(each, FOUND)
