"""Embedding near-duplicates by product quantisation.

Distinct vectors, scaled to length one, go into coarse lists (k-means on a bounded sample);
their residuals are coded subspace by subspace. A vector asks those lists that can hold a
neighbour within the radius: whose bisecting plane with its own list is no farther than the
radius. Where more than ``PROBES`` lists can, it asks the nearest ``PROBES``; a link is then
missed only if neither vector asks the list of the other. (Without structure nearly all lists
can hold a neighbour, and asking them all makes copies of a vector without bound.)

Codes alone go to the lists. A pair is left out where the distance of its codes, less the two
errors of coding, exceeds the radius; that loses no link. Only vectors of a pair that is left
are moved, to the lists in which they have a partner, and measured by their exact cosine.

Lists are dealt into blocks, so a hot list is spread over many tasks; a task returns counts and
a spanning forest of its links, never all pairs. A pair that two lists meet counts in one of
them. Copies are collapsed first: they are one vector with a weight.

Each dimension that occurs has lists and codes of its own; vectors of different dimensions have
no cosine and do not link. A dimension that the sample misses has one list and codes that prune
nothing.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with
nothing; a row is one vector, also if rows repeat; equal vectors are linked; a null vec_id never
names a component that has another; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from . import common, vectors

#: Vectors that fit the lists; those that fit the codes; lists at most; vectors of a list, about.
SAMPLE, CODED, LISTS, LIST_SIZE = 16_384, 4_096, 4_096, 2_048
#: Lists that a vector asks at most, its own among them.
PROBES = 12
#: Components of a subspace and codes of a subspace.
WIDTH, CODES = 2, 256
#: Lists are numbered within a dimension; the dimension stands above these bits.
LIST_BITS = 20
#: Members and queries of a block; queries and placed vectors handled at a time.
MEMBERS, QUERIES, CHUNK = 8192, 65_536, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of Lloyd's algorithm; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centre))
        full = count > 0
        centre[full] = total[full] / count[full, None]
    return centre


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    return np.maximum(d, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 2048], c).argmin(axis=1) for i in range(0, len(x), 2048)])


class Quantiser:
    """Coarse centres and residual codebooks, fitted on a bounded sample."""

    def __init__(self, x: np.ndarray, lists: int):
        x = x if len(x) else np.zeros((1, x.shape[1]))
        self.centres = kmeans(x, max(1, min(lists, len(x))))
        some = x[:CODED]
        rest = some - self.centres[nearest(some, self.centres)]
        self.spans = [(a, min(a + WIDTH, x.shape[1])) for a in range(0, x.shape[1], WIDTH)]
        self.books = [kmeans(rest[:, a:b], min(CODES, len(some)), 5) for a, b in self.spans]

    def lists(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """The lists that each vector asks, its own first."""
        out, most = [], min(PROBES, len(self.centres))
        for at in range(0, len(x), CHUNK):
            d = squared(x[at : at + CHUNK], self.centres)
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            d = np.take_along_axis(d, near, axis=1)
            order = d.argsort(axis=1, kind="stable")
            near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
            centre = self.centres[near]
            gap = np.sqrt(((centre - centre[:, :1]) ** 2).sum(axis=2))
            reach = d - d[:, :1] <= 2 * gap * radius + 1e-6
            out += [row[keep] for row, keep in zip(near, reach, strict=True)]
        return out

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and distance to what the codes stand for."""
        rest = x - self.centres[home]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)], axis=1).astype(np.uint8)
        return codes, np.sqrt(((x - self.decoded(home, codes)) ** 2).sum(axis=1)) + 1e-6

    def decoded(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        coded = np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)
        return (self.centres[home] + coded).astype(np.float32)


def near_codes(x: np.ndarray, far: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Members and queries whose product is half of (radius + both errors)^2 - distance^2.

    ``x``: what the codes stand for; ``far``: the error of each. A negative product rules a
    pair out.
    """
    half, one = (x * x).sum(axis=1, keepdims=True) / 2, np.ones((len(x), 1))
    far = far[:, None]
    members = np.concatenate([x, (radius + far) ** 2 / 2 - half, one, radius + far], axis=1)
    queries = np.concatenate([x, one, far**2 / 2 - half, far], axis=1)
    return members.astype(np.float32), queries.astype(np.float32)


def _sound(df: DataFrame) -> DataFrame:
    """(vec_id, v, d, k1, k2) of the valid rows; k1 and k2 are 96 bits of hash, by which copies are found."""
    single = isinstance(df.schema["embedding"].dataType.elementType, FloatType)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("v"))
    rows = rows.where(vectors.valid("v")).withColumn("d", F.size("v").cast("long"))
    return rows.select("vec_id", "v", "d", *_hashed())


def _hashed() -> list:
    v = F.col("v").cast("array<double>")
    return [F.xxhash64(v).alias("k1"), F.hash(v).cast("long").alias("k2")]


def _fitted(sound: DataFrame) -> dict[int, Quantiser]:
    """A quantiser for each dimension. The sample is one of distinct vectors."""
    counts = {r["d"]: r["n"] for r in sound.groupBy("d").agg(F.count_distinct("k1", "k2").alias("n")).collect()}
    parts, share = 1 << 30, min(1.0, SAMPLE / max(1, sum(counts.values())))
    some = sound.where(F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(parts)) < int(share * parts)) if share < 1 else sound
    some = some.groupBy("k1", "k2").agg(F.any_value("d").alias("d"), F.any_value("v").alias("v"))
    fit = vectors.sample(some, 1, 1, "k1")
    return {
        d: Quantiser(vectors.unit(fit[d]) if d in fit else np.zeros((0, d)), min(LISTS, max(1, n // LIST_SIZE))) for d, n in sorted(counts.items())
    }


def near_duplicates(df: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", *[F.when(vectors.valid("v"), h).alias(f"k{i}") for i, h in enumerate(_hashed(), 1)])
    sound = _sound(df)
    quantisers = df.sparkSession.sparkContext.broadcast(_fitted(sound))
    radius = float(np.sqrt(2 - 2 * least))

    def place(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for d, at, x in vectors.by_dimension(batch.column(3)):
            x, quantiser = vectors.unit(x.astype(np.float64)), quantisers.value[d]
            asked = quantiser.lists(x, radius)
            home = np.array([a[0] for a in asked], dtype=np.int64)
            codes, error = quantiser.code(x, home)
            own = [batch.column(i).take(pa.array(at)) for i in range(3)]
            first = d << LIST_BITS
            out.append(pa.record_batch(
                [*own, pa.array(home + first), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                 pa.array([(a + first).tolist() for a in asked], pa.list_(pa.int64()))],
                names=["vec_id", "k1", "k2", "home", "codes", "error", "probes"],
            ))
        return pa.Table.from_batches(out)

    schema = "vec_id long, k1 long, k2 long, home long, codes binary, error double, probes array<bigint>"
    placed = common.map_batches(sound.select("vec_id", "k1", "k2", "v"), place, schema)
    one = F.any_value(F.struct("home", "codes", "error", "probes")).alias("x")
    reps = placed.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"), one)
    reps = common.cut(reps.select("k1", "k2", "first", "mult", "x.*").withColumn("rid", F.monotonically_increasing_id()))
    columns = ["list", "mb", "qb", "role", "rid", "mult", "home", "probes"]

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            yield from _partnered(table, quantisers.value, radius).select(columns).to_batches()

    meeting = "list long, mb long, qb long, role long, rid long, mult long, home long, probes array<bigint>"
    meeting = common.cut(_by_block(_dealt(reps), [*columns, "codes", "error"]).mapInArrow(filtered, meeting))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            yield from _linked(table, quantisers.value, least)

    moved = meeting.join(_vectors(sound, reps.join(meeting.select("rid").distinct(), "rid")), "rid")
    found = common.cut(_by_block(moved, [*columns, "v"]).mapInArrow(measured, "edge boolean, a long, b long"))
    links = found.where("not edge").groupBy(F.col("a").alias("rid")).agg(F.sum("b").alias("n"))
    roots = common.components(found.where("edge").select(F.col("a").alias("u"), F.col("b").alias("v")))
    linked = reps.select("rid", "k1", "k2", "first", "mult").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    linked = common.cut(
        linked.select("k1", "k2", "mult", "first", F.coalesce("root", "rid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    )
    least_id = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    table = linked.join(least_id, "root").select("k1", "k2", "n_links", "component_id")
    found = common.looked_up(rows, table, ["k1", "k2"], linked.select("k1", "k2", F.col("mult").alias("n")), "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _dealt(reps: DataFrame) -> DataFrame:
    """Each vector as a member of its own list and as a query of those it asks, by block."""
    role = lambda i: F.lit(i).cast("long").alias("role")
    own = ["rid", "mult", "home"]
    members = reps.select(F.col("home").alias("list"), role(0), *own, "probes", "codes", "error")
    queries = reps.select(F.explode("probes").alias("list"), role(1), *own, F.lit(None).cast("array<bigint>").alias("probes"), "codes", "error")
    # One row for each list, at most LISTS.
    per_list = reps.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / MEMBERS).alias("nm"))
    asked = reps.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("nq"))
    sizes = F.broadcast(per_list.join(asked, "list"))
    salt = F.xxhash64("rid", F.lit(1))
    m = members.join(sizes, "list").withColumn("mb", F.pmod(salt, "nm")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    q = queries.join(sizes, "list").withColumn("qb", F.pmod(salt, "nq")).withColumn("mb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)))
    return m.unionByName(q)


def _by_block(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns).repartition("list", "mb", "qb").sortWithinPartitions("list", "mb", "qb", "role")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The blocks that hold members and queries."""
    for table, starts in common.whole_groups(batches, 3):
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            part = table.slice(s, e - s).combine_chunks()
            role = part.column("role").to_numpy()
            if 0 < (role == 0).sum() < len(role):
                yield part


def _vectors(sound: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rid, v) of the wanted vectors. Only the rows that stand for their copies are moved."""
    wanted = common.cut(wanted.select("rid", "k1", "k2", "first", "mult"))
    counts = wanted.select("k1", "k2", F.col("mult").alias("n"))
    rows = common.looked_up(sound.select("vec_id", "k1", "k2", "v"), wanted.drop("mult"), ["k1", "k2"], counts, "vec_id")
    rows = rows.where(F.col("rid").isNotNull() & F.col("vec_id").eqNullSafe(F.col("first")))
    return rows.groupBy("rid").agg(F.any_value("v").alias("v"))


def _asks(table: pa.Table, n: int, lists: int) -> np.ndarray:
    """Whether each of the ``n`` members asks each list."""
    probes = table.column("probes").combine_chunks().slice(0, n)
    out = np.zeros((n, lists), dtype=bool)
    sizes = pc.list_value_length(probes).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(n), sizes), probes.flatten().to_numpy() & (1 << LIST_BITS) - 1] = True
    return out


def _partnered(table: pa.Table, quantisers: dict[int, Quantiser], radius: float) -> pa.Table:
    """The rows of a block whose codes leave them a partner."""
    listed = table.column("list")[0].as_py()
    quantiser = quantisers[listed >> LIST_BITS]
    role, rid, home, error = (table.column(c).to_numpy() for c in ("role", "rid", "home", "error"))
    n = int((role == 0).sum())
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(role), -1)
    members, queries = near_codes(quantiser.decoded(home & (1 << LIST_BITS) - 1, codes), error, radius)
    members = members[:n].copy()
    asks = _asks(table, n, len(quantiser.centres))
    some = np.zeros(len(role), dtype=bool)
    for at in range(n, len(role), CHUNK):
        near = queries[at : at + CHUNK] @ members.T >= -1e-4
        i, j = np.divmod(np.flatnonzero(near), n)
        i += at
        # A pair that two lists meet is left to the lower one.
        keep = (rid[i] != rid[j]) & ~((home[i] < listed) & asks[j, home[i] & (1 << LIST_BITS) - 1])
        some[i[keep]] = some[j[keep]] = True
    return table.filter(pa.array(some))


def _linked(table: pa.Table, quantisers: dict[int, Quantiser], least: float) -> Iterator[pa.RecordBatch]:
    """Counts and a forest of the links of one block."""
    listed = table.column("list")[0].as_py()
    dim = listed >> LIST_BITS
    role, rid, mult, home = (table.column(c).to_numpy() for c in ("role", "rid", "mult", "home"))
    n = int((role == 0).sum())
    x = vectors.unit(vectors.matrix(table.column("v"), dim).astype(np.float64))
    asks = _asks(table, n, len(quantisers[dim].centres))
    counts = np.zeros(len(role), dtype=np.int64)
    edges: list[np.ndarray] = []
    for at in range(n, len(role), CHUNK):
        to = min(at + CHUNK, len(role))
        link = x[at:to] @ x[:n].T >= least
        link &= rid[at:to, None] != rid[None, :n]
        lower = np.flatnonzero(home[at:to] < listed)
        link[lower] &= ~asks[:, home[at:to][lower] & (1 << LIST_BITS) - 1].T
        if not link.any():
            continue
        counts[at:to] += link @ mult[:n]
        # Pairs of two lists are seen once: they count for the member too.
        other = (home[at:to] != listed).astype(np.int64) * mult[at:to]
        counts[:n] += other @ link
        ra, rb = common.bipartite_roots(link, False)
        every, root = np.concatenate([rid[at:to], rid[:n]]), np.concatenate([ra, rb])
        moved = np.flatnonzero(root != np.arange(len(root)))
        edges.append(np.stack([every[moved], every[root[moved]]], axis=1))
    some = np.flatnonzero(counts)
    if len(some):
        pairs = np.concatenate([np.stack([rid[some], counts[some]], axis=1), *edges])
        flags = np.arange(len(pairs)) >= len(some)
        yield pa.record_batch([pa.array(flags), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["edge", "a", "b"])
