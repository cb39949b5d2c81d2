"""Near copies by the Jaccard similarity of word shingles, verified exactly.

Texts whose sets of ``N``-word shingles are equal are one set. Sets meet where the SimHash index
links their fingerprints (``near`` of ``classes``), and, as sets at the bound differ in more bits
than a 64-bit ring can tell from chance, where ``ROWS`` min-hashes
of one of ``BANDS`` bands agree; of two sets at the bound ``LEAST`` a band agrees with probability
0.8^4, so all ``BANDS`` miss with probability 3e-6. Sizes and one bit of each min-hash rule out
what is far off (a pair at the bound passes ``FAR`` with probability 1 - 1e-8), and the texts of
each pair that is left are compared shingle by shingle.

First each set is compared with the one that the SimHash index links it to, and with the nearest
of the smallest sets of its bands. That joins dense
groups with one comparison a set. Then bands that still hold several components are dealt into
blocks of bounded size. Sizes and bits tell which sets of a block have a partner there; these
sets alone are brought to it, and all their pairs are compared, each in the first band that
holds it. A block yields a forest of its links, never its pairs.

Edge cases: texts of fewer words are one shingle; null and empty texts, and texts of white space,
have no shingle and are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

N, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Min-hashes in all, and how many of their low bits may differ.
HASHES, FAR = 128, 32
#: Bytes of shingles in a block of sets, about.
BLOCK_BYTES = 1 << 25
SEED = 42
#: Shingles that are hashed by all min-hashes at a time: two tables of 128 kB.
CHUNK = 128

_rng = np.random.default_rng(SEED)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    count = max(1, len(words) - n + 1)
    grams = (b" ".join(words[i : i + n]) for i in range(count))
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, count))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - both
    return both / whole if whole else 1.0


def minhashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed, high = np.empty((2, min(CHUNK, len(found)), HASHES), dtype=np.uint64)
    for at in range(0, len(found), CHUNK):
        some = found[at : at + CHUNK, None]
        x, y = mixed[: len(some)], high[: len(some)]
        np.multiply(some, _MUL, out=x)
        np.add(x, _ADD, out=x)
        np.right_shift(x, np.uint64(32), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint64(0x9E3779B97F4A7C15), out=x)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def majority(found: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is 1 if it is in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), 1 << 16):
        some = found[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def signatures(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, t: a hash of the text, h: of its set, size, s0, s1: low bits, fp: its SimHash, keys: of its bands).

    ``docs`` has a row id, rid, that no two rows share.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ident, sizes, bits, prints, keys = [], [], [], [], []
        for text in batch.column(3).to_pylist():
            found = shingles(text)
            low = minhashes(found)
            ident.append(xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            prints.append(majority(found))
            # The lowest bits of products are poor; bit 40 is mixed.
            bits.append(np.packbits((low >> np.uint64(40) & np.uint64(1)).astype(bool)).view(np.int64))
            bands = low[: BANDS * ROWS].reshape(BANDS, ROWS)
            keys.append([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(bands)])
        flat = np.array(keys, dtype=np.uint64).view(np.int64).ravel()
        listed = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32), pa.array(flat))
        two = np.array(bits)
        columns = [*batch.columns[:3], pa.array(np.array(ident, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(np.array(prints, np.uint64).view(np.int64)), listed]
        return pa.record_batch(columns, names=["rid", "doc_id", "t", "h", "size", "s0", "s1", "fp", "keys"])

    rows = docs.select("rid", F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    return common.map_batches(rows, each, "rid long, doc_id long, t long, h long, size int, s0 long, s1 long, fp long, keys array<long>")


def _far(s0: Column, s1: Column, z0: Column, z1: Column) -> Column:
    return F.bit_count(s0.bitwiseXOR(z0)) + F.bit_count(s1.bitwiseXOR(z1))


def _nearest(reps: DataFrame) -> DataFrame:
    """(u, v): each set and the nearest of the smallest sets of its bands."""
    index = reps.select(F.explode("keys").alias("key"), "h", "size", "s0", "s1")
    hubs = index.groupBy("key").agg(F.min(F.struct("h", "size", "s0", "s1")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = common.cut(hubs)
    met = common.looked_up(index, hubs.drop("n"), ["key"], hubs.select("key", "n"), "h").where("h <> hub.h")
    met = met.withColumn("far", _far(F.col("s0"), F.col("s1"), F.col("hub.s0"), F.col("hub.s1")))
    near = (F.col("far") <= FAR) & _sized(F.col("size"), F.col("hub.size"))
    best = met.where(near).groupBy("h").agg(F.min(F.struct("far", "hub.h")).alias("best"))
    return best.select(F.col("h").alias("u"), F.col("best.h").alias("v"))


def _sized(a: Column, b: Column) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(LEAST)


def _texts(reps: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, text): one text of each wanted set. Only these are moved."""
    named = reps.select("h", "t").join(wanted, "h")
    return docs.select(F.xxhash64("text").alias("t"), "text").join(named, "t").dropDuplicates(["h"]).select("h", "text")


def _apart(reps: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): links that join what is not yet joined, from all pairs of all bands."""
    rows = reps.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    rows = common.cut(rows.select("h", F.col("size").cast("long"), "s0", "s1", "root", "keys"))
    index = rows.select("h", "size", "root", F.posexplode("keys").alias("band", "key"))
    mixed = index.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n"), F.sum("size").alias("words")).where("a <> b")
    blocks = F.greatest(F.ceil(F.col("n") / common.BLOCK), F.ceil(F.col("words") * 8 / BLOCK_BYTES)).cast("long")
    mixed = common.cut(mixed.select("key", blocks.alias("nb")))
    placed = common.cut(index.join(mixed, "key").select("key", "nb", F.col("band").cast("long").alias("band"), "h"))

    own = F.pmod(F.xxhash64("h", F.lit(7)), F.col("nb"))
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "band", "h")
    meeting = common.cut(_by_block(dealt.join(rows, "h"), [], _partnered, "key long, bi long, bj long, own long, band long, h long"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["h", "found"])

    sets = common.map_batches(_texts(reps, meeting.select("h").distinct(), docs), hashed, "h long, found binary").join(rows, "h")
    return common.cut(_by_block(meeting.join(sets, "h"), ["found"], _linked, "u long, v long").distinct())


def _by_block(rows: DataFrame, more: list[str], each: Callable[[pa.Table], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What ``each`` finds in each pair of blocks (key, bi, bj)."""
    rows = rows.select("key", "bi", "bj", "own", "band", "h", "size", "s0", "s1", "root", "keys", *more)
    rows = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, 3):
            found = [each(table.slice(s, e - s)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch({c: pa.array(np.concatenate([x[c] for x in found])) for c in found[0]})

    return rows.mapInArrow(run, schema)


def _near(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a pair of blocks and those it may be similar to, the nearest first."""
    bi, bj, own, band, _, size, s0, s1, root = (table.column(i).to_numpy() for i in range(1, 10))
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
    keys = table.column(10).combine_chunks().flatten().to_numpy().reshape(len(root), -1)
    every, same = np.arange(len(root)), bi[0] == bj[0]
    rows, others = (every, every) if same else (every[own == bi[0]], every[own == bj[0]])
    for i in rows.tolist():
        cols = others[others > i] if same else others
        far = np.bitwise_count(s0[i] ^ s0[cols]) + np.bitwise_count(s1[i] ^ s1[cols])
        near = (far <= FAR) & (root[i] != root[cols])
        near &= np.minimum(size[i], size[cols]) >= LEAST * np.maximum(size[i], size[cols])
        cols, far = cols[near], far[near]
        if len(cols):
            first = (keys[cols] == keys[i]).argmax(axis=1) == band[0]
            yield i, cols[first][np.argsort(far[first], kind="stable")]


def _partnered(table: pa.Table) -> dict[str, np.ndarray]:
    """The rows that may be similar to another of their pair of blocks."""
    some = np.zeros(len(table), dtype=bool)
    for i, cols in _near(table):
        some[cols] = True
        some[i] |= len(cols) > 0
    return {c: table.column(c).to_numpy()[some] for c in ("key", "bi", "bj", "own", "band", "h")}


def _linked(table: pa.Table) -> dict[str, np.ndarray]:
    """A forest of the links of one pair of blocks that join different components."""
    h, root, found = table.column("h").to_numpy(), table.column("root").to_numpy(), table.column("found")
    up: dict[int, int] = {}
    sets: dict[int, set | np.ndarray] = {}

    def find(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    def held(i: int) -> set | np.ndarray:
        if i not in sets:
            words = np.frombuffer(found[i].as_py(), np.uint64)
            sets[i] = set(words.tolist()) if len(words) < CHUNK * 32 else words
        return sets[i]

    def alike(i: int, j: int) -> bool:
        a, b = held(i), held(j)
        if isinstance(a, set) and isinstance(b, set):
            both = len(a & b)
            return both / (len(a) + len(b) - both) >= LEAST
        a, b = (np.array(sorted(x), np.uint64) if isinstance(x, set) else x for x in (a, b))
        return similarity(a, b) >= LEAST

    edges = []
    for i, cols in _near(table):
        for j in cols.tolist():
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b and alike(i, j):
                up[max(a, b)] = min(a, b)
                edges.append((int(h[i]), int(h[j])))
    u, v = np.array(edges, dtype=np.int64).reshape(-1, 2).T
    return {"u": u, "v": v}


def _possible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that sizes and bits do not rule out."""
    side = lambda x: reps.select(F.col("h").alias(x), *[F.col(c).alias(x + c) for c in ("size", "s0", "s1")])
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    near = _far(F.col("us0"), F.col("us1"), F.col("vs0"), F.col("vs1")) <= FAR
    return both.where(near & _sized(F.col("usize"), F.col("vsize"))).select("u", "v")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts are similar, shingle by shingle. Only their texts are moved."""
    pairs = common.cut(pairs)
    wanted = pairs.select(F.col("u").alias("h")).union(pairs.select("v")).distinct()
    texts = common.cut(_texts(reps, wanted, docs))
    sides = pairs.join(texts.select(F.col("h").alias("u"), F.col("text").alias("a")), "u")
    sides = sides.join(texts.select(F.col("h").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v, a, b = batch.columns
        ok, name, other = [], None, None
        for k, x, y in zip(v.to_pylist(), a.to_pylist(), b.to_pylist(), strict=True):
            if name != k:
                name, other = k, shingles(y)
            ok.append(similarity(shingles(x), other) >= LEAST)
        mask = pa.array(ok, pa.bool_())
        return pa.record_batch([u.filter(mask), v.filter(mask)], names=["u", "v"])

    return common.cut(common.map_batches(sides, each, "u long, v long"))


def classes(docs: DataFrame, near: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows (rid, doc_id, h) and, for each set of shingles h: n, its rows, and ``first``.

    first (unnamed, doc_id, rid) is the least row reachable by similar texts: that with the
    smallest doc_id, of equal ones that read first; rows without doc_id come last. ``near`` gives
    candidates (u, v) among sets (h, fp: SimHash); they are verified like all others.
    """
    prints = common.cut(signatures(docs))
    one = F.min(F.struct("t", "size", "s0", "s1", "fp", "keys")).alias("x")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("first")
    reps = common.cut(prints.groupBy("h").agg(first, F.count("*").alias("n"), one).select("h", "first", "n", "x.*"))
    candidates = _possible(near(reps.select("h", "fp")), reps).union(_nearest(reps)).distinct()
    linked = _verified(candidates, reps, docs)
    linked = linked.union(_apart(reps, common.components(linked), docs))
    grouped = reps.select("h", "first").join(common.components(linked), F.col("h") == F.col("node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    moved = common.cut(grouped.join(least, "root").select("h", "least"))
    table = common.cut(reps.join(moved, "h", "left").select("h", "n", F.coalesce("least", "first").alias("first")))
    return prints.select("rid", "doc_id", "h"), table


def near_copies(docs: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable by similar texts."""
    rows, table = classes(common.cut(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())), near)
    found = common.looked_up(rows, table.select("h", "first.doc_id").withColumnRenamed("doc_id", "component_id"), ["h"], table.select("h", "n"), "rid")
    return found.select("doc_id", "component_id")
