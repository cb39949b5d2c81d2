"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of its word
shingles. Fingerprints with at most ``RADIUS`` differing bits are linked.

Pigeonring: the 64 bits lie on a ring of ``m = RADIUS + 1`` segments. If the differences total
at most ``t = RADIUS``, some segment starts a chain in which the first ``l`` segments differ in
at most ``floor(l * t / m)`` bits, for every ``l`` up to ``m``. The first segment of that chain
is then equal, so fingerprints meet in an index keyed by one whole segment; pairs whose chains
exceed a budget are pruned before the full Hamming check. ``depth=2`` keys the index by two
segments of the chain, the second with one bit left out, which suits very many fingerprints.
No pair within the radius is lost at either depth.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and are
linked like any other; a null doc_id keeps its row and counts only if its component has no
other; repeated rows come out repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common, shingles

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Bytes of a text handled at a time; words are never cut.
SLICE = 1 << 20
#: Above so many distinct fingerprints the index is keyed by two segments of the chain.
DEEP_FROM = 1 << 23


def _word_slices(data: bytes) -> Iterator[list[bytes]]:
    space = b" \t\n\x0b\x0c\r"
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in space:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    if not text:
        return 0
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_slices(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= n:
            grams = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
            h = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype="<u8")
            total += len(h)
            for i in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
        tail = words[max(0, len(words) - n + 1) :]
    if not total:
        return xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp: the fingerprint's bits as a signed long) for each row of ``docs``."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, n) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, fp long")


def segments(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of the ring."""
    m = radius + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _index(reps: DataFrame, radius: int, depth: int) -> DataFrame:
    """(seg, key, fp): where each fingerprint stands in the index."""
    ring = segments(radius)
    part = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    keys = []
    for i, (at, width) in enumerate(ring):
        if depth == 1:
            keys.append(F.struct(F.lit(i).alias("seg"), part(at, width).alias("key")))
            continue
        at2, width2 = ring[(i + 1) % len(ring)]
        for bit in range(width2):
            rest = part(at2, width2).bitwiseAND(F.lit(((1 << width2) - 1) & ~(1 << bit)))
            key = F.shiftleft(F.shiftleft(part(at, width), width2).bitwiseOR(rest), 8).bitwiseOR(F.lit(bit))
            keys.append(F.struct(F.lit(i).alias("seg"), key.alias("key")))
    return reps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.seg", "k.key", "fp")


def linked(a: np.ndarray, b: np.ndarray, seg: int, radius: int = RADIUS) -> np.ndarray:
    """Which of ``a`` and ``b`` (uint64, equal in segment ``seg``) are within the radius.

    Chain budgets prune before the remaining segments are counted.
    """
    ring, m = segments(radius), radius + 1
    link = np.zeros((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 256):
        diff = (a[at : at + 256, None] ^ b[None, :]).ravel()
        pair = np.arange(len(diff))
        total = np.zeros(len(diff), dtype=np.int32)
        for step in range(m):
            first, width = ring[(seg + step) % m]
            total += np.bitwise_count(diff >> np.uint64(first) & np.uint64((1 << width) - 1))
            keep = total <= (step + 1) * radius // m
            diff, pair, total = diff[keep], pair[keep], total[keep]
        link[at + pair // len(b), pair % len(b)] = True
    return link


def links(reps: DataFrame, radius: int = RADIUS, depth: int = 1) -> DataFrame:
    """Edges (u, v) of a spanning forest of the links in each pair of index blocks.

    A forest has fewer edges than its block has fingerprints, so a dense group never yields
    all its pairs, yet what is connected stays connected.
    """
    dealt = common.block_pairs(_index(reps, radius, depth), ["seg", "key"], "fp")
    dealt = dealt.select(F.col("seg").cast("long"), "key", F.col("bi").cast("long"), F.col("bj").cast("long"), "own", "fp")
    dealt = dealt.repartition("seg", "key", "bi", "bj").sortWithinPartitions("seg", "key", "bi", "bj")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in common.whole_groups(batches, 4):
            seg, _, bi, bj, own, fp = (table.column(i).to_numpy() for i in range(6))
            fp, us, vs = fp.view(np.uint64), [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                x, same = fp[s:e], bi[s] == bj[s]
                a, b = (x, x) if same else (x[own[s:e] == bi[s]], x[own[s:e] == bj[s]])
                if not len(a) or not len(b):
                    continue
                link = linked(a, b, int(seg[s]), radius)
                if link.sum() <= (len(a) if same else 0):
                    continue
                ra, rb = common.bipartite_roots(link, same)
                every = a if same else np.concatenate([a, b])
                root = ra if same else np.concatenate([ra, rb])
                moved = np.flatnonzero(root != np.arange(len(root)))
                us.append(every[moved])
                vs.append(every[root[moved]])
            if us:
                u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(each, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, depth: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links.

    Copies share a fingerprint, so only distinct fingerprints are compared.
    """
    prints = common.cut(fingerprints(docs, n))
    reps = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    if depth is None:
        depth = 1 if reps.count() < DEEP_FROM else 2
    roots = common.components(links(reps.select("fp"), radius, depth))
    grouped = reps.join(roots, reps.fp == roots.node)
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    moved = common.cut(grouped.join(least, "root").select("fp", "least"))
    table = reps.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return common.looked_up(prints, table, ["fp"], reps.select("fp", "n"), "doc_id").select("doc_id", "fp", "component_id")


def met(sets: DataFrame, radius: int = RADIUS, depth: int | None = None) -> DataFrame:
    """(u, v): candidates among sets (h, fp), from the links of their fingerprints.

    Sets of one fingerprint meet the smallest of them, which stands for them in the index.
    """
    prints = common.cut(sets.groupBy("fp").agg(F.min("h").alias("hub"), F.count("*").alias("n")))
    if depth is None:
        depth = 1 if prints.count() < DEEP_FROM else 2
    hubs = prints.select("fp", "hub")
    linked = links(prints.select("fp"), radius, depth).distinct()
    across = linked.join(hubs.toDF("u", "a"), "u").join(hubs.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    within = common.looked_up(sets, hubs, ["fp"], prints.select("fp", "n"), "h").where("h <> hub")
    return across.union(within.select(F.col("h").alias("u"), F.col("hub").alias("v")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component of near copies stays, the others go.

    It is the row with the smallest doc_id; of rows that share it, the one read first; rows
    without a doc_id come last. Rows go, not ids: a row with another text stays, whatever its
    doc_id. Null and empty texts are copies of each other; an empty table stays empty; columns
    are returned as they came. Only the row ids that go are looked up, so texts move only if
    those are too many to broadcast.

    Near duplicates share 0.8 of their 5-word shingles. The pigeonring index links the fingerprints
    of these shingles; each link is verified shingle by shingle. Fingerprints of texts at the bound
    differ in about nine bits and often in more, which the segments of a 64-bit ring cannot tell
    from chance: such texts meet by min-hashes as well and are verified alike.
    """
    rid = "rid"
    while rid in map(str.lower, docs.columns):
        rid = f"_{rid}"
    rows = common.cut(docs.withColumn(rid, F.monotonically_increasing_id()))
    found, table = shingles.classes(rows.select(F.col(rid).alias("rid"), F.col("doc_id"), F.col("text")), met)
    # A class's first row is its own if no similar class has a smaller one.
    gone = common.cut(found.select("rid").join(table.select("first.rid").distinct(), "rid", "left_anti"))
    return rows.join(gone.withColumnRenamed("rid", rid), rid, "left_anti").select(*docs.columns)
