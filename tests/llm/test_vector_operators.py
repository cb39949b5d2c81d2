"""The vector operators against brute force, with null, zero and broken vectors."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcprism.llm import lsh, pq

SCHEMA = "vec_id long, embedding array<float>, label int, v string, home int"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    base = rng.standard_normal((400, 16))
    near = base[:20].repeat(4, axis=0) + 0.05 * rng.standard_normal((80, 16))
    hot = base[30] + 0.02 * rng.standard_normal((150, 16))
    x = [*base, *near, *hot, *([base[40]] * 30), 3 * base[41], 1e18 * base[42]]
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    n = len(out)
    nan, inf = float("nan"), float("inf")
    bad = [None, [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    return out + [(n + i, v) for i, v in enumerate(bad)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash", 1) for r in rows], SCHEMA).repartition(3)


def sound(rows):
    keep = [(i, v) for i, v in rows if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([v for _, v in keep], dtype=np.float64)
    return np.array([i for i, _ in keep]), x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("size", [16, 512])
def test_every_link_is_found_and_none_below(frame, rows, size, monkeypatch):
    monkeypatch.setattr(pq, "LIST_SIZE", size)
    monkeypatch.setattr(pq, "MEMBERS", 64)
    monkeypatch.setattr(pq, "QUERIES", 128)
    ids, x = sound(rows)
    link = x @ x.T >= 0.9
    root = np.arange(len(ids))
    while True:
        new = np.where(link, root[None, :], len(ids)).min(axis=1)
        if (new == root).all():
            break
        root = new
    want = {i: (0, i, True) for i, _ in rows}
    for k, i in enumerate(ids.tolist()):
        want[i] = (int(link[k].sum()) - 1, int(ids[root[k]]), ids[root[k]] == i)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq.near_duplicates(frame).collect()}
    assert got == want


def test_near_duplicates_of_nothing(spark, rows):
    assert pq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    bad = spark.createDataFrame([(*r, 0, "", 1) for r in rows[-7:]], SCHEMA)
    got = pq.near_duplicates(bad).collect()
    assert len(got) == 7 and sum(r.n_links for r in got) == 0


def test_repeated_rows_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.1])]
    got = sorted(map(tuple, pq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, True)], key=repr)


def test_search_recall_and_order(frame, rows):
    ids, x = sound(rows)
    got = defaultdict(list)
    for r in lsh.search(frame, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for k, i in enumerate(ids):
        if i % 10:
            continue
        score = (x * x[k]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != k][:5]
        mine = got.pop(int(i))
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert [(s, -v) for _, v, s in mine] == sorted(((s, -v) for _, v, s in mine), reverse=True)
        for _, v, s in mine:
            assert abs(s - float(x[k] @ x[int(np.flatnonzero(ids == v)[0])])) < 1e-12
        hits += len({v for _, v, _ in mine} & set(ids[order].tolist()))
        total += 5
    assert not got and hits / total >= 0.95


def test_ties_go_to_the_smaller_id_and_few_rows_are_all_found(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)]
    got = lsh.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 4, 5]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in lsh.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [2, 1]
    assert lsh.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_probes_come_by_success_until_the_share_is_held():
    t = lsh.Tables(8, 4096, 1.0)
    place = t.places(np.ones((1, 8)) / np.sqrt(8))[0, 0]
    keys = t.probes(place)
    own = t.keys(np.floor(place))
    assert own in keys and len(set(keys.tolist())) == len(keys) > 1


def test_every_dimension_is_compared(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(1, 8)]
    rows += [(50, [1.0, 0.0]), (100, [1.0, 0.01]), (101, [0.0, 5.0]), (150, [2.0]), (9, [1.0]), (10, [-3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_duplicates(df).collect()}
    assert got[50] == (1, 50) and got[100] == (1, 50) and got[101] == (0, 101)
    assert got[150] == (1, 9) and got[9] == (1, 9) and got[10] == (0, 10)
    found = defaultdict(list)
    for r in lsh.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert dict(found) == {50: [100, 101], 100: [50, 101], 150: [9, 10]}


def test_short_queries_are_answered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh, "SCAN", 16)
    monkeypatch.setattr(lsh, "ASKED", 3)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 6)) * np.where(np.arange(90) % 2, 1, -1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    placed = lsh._scanned(df.select("vec_id", lsh.F.col("embedding").alias("x"), lsh.F.lit(6).cast("long").alias("d")), df.where("vec_id % 9 = 0").select("vec_id", F.col("embedding").alias("x"), F.lit(6).cast("long").alias("d")), 90, 10, 5)
    got = {(r.query_id, r["rank"]): r.vec_id for r in lsh._merged(placed, 5).collect()}
    for i in range(0, 90, 9):
        s = (x * x[i]).sum(axis=1)
        want = [j for j in np.argsort(-s, kind="stable") if j != i][:5]
        assert [got[i, k] for k in range(1, 6)] == want


def test_vectors_without_structure_are_not_copied_to_every_list(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST_SIZE", 32)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((300, 64))
    y -= (y * x[:300]).sum(axis=1)[:, None] * x[:300]
    y = 0.905 * x[:300] + np.sqrt(1 - 0.905**2) * y / np.linalg.norm(y, axis=1)[:, None]
    x = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    shuffled = lambda: sum(e.totalShuffleWrite() for e in iterate(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = shuffled()
    got = pq.near_duplicates(df).collect()
    assert shuffled() - before < 8 * x.nbytes
    want = {i for i in range(300) if float(x[i].astype(float) @ x[3000 + i] / np.linalg.norm(x[i]) / np.linalg.norm(x[3000 + i])) >= 0.9}
    linked = {r.vec_id for r in got if r.n_links}
    assert linked <= {*want, *(3000 + i for i in want)}
    assert sum(r.n_links for r in got) >= 0.9 * 2 * len(want) > 0


def iterate(seq):
    at = seq.iterator()
    while at.hasNext():
        yield at.next()
