"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from srcprism.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 9) if isinstance(x, float) else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(columns, want.fetchall())
    spark.catalog.clearCache()


def test_maximal_clones_are_a_greedy_cover(spark):
    from srcprism.operators import recur

    sites = [("a", "h1", 30, 1, 9), ("b", "h1", 30, 1, 9), ("a", "h2", 10, 2, 4), ("b", "h2", 10, 2, 4), ("c", "h2", 10, 5, 7), ("d", "h2", 10, 1, 3), ("c", "h3", 9, 20, 22)]
    df = spark.createDataFrame(sites, "path string, hash string, mass int, line int, end_line int")
    assert sorted(map(tuple, recur.maximal_clones(df).collect())) == [("h1", 2, 30), ("h2", 2, 10)]


def test_entry_reports_violations(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"metric", "path", "value", "hi", "severity", "rn"} <= set(rows[0].asDict())


def test_colouring_agrees_with_the_search(spark):
    import random

    from srcprism.operators import graph as G

    rng = random.Random(2)
    df = spark.createDataFrame(sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)}), "src string, dst string").where("src <> dst")
    assert sorted(map(tuple, G.components(df, 0).collect())) == sorted(map(tuple, G.components(df).collect()))
    assert sorted(map(tuple, G.depths(df, most=0).collect())) == sorted(map(tuple, G.depths(df).collect()))
    nodes = df.select(G.F.col("src").alias("path")).union(df.select("dst")).distinct()
    assert sorted(map(tuple, G.blast_radius(nodes, df, 0).collect())) == sorted(map(tuple, G.blast_radius(nodes, df).collect()))


def test_blast_of_a_graph_whose_core_is_small(spark, monkeypatch):
    import random

    from srcprism.operators import graph as G

    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(12)} | {(f"s{i}", f"n{rng.randrange(9)}") for i in range(60) for _ in range(2)} | {("s1", "s2"), ("s2", "s1"), ("t", "n0")}
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes = sorted({n for p in pairs for n in p} | {"alone"})
    want = {}
    for node in nodes:
        seen, todo = {node}, [node]
        while todo:
            new = {a for a, b in pairs if b == todo[-1]} - seen
            todo.pop()
            seen |= new
            todo += new
        want[node] = len(seen) - 1
    # More edges than one task may hold: the closure must not be needed.
    monkeypatch.setattr(G, "reach", None)
    df, modules = spark.createDataFrame(sorted(pairs), "src string, dst string"), spark.createDataFrame([(n,) for n in nodes], "path string")
    assert dict(map(tuple, G.blast_radius(modules, df, 40, 7).collect())) == want
    assert dict(map(tuple, G.blast_radius(modules, df.limit(0), 40, 7).collect())) == dict.fromkeys(nodes, 0)


def _chained(spark):
    """Cycles in the middle, leaves below, and importers above them in three layers."""
    import random

    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)} | {(f"n{i}", f"z{i % 3}") for i in range(5)}
    pairs |= {(f"a{i}", f"n{rng.randrange(9)}") for i in range(40)} | {(f"b{i}", f"a{rng.randrange(40)}") for i in range(40)} | {(f"c{i}", f"b{rng.randrange(40)}") for i in range(40)} | {("y", "x")}
    return spark.createDataFrame(sorted((a, b) for a, b in pairs if a != b), "src string, dst string")


def test_components_of_a_graph_whose_core_is_small_are_searched(spark, monkeypatch):
    from srcprism.operators import graph as G

    df, seen = _chained(spark), []
    want = sorted(map(tuple, G.components(df).collect()))
    ordered = G.ordered
    monkeypatch.setattr(G, "ordered", lambda g: seen.append(g.count()) or ordered(g))
    assert sorted(map(tuple, G.components(df, 30).collect())) == want
    assert seen and seen[0] <= 30


def test_cycle_mass_of_a_graph_whose_core_is_small(spark, monkeypatch):
    from srcprism.operators import graph as G

    df = _chained(spark)
    want = tuple(G.cycle_mass(G.components(df)).first())
    ordered, seen = G.ordered, []
    monkeypatch.setattr(G, "ordered", lambda g: seen.append(1) or ordered(g))
    assert tuple(G.cycle_mass(G.components(df, 30)).first()) == want and seen


def test_depths_of_a_graph_whose_core_is_small_are_searched(spark, monkeypatch):
    from srcprism.operators import graph as G

    df, seen = _chained(spark), []
    want = sorted(map(tuple, G.depths(df).collect()))
    ordered = G.ordered
    monkeypatch.setattr(G, "ordered", lambda g: seen.append(g.count()) or ordered(g))
    for most in (30, 60, 110):
        assert sorted(map(tuple, G.depths(df, most=most).collect())) == want
    assert len(seen) == 3 and seen[0] <= 30


def test_deletable_needs_no_closure(spark, monkeypatch):
    from srcprism.operators import graph as G

    df = _chained(spark)
    modules = df.select(G.F.col("src").alias("path")).union(df.select("dst")).distinct()
    first = tuple(G.deletable(modules, G.blast_radius(modules, df)).first())
    monkeypatch.setattr(G, "reach", None)
    assert tuple(G.deletable(modules, G.blast_radius(modules, df, 110, 16)).first()) == first


def test_load_bearing_needs_no_closure(spark, monkeypatch):
    from srcprism.operators import graph as G

    df = _chained(spark)
    modules = df.select(G.F.col("src").alias("path")).union(df.select("dst")).distinct()
    want = list(map(tuple, G.load_bearing(G.blast_radius(modules, df)).collect()))
    monkeypatch.setattr(G, "reach", None)
    assert list(map(tuple, G.load_bearing(G.blast_radius(modules, df, 110, 16)).collect())) == want


def test_maximal_clones_of_nested_sites_are_dealt_over_files(spark):
    import random

    from srcprism.operators import recur

    rng = random.Random(4)
    sites, used = [], set()
    for h in range(40):
        mass = rng.randrange(5, 40)
        for _ in range(rng.randrange(1, 6)):
            path, line = f"p{rng.randrange(6)}", rng.randrange(1, 60)
            end = line + rng.randrange(0, 30)
            if (h, path, line) not in used:
                used.add((h, path, line))
                sites.append((path, f"h{h:02}", mass, line, end))
    by_hash, spans, want = {}, {}, []
    for s in sites:
        by_hash.setdefault(s[1], []).append(s)
    tried = {h: g for h, g in by_hash.items() if len(g) > 1}
    for h in sorted(tried, key=lambda h: (-(len(tried[h]) - 1) * tried[h][0][2], *min((s[0], s[3]) for s in tried[h]), h)):
        fresh = [s for s in tried[h] if not any(a <= s[3] and s[4] <= b for a, b in spans.get(s[0], ()))]
        if len(fresh) >= 2:
            want.append((h, len(fresh), (len(fresh) - 1) * fresh[0][2]))
            for s in tried[h]:
                spans.setdefault(s[0], []).append((s[3], s[4]))
    assert 3 < len(want) < len(tried)
    df = spark.createDataFrame(sites, "path string, hash string, mass int, line int, end_line int")
    got = recur.maximal_clones(df)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # No task gets all sites: a constant key would.
    assert "[g#" not in got._jdf.queryExecution().toString()


def _worded(spark):
    import random

    rng = random.Random(6)
    base = [f"w{rng.randrange(40)}" for _ in range(30)]
    texts = [(f"p{i % 17}", "", base[rng.randrange(9) :] + [f"x{rng.randrange(3)}" for _ in range(rng.randrange(9))]) for i in range(20)]
    return spark.createDataFrame(texts, "path string, unit string, tokens array<string>")


def test_suppressed_prints_move_no_units_and_count_a_path_once(spark):
    from srcprism.operators import recur

    tokens = _worded(spark)
    posts = {}
    for path, _, fp in recur.prints(tokens).collect():
        posts.setdefault(fp, set()).add(path)
    wide = [len(u) for u in posts.values() if len(u) > 4]
    assert wide and all(len(fp) == 32 for fp in posts)
    got = recur.suppressed_prints(recur.print_sets(tokens), tokens.select("path", "unit"), 4)
    assert tuple(got.first()) == (len(wide), max(wide))
    once = spark.createDataFrame(tokens.dropDuplicates(["path"]).collect(), tokens.schema)
    plan = recur.suppressed_prints(recur.print_sets(once), once.select("path", "unit"), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(fp" in plan


def test_near_clones_of_paths_that_come_twice(spark):
    from srcprism.operators import recur

    tokens = _worded(spark).where("length(path) = 2")
    of = {}
    for path, _, fp in recur.prints(tokens).collect():
        of.setdefault(path + "#", set()).add(fp)
    posts = {}
    for u, fps in of.items():
        for fp in fps:
            posts.setdefault(fp, []).append(u)
    want = []
    for a in of:
        for b in of:
            shared = sum(2 <= len(posts[fp]) <= 12 for fp in of[a] & of[b])
            if a < b and shared and shared / min(len(of[a]), len(of[b])) >= 0.3:
                want.append((a, b, shared, round(shared / min(len(of[a]), len(of[b])), 6)))
    got = recur.near_clones(recur.print_sets(tokens), least=0.3)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    # Pairs move as numbers.
    assert "hashpartitioning(x" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_tensions_measure_files_once(spark):
    plan = QUERIES["tensions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # Measures of files and of lines, sites and the hashes that recur among them, debts.
    assert plan.count("Relation [doc_id") == 5
