"""The module graph: resolution, reach, cycles, depth, surfaces, layers.

Reach and components are frontier iterations over DataFrames; a round reads what the last one
wrote, so lineage stays short. Graphs here have one node per module: far fewer rows than facts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import aggregate, durable


def resolve(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Each import as internal (with dst), external or unresolved.

    A target resolves to the module whose stem is its last component, the shortest path first;
    a relative target that finds none is unresolved, any other external.
    """
    best = modules.groupBy(T.stem(F.col("path")).alias("last")).agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("dst"))
    last = F.element_at(F.split("target", "[./]"), -1)
    found = imports.withColumn("last", last).join(best, "last", "left")
    kind = F.when(F.col("dst").isNotNull(), "internal").when(F.col("target").startswith("."), "unresolved").otherwise("external")
    return found.select("src", "ord", "target", "dst", kind.alias("kind"))


def resolve_rate(resolved: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("internal", "external", "unresolved")]
    known = F.col("internal") + F.col("unresolved")
    return resolved.agg(*counts).withColumn("rate", F.when(known > 0, F.round(F.col("internal") / known, 6)).otherwise(1.0))


def edges(resolved: DataFrame) -> DataFrame:
    return resolved.where("dst is not null and src <> dst").select("src", "dst").distinct()


def dir_edges(graph: DataFrame) -> DataFrame:
    """Edges between parent directories, without those between a directory and one above it."""
    d = graph.select(T.dir_of(F.col("src")).alias("src"), T.dir_of(F.col("dst")).alias("dst"))
    above = F.col("dst").startswith(F.concat("src", F.lit("/"))) | F.col("src").startswith(F.concat("dst", F.lit("/")))
    return d.where("src <> dst").where(~above).groupBy("src", "dst").agg(F.count("*").alias("n"))


#: Edges up to which one task orders a whole graph: about 200 bytes an edge in its memory.
ONE_TASK = 1_000_000


def _searched(edges: pd.DataFrame) -> tuple[np.ndarray, list[list[int]], list[int], list[int], list[list[int]]]:
    """Names, successors, component and depth of each node, and the components as they close:
    a component closes after all that it reaches."""
    names, codes = np.unique(np.concatenate([edges["src"], edges["dst"]]).astype(str), return_inverse=True)
    n = len(names)
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(codes[: len(edges)].tolist(), codes[len(edges) :].tolist(), strict=True):
        out[a].append(b)
    seen, low, group, depth, stack, count = [0] * n, [0] * n, [-1] * n, [0] * n, [], 0
    closed: list[list[int]] = []
    for root in range(n):
        work = [] if seen[root] else [(root, iter(out[root]))]
        if work:
            count += 1
            seen[root] = low[root] = count
            stack.append(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None:
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append(w)
                    work.append((w, iter(out[w])))
                elif group[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == seen[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                least = min(members)
                for m in members:
                    group[m] = least
                below = [depth[w] for m in members for w in out[m] if group[w] != least]
                for m in members:
                    depth[m] = 1 + max(below, default=0)
                closed.append(members)
    return names, out, group, depth, closed


def _ordered(edges: pd.DataFrame) -> pd.DataFrame:
    names, _, group, depth, _ = _searched(edges)
    return pd.DataFrame({"node": names, "scc": names[group] if len(names) else [], "depth": depth})


def _blasted(edges: pd.DataFrame, starts: pd.DataFrame, width: int = 1024) -> pd.DataFrame:
    """(node, blast): what the starts (outs, weight) of one block weigh that reach each node.

    Starts are carried down the components ``width`` at a time, a bit each; a mask for every
    binary digit of the weights sums them without visiting a start again.
    """
    names, out, group, _, closed = _searched(edges)
    code = {name: i for i, name in enumerate(names.tolist())}
    below = {group[c[0]]: {group[w] for m in c for w in out[m]} - {group[c[0]]} for c in closed}
    total = dict.fromkeys(below, 0)
    starts = starts.sort_values("weight")
    outs, weights = starts["outs"].tolist(), starts["weight"].tolist()
    for first in range(0, len(outs), width):
        bits: dict[int, int] = {}
        masks: dict[int, int] = {}
        for i in range(first, min(first + width, len(outs))):
            bit = 1 << (i - first)
            for name in outs[i]:
                g = group[code[name]]
                bits[g] = bits.get(g, 0) | bit
            for digit in range(weights[i].bit_length()):
                if weights[i] >> digit & 1:
                    masks[digit] = masks.get(digit, 0) | bit
        for c in reversed(closed):
            mine = bits.pop(group[c[0]], 0)
            if mine:
                total[group[c[0]]] += sum((mine & mask).bit_count() << digit for digit, mask in masks.items())
                for d in below[group[c[0]]]:
                    bits[d] = bits.get(d, 0) | mine
    return pd.DataFrame({"node": names, "blast": [total[g] for g in group]})


def ordered(graph: DataFrame) -> DataFrame:
    """(node, scc, depth) of a graph that one task can hold."""
    return graph.select(F.lit(1).alias("g"), "src", "dst").groupBy("g").applyInPandas(_ordered, "node string, scc string, depth int")


def _peeled(graph: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """A written graph without the edges of modules that nothing imports, and those edges, by round.

    Such modules are components of their own and lie on no way between others. Rounds end when
    ``most`` edges are left or a round takes less than a tenth of them.
    """
    layers: list[DataFrame] = []
    count = graph.count()
    while count > most:
        imported = graph.select(F.col("dst").alias("src")).distinct()
        inner = durable.cut(graph.join(imported, "src", "left_semi").select("src", "dst"))
        left = inner.count()
        if left == count:
            break
        layers.append(graph.join(imported, "src", "left_anti").select("src", "dst"))
        few, graph, count = 10 * (count - left) < count, inner, left
        if few:
            break
    return graph, layers


def components(graph: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """(node, scc): strongly connected components, named by their least node.

    Modules that nothing imports are peeled off while more than ``most`` edges are left; a core of
    up to ``most`` edges is searched by one task, a larger one coloured.
    """
    graph = durable.cut(graph)
    core, layers = _peeled(graph, most)
    if not layers:
        return _components(core, most)
    # Every module that is imported is in a row of the core or imports nothing there.
    inner = _components(core, most)
    nodes = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    return nodes.join(inner, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def _components(graph: DataFrame, most: int) -> DataFrame:
    """Components of a written graph: up to ``most`` edges one task searches it.

    Beyond, forward-backward colouring: the largest colour is spread along the edges; inside a colour,
    what reaches its root backwards is that root's component. Settled nodes leave the graph,
    and each round settles a component for every colour.
    """
    if graph.count() <= most:
        return ordered(graph).select("node", "scc")
    nodes = graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct()
    done, live, left = None, graph, durable.cut(nodes)
    while not left.isEmpty():
        # Nodes without a way in or out are components of their own.
        while True:
            inner = live.select(F.col("src").alias("node")).intersect(live.select(F.col("dst").alias("node")))
            alone = durable.cut(left.join(inner, "node", "left_anti"))
            if alone.isEmpty():
                break
            part = alone.select("node", F.col("node").alias("root"))
            done = part if done is None else done.union(part)
            left = durable.cut(left.join(alone, "node", "left_anti"))
            live = durable.cut(live.join(alone, live.src == alone.node, "left_anti").join(alone, live.dst == alone.node, "left_anti"))
        if left.isEmpty():
            break
        colour = durable.cut(left.select("node", F.col("node").alias("colour")))
        while True:
            sent = live.join(colour, live.src == colour.node).groupBy("dst").agg(F.max("colour").alias("got"))
            new = durable.cut(colour.join(sent, colour.node == sent.dst, "left").select("node", F.greatest("colour", F.coalesce("got", "colour")).alias("colour"), (F.coalesce("got", "colour") > F.col("colour")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            colour = new.select("node", "colour")
            if not moved:
                break
        inside = durable.cut(
            live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
            .where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        )
        reached = durable.cut(colour.where("node = colour"))
        front = reached
        while True:
            back = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = durable.cut(back.join(reached, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            reached = durable.cut(reached.union(front))
        part = reached.select("node", F.col("colour").alias("root"))
        done = part if done is None else done.union(part)
        left = durable.cut(left.join(reached.select("node"), "node", "left_anti"))
        gone = reached.select("node")
        live = durable.cut(live.join(gone, live.src == gone.node, "left_anti").join(gone, live.dst == gone.node, "left_anti"))
    if done is None:
        return nodes.select("node", F.col("node").alias("scc"))
    done = durable.cut(done)
    least = done.groupBy("root").agg(F.min("node").alias("scc"))
    return done.join(least, "root").select("node", "scc")


def cycle_mass(scc: DataFrame) -> DataFrame:
    sizes = scc.groupBy("scc").agg(F.count("*").alias("n"))
    share = F.round(100 * F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)) / F.sum("n"), 6)
    return sizes.agg(F.sum("n").cast("long").alias("modules"), F.count_if(F.col("n") > 1).alias("cycles"), F.max("n").alias("largest"), share.alias("mass"))


def condensation(graph: DataFrame, scc: DataFrame) -> DataFrame:
    s, d = scc.select(F.col("node").alias("src"), F.col("scc").alias("a")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("b"))
    return graph.join(s, "src").join(d, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def depths(graph: DataFrame, scc: DataFrame | None = None, most: int = ONE_TASK) -> DataFrame:
    """(node, depth): the longest chain of components below a module; a leaf's is 1.

    Modules that nothing imports are peeled off while more than ``most`` edges are left: the rest
    does not depend on them, and each is one above the deepest that it imports.
    """
    graph = durable.cut(graph)
    core, layers = _peeled(graph, most)
    if not layers:
        return _depths(core, scc, most)
    inner = _depths(core, scc, most)
    leaves = graph.select(F.col("dst").alias("node")).distinct().join(graph.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    # What imports nothing may have had all its edges peeled off.
    level = inner.union(leaves.join(inner.select("node"), "node", "left_anti").select("node", F.lit(1)))
    for layer in reversed(layers):
        level = durable.cut(level)
        level = level.union(layer.join(level, layer.dst == level.node).groupBy("src").agg((F.max("depth") + 1).alias("depth")))
    return level


def _depths(graph: DataFrame, scc: DataFrame | None, most: int) -> DataFrame:
    """Depths of a written graph: up to ``most`` edges the search that finds the components tells.

    Beyond, level by level: a component's depth settles in as many rounds as the chain is long.
    """
    if graph.count() <= most:
        return ordered(graph).select("node", "depth")
    scc = durable.cut(_components(graph, most)) if scc is None else scc.join(graph.select(F.col("src").alias("node")).union(graph.select("dst")).distinct(), "node", "left_semi")
    dag = durable.cut(condensation(graph, scc))
    level = durable.cut(scc.select(F.col("scc").alias("c")).distinct().withColumn("depth", F.lit(1)))
    while True:
        below = dag.join(level, dag.dst == level.c).groupBy("src").agg((F.max("depth") + 1).alias("d"))
        new = durable.cut(level.join(below, level.c == below.src, "left").select("c", F.greatest("depth", F.coalesce("d", "depth")).alias("depth"), (F.coalesce("d", "depth") > F.col("depth")).alias("moved")))
        level = new.select("c", "depth")
        if new.where("moved").isEmpty():
            break
    return scc.join(level, scc.scc == level.c).select("node", "depth")


def depth_quantiles(levels: DataFrame) -> DataFrame:
    rows = levels.select(F.lit("all").alias("g"), F.col("depth").cast("double").alias("v"))
    return aggregate.nearest_rank(rows, ["g"], "v", {"p50": 0.5, "p90": 0.9, "deepest": 1.0}).select("n", "p50", "p90", "deepest")


def reach(graph: DataFrame) -> DataFrame:
    """(node, by): every module from which ``node`` is reached, itself left out.

    Paths double in length each round, so there are as many rounds as the logarithm of the
    longest shortest path; the result is the closure, as large as the answer to be summed.
    """
    every = durable.cut(graph.select(F.col("dst").alias("node"), F.col("src").alias("by")).distinct())
    count = every.count()
    while True:
        more = every.join(every.select(F.col("node").alias("by"), F.col("by").alias("via")), "by").select("node", F.col("via").alias("by"))
        every = durable.cut(every.union(more).distinct())
        before, count = count, every.count()
        if count == before:
            return every.where("node <> by")


#: Starts that one task carries through the core of a graph.
BLOCK = 16_384


def blast_radius(modules: DataFrame, graph: DataFrame, most: int = ONE_TASK, block: int = BLOCK) -> DataFrame:
    """Modules that a change to each one can reach, itself left out.

    What nothing imports has no blast and needs no place in the graph: such modules are counted by
    the set of modules they import. If the core, the edges between modules that are imported, has
    up to ``most`` edges, these sets and the core's own modules are dealt in blocks, and each task
    carries a block down the core. Beyond, the closure is built and counted.
    """
    graph = durable.cut(graph)
    imported = graph.select(F.col("dst").alias("src")).distinct()
    core = durable.cut(graph.join(imported, "src", "left_semi").select("src", "dst"))
    if core.count() <= most:
        sets = graph.join(imported, "src", "left_anti").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("outs"))
        starts = sets.groupBy("outs").agg(F.count("*").alias("weight")).union(imported.select(F.array("src"), F.lit(1).cast("long")))
        starts = durable.cut(starts)
        blocks = -(-starts.count() // block)
        dealt = starts.select("outs", "weight", F.pmod(F.xxhash64("outs"), F.lit(blocks)).alias("g")).groupBy("g")
        # A module of the core that imports none of its modules is in no edge of it: an edge to itself keeps it.
        whole = core.union(imported.select("src", F.col("src").alias("dst"))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
        carried = dealt.cogroup(whole.groupBy("g")).applyInPandas(lambda s, e: _blasted(e, s), "node string, blast long")
        # A module is among the starts that reach it.
        counts = carried.groupBy("node").agg((F.sum("blast") - 1).alias("blast"))
    else:
        counts = reach(graph).groupBy("node").agg(F.count("*").alias("blast"))
    return modules.select("path").join(counts, modules.path == counts.node, "left").select("path", F.coalesce("blast", F.lit(0)).cast("long").alias("blast"))


def load_bearing(blast: DataFrame, k: int = 5) -> DataFrame:
    return blast.where("blast > 0").orderBy(F.desc("blast"), "path").limit(k)


ENTRY = "__init__|__main__|app|build|cli|index|init|lib|main|mix|package"


def orphans(modules: DataFrame, graph: DataFrame) -> DataFrame:
    """Modules that nothing imports and that no entry-point name explains."""
    judged = modules.where(~F.lower(T.stem(F.col("path"))).rlike(f"^({ENTRY})$"))
    return judged.join(graph.select(F.col("dst").alias("path")).distinct(), "path", "left_anti").select("path")


def deletable(modules: DataFrame, blast: DataFrame) -> DataFrame:
    judged = modules.where(~F.lower(T.stem(F.col("path"))).rlike(f"^({ENTRY})$")).select("path").join(blast, "path")
    return judged.agg(F.count("*").alias("judged"), F.count_if(F.col("blast") == 0).alias("free")).withColumn("share", F.round(100 * F.col("free") / F.col("judged"), 6))


def dead_exports(exports: DataFrame, mentions: DataFrame) -> DataFrame:
    """Exported names that at most one file mentions."""
    files = mentions.groupBy("name").agg(F.countDistinct("path").alias("files"))
    return exports.join(files, "name", "left").where(F.coalesce("files", F.lit(0)) <= 1).select("path", "name")


def fat_surfaces(exports: DataFrame, used: DataFrame) -> DataFrame:
    """Exports and how many of them some import names."""
    hits = exports.join(used.select("path", "name").distinct(), ["path", "name"], "left_semi").groupBy("path").agg(F.count("*").alias("hits"))
    width = exports.groupBy("path").agg(F.count("*").alias("exports"))
    return width.join(hits, "path", "left").select("path", "exports", F.coalesce("hits", F.lit(0)).alias("hits"))


def interface_depth(surfaces: DataFrame) -> DataFrame:
    """Mass over surface cost per module (path, mass, cost)."""
    return surfaces.where("cost > 0").select("path", F.round(F.col("mass") / F.col("cost"), 6).alias("depth"))


def layer_breaches(graph: DataFrame, layers: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Imports from one layer into one that it must not use.

    A module is in the layer whose text its path contains, the longest first, then by name.
    ``layers`` and ``forbidden`` are configuration: a few rows.
    """
    small = F.broadcast(layers)

    def layer(column: str, name: str) -> DataFrame:
        nodes = graph.select(column).distinct()
        hit = nodes.join(small, F.col(column).contains(F.col("holds")))
        order = Window.partitionBy(column).orderBy(F.desc(F.length("holds")), "layer")
        return hit.withColumn("r", F.row_number().over(order)).where("r = 1").select(column, F.col("layer").alias(name))

    placed = graph.join(layer("src", "from_layer"), "src").join(layer("dst", "to_layer"), "dst")
    return placed.join(F.broadcast(forbidden), ["from_layer", "to_layer"]).select("src", "dst", "from_layer", "to_layer")
