"""Gates and set operations: baselines, diffs, interface breaks, environments, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def baseline(broke: DataFrame, metrics: DataFrame, most: int = 2) -> DataFrame:
    """The ledger: the worst value per metric, path and unit of rungs up to ``most``."""
    kept = broke.join(metrics.where(F.col("rung") <= most).select("metric"), "metric")
    below = F.col("lo").isNotNull() & F.col("hi").isNull()
    return kept.groupBy("metric", "path", "unit").agg(F.when(F.max(below), F.min("value")).otherwise(F.max("value")).alias("value"))


def ratchet(current: DataFrame, ledger: DataFrame, scanned: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fresh violations: unseen, or worse than the ledger's value.

    A ceiling grows worse upwards and a floor downwards; a band with both bounds, or a metric
    that ``metrics`` (metric, lo, hi) does not know, never does. A row unseen at its path is
    compared with the most permissive value of its unit among paths that are gone from the scan:
    a moved file brings its debt along. A value that the ledger leaves null tolerates any.
    """
    way = F.when(F.col("lo").isNull() & F.col("hi").isNotNull(), 1).when(F.col("lo").isNotNull() & F.col("hi").isNull(), -1).otherwise(0)
    ways = metrics.select("metric", way.alias("way"))
    old = ledger.select("metric", "path", "unit", F.col("value").alias("was"), F.lit(True).alias("known"))
    gone = ledger.join(scanned.select("path").distinct(), "path", "left_anti").join(ways, "metric", "left")
    any_null = F.max(F.col("value").isNull())
    least = F.min(F.when(F.col("way") == -1, F.col("value")))
    moved = gone.groupBy("metric", "unit").agg(F.when(~any_null, F.coalesce(least, F.max("value"))).alias("moved"), F.lit(True).alias("came"))
    seen = current.join(old, ["metric", "path", "unit"], "left").join(moved, ["metric", "unit"], "left").join(ways, "metric", "left")
    limit = F.when(F.col("known"), F.col("was")).otherwise(F.col("moved"))
    worse = F.when(F.col("way") == 1, F.col("value") > limit).when(F.col("way") == -1, F.col("value") < limit).otherwise(F.lit(False))
    why = F.when(F.col("known").isNull() & F.col("came").isNull(), "new").when(worse, "worse")
    return seen.withColumn("why", why).where("why is not null").select("metric", "path", "unit", "value", limit.alias("was"), "why")


def changed_units(units: DataFrame, hunks: DataFrame) -> DataFrame:
    """Units whose lines meet a changed range: an equality on path, then the overlap."""
    h = hunks.select("path", "first", "last")
    return units.join(h, "path").where("line <= last and end_line >= first").select(units.path, "unit", "line", "end_line").distinct()


def api_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """The first way in which a public unit narrowed: (qualname, broke, detail).

    Both sides have (qualname, params, types, optional, returns): three arrays of one length, a
    type empty where it is not stated. Required additions and dropped parameters count first;
    then the shared parameters are walked position by position, at each its type, its name and
    whether it became required; the type returned comes last. What only widens is no break.
    """
    names = ("params", "types", "optional", "returns")
    b = before.select("qualname", *[F.col(c).alias(f"b_{c}") for c in names])
    a = after.select("qualname", *[F.col(c).alias(f"a_{c}") for c in names], F.lit(True).alias("there"))
    was, now = F.size("b_params"), F.size("a_params")
    required = F.transform(F.filter(F.transform("a_params", lambda p, i: F.struct(p.alias("p"), (~F.get("a_optional", i) & (i >= was)).alias("new"))), lambda x: x["new"]), lambda x: x["p"])
    dropped = F.slice("b_params", now + 1, F.greatest(was - now, F.lit(0)))

    def position(i):
        bt, at, bn, an = F.get("b_types", i), F.get("a_types", i), F.get("b_params", i), F.get("a_params", i)
        say = lambda kind, *detail: F.struct(F.lit(kind).alias("broke"), F.concat(*detail).alias("detail"))
        return (
            F.when((bt != at) & (bt != "") & (at != ""), say("type", bn, F.lit(": "), bt, F.lit(" -> "), at))
            .when(bn != an, say("renamed", bn, F.lit(" -> "), an))
            .when(F.get("b_optional", i) & ~F.get("a_optional", i), say("became required", an))
        )

    shared = F.when(F.least(was, now) > 0, F.get(F.filter(F.transform(F.sequence(F.lit(0), F.least(was, now) - 1), position), lambda x: x.isNotNull()), F.lit(0)))
    say = lambda kind, detail: F.struct(F.lit(kind).alias("broke"), detail.alias("detail"))
    broke = F.coalesce(
        F.when(F.col("there").isNull(), say("removed", F.lit(""))),
        F.when((now > was) & (F.size(required) > 0), say("gained required", F.array_join(required, ", "))),
        F.when(now < was, say("dropped", F.array_join(dropped, ", "))),
        shared,
        F.when((F.col("b_returns") != F.col("a_returns")) & (F.col("b_returns") != ""), say("returns", F.concat("b_returns", F.lit(" -> "), "a_returns"))),
    )
    return b.join(a, "qualname", "left").withColumn("x", broke).where("x is not null").select("qualname", "x.broke", "x.detail")


def drift(keys: DataFrame) -> DataFrame:
    """Keys set in some environments but not in all, from (resource, key, env)."""
    every = keys.agg(F.countDistinct("env").alias("envs"))  # one row
    per = keys.groupBy("resource", "key").agg(F.countDistinct("env").alias("n"), F.array_join(F.array_sort(F.collect_set("env")), ",").alias("found_in"))
    return per.crossJoin(F.broadcast(every)).where("n < envs").select("resource", "key", "n", "found_in")


def everywhere(keys: DataFrame) -> DataFrame:
    every = keys.agg(F.countDistinct("env").alias("envs"))
    per = keys.groupBy("resource", "key").agg(F.countDistinct("env").alias("n"))
    return per.crossJoin(F.broadcast(every)).where("n = envs").select("resource", "key")


def untested(broke: DataFrame, test_refs: DataFrame) -> DataFrame:
    """Over-budget units whose bare name no test refers to."""
    named = broke.withColumn("name", T.own_name(F.col("unit")))
    return named.join(test_refs.select("name").distinct(), "name", "left_anti").select("path", "unit", "metric", "value")


def tensions(facts: dict[str, DataFrame], least: int = 3) -> DataFrame:
    """Paths at which several kinds of trouble meet; ``facts`` names a table of paths each, or one
    whose own column ``fact`` names them."""
    rows = None
    for name, df in sorted(facts.items()):
        part = df.select("path", F.col("fact") if "fact" in df.columns else F.lit(name).alias("fact")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    met = rows.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("fact")), ",").alias("facts"))
    return met.where(F.col("n") >= least)


def dependency_totals(files: DataFrame) -> DataFrame:
    """Per package under a dependency folder: files, lines, secrets and suppressions."""
    rows = files.withColumn("package", T.package_of(F.col("path"))).where("package <> ''")
    return rows.groupBy("package").agg(F.count("*").alias("files"), *[F.sum(c).cast("long").alias(c) for c in ("lines", "secrets", "suppressions")])


def straddles(own: DataFrame, deps: DataFrame, least: int = 48) -> DataFrame:
    """Own code that a dependency holds too: sites equal by hash, large enough."""
    first = deps.groupBy("hash").agg(F.min(F.struct("path", "line")).alias("d"))
    hit = own.where(F.col("mass") >= least).join(first, "hash")
    best = hit.groupBy("path", "line").agg(F.max(F.struct("mass", "d")).alias("b"))
    return best.select("path", "line", "b.mass", F.col("b.d.path").alias("dep_path"), F.col("b.d.line").alias("dep_line"))
