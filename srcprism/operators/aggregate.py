"""Exact aggregations over measurements: counts, quantiles, tallies and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact nearest-rank quantiles per group: the value at round((n - 1) q) of the sorted ones.

    Equal values are counted first, so a group is ranked by its distinct values: a hot group
    moves one row per distinct value, not one per measurement.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__to", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    # The first value whose running count passes the rank.
    picks = [
        F.min(F.when(F.col("__to") > F.round((F.col("__all") - 1) * F.lit(q)), F.col(value))).alias(name)
        for name, q in quantiles.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("__all").alias("n"), *picks)


def headline(files: DataFrame) -> DataFrame:
    """Files, lines and blank files per language, and in all (total = 1; a null lang is its own)."""
    return files.rollup("lang").agg(F.grouping("lang").cast("int").alias("total"), F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"), F.count_if(F.col("lines") == 0).alias("empty"))


def violated(measured: DataFrame) -> Column:
    return T.violates(F.col("value"), F.col("lo"), F.col("hi"))


def measured_violated(banded: DataFrame) -> DataFrame:
    """Measured and violated per metric and language, and per metric (total = 1; a null lang is its own)."""
    return (
        banded.rollup("metric", "lang")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("measured"), F.count_if(violated(banded)).alias("violated"))
        .where("g < 2")
        .withColumn("total", F.col("g").cast("int"))
        .drop("g")
        .withColumn("rate", F.round(F.col("violated") / F.col("measured"), 6))
    )


def percentile_position(measured: DataFrame, least: int = 200) -> DataFrame:
    """Share of a language's measurements below each distinct value, truncated per cent."""
    counts = measured.groupBy("lang", "metric", "value").agg(F.count("*").alias("here"))
    group = Window.partitionBy("lang", "metric")
    below = group.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum("here").over(below), F.lit(0))).withColumn("n", F.sum("here").over(group))
    share = F.when(F.col("n") >= least, F.floor(100 * F.col("below") / F.col("n")))
    return ranked.select("lang", "metric", "value", "here", share.cast("long").alias("percentile"))


def coverage(measured: DataFrame, metrics: list[str]) -> DataFrame:
    """How many of the measured units have any, per language."""
    return (
        measured.where(F.col("metric").isin(metrics))
        .groupBy("lang", "metric")
        .agg(F.count_if(F.col("value") > 0).alias("having"), F.count("*").alias("of"))
        .withColumn("rate", F.round(F.col("having") / F.col("of"), 6))
    )


def role_tally(comments: DataFrame) -> DataFrame:
    """Runs, words and sentences per language and role of comment, and words per run."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("words", "sentences")]
    return (
        comments.groupBy("lang", "role")
        .agg(F.count("*").alias("runs"), *sums)
        .withColumn("per_run", F.round(F.col("words") / F.col("runs"), 6))
    )


CASES = ["snake", "camel", "pascal", "screaming"]


def spelling(units: DataFrame) -> DataFrame:
    """Counts per spelling, the dominant one (ties to the first) and the entropy share."""
    cases = units.withColumn("case", T.case_of(F.col("name"))).where("case <> 'neutral'")
    wide = cases.groupBy("lang").agg(*[F.count_if(F.col("case") == c).alias(c) for c in CASES])
    counts = F.array(*[F.col(c).cast("double") for c in CASES])
    top = F.element_at(F.array(*map(F.lit, CASES)), F.array_position(counts, F.array_max(counts)).cast("int"))
    return wide.withColumn("dominant", top).withColumn("entropy", F.round(T.entropy_share(counts), 6))


def verdict(banded: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals of gates (rung 0 to 2) and suspicions (3 and 4), and the three main drivers."""
    seen = banded.where(violated(banded)).join(metrics.select("metric", "rung"), "metric").where("rung <= 4")
    kind = F.when(F.col("rung") <= 2, "gate").otherwise("suspicion")
    per = seen.groupBy(kind.alias("class"), "metric").agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy(F.desc("n"), "metric")
    ranked = per.withColumn("r", F.row_number().over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("class")))
    drivers = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "metric", "n"))), lambda x: F.concat_ws("=", x["metric"], x["n"])), ",")
    return ranked.where("r <= 3").groupBy("class").agg(F.max("total").alias("total"), drivers.alias("drivers"))


def narrative(units: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls that step down to a later definition, and up to an earlier one, per language."""
    first = units.groupBy("path", F.col("name").alias("callee")).agg(F.min("unit_idx").alias("at"))
    seen = calls.join(first, ["path", "callee"])
    return seen.groupBy("lang").agg(F.count_if(F.col("at") > F.col("unit_idx")).alias("down"), F.count_if(F.col("at") < F.col("unit_idx")).alias("up"))


def public_first(units: DataFrame) -> DataFrame:
    """Of a file's pairs that differ in visibility, those in which the public unit is first.

    Each private unit forms such a pair with every public one; those before it are counted by
    a running sum, so no pair is ever made.
    """
    before = Window.partitionBy("path").orderBy("unit_idx").rowsBetween(Window.unboundedPreceding, -1)
    public = F.col("is_public").cast("int")
    seen = units.withColumn("ahead", F.coalesce(F.sum(public).over(before), F.lit(0)))
    return (
        seen.groupBy("lang", "path")
        .agg(F.sum(F.when(~F.col("is_public"), F.col("ahead")).otherwise(0)).alias("first"), (F.sum(public) * F.sum(1 - public)).alias("pairs"))
        .groupBy("lang").agg(F.sum("first").cast("long").alias("first"), F.sum("pairs").cast("long").alias("pairs"))
    )


def pins(measured: DataFrame, metrics: DataFrame, least: int = 200) -> DataFrame:
    """Calibrated budgets per language: ceilings at the 99th percentile, bands at 5 and 95."""
    found = nearest_rank(measured, ["lang", "metric"], "value", {"q05": 0.05, "q95": 0.95, "q99": 0.99})
    kept = found.where(F.col("n") >= least).join(metrics.select("metric", "calib"), "metric").where("calib <> 'policy'")
    band = F.col("calib") == "band"
    return (
        kept.select(
            "lang", "metric", "n",
            F.when(band, F.round("q05", 2)).alias("lo"),
            F.when(band, F.round("q95", 2)).otherwise(F.ceil("q99").cast("double")).alias("hi"),
        )
        .where("lo is not null or hi > 0")
    )


def policy_audit(banded: DataFrame, metrics: DataFrame) -> DataFrame:
    """Policy metrics that the corpus itself breaks more often than their rung allows."""
    rates = measured_violated(banded).where("total = 1").select("metric", "measured", "violated", "rate")
    seen = rates.join(metrics.where("calib = 'policy'").select("metric", "rung"), "metric")
    return seen.where(F.col("rate") > F.when(F.col("rung") <= 2, 0.01).otherwise(0.05))


def dir_rollup(banded: DataFrame, metrics: DataFrame, least: int = 3) -> DataFrame:
    """Per directory with enough files: gates, suspicions, density and the gate that drives it."""
    rows = banded.join(metrics.select("metric", "rung"), "metric").withColumn("dir", T.dir_of(F.col("path")))
    files = rows.select("dir", "path").distinct().groupBy("dir").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    broke = rows.where(violated(rows))
    counts = broke.groupBy("dir").agg(F.count_if(F.col("rung") <= 2).alias("gates"), F.count_if(F.col("rung").between(3, 4)).alias("suspicions"))
    per = broke.where("rung <= 2").groupBy("dir", "metric").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dir").orderBy(F.desc("n"), "metric")
    driver = per.withColumn("r", F.row_number().over(order)).where("r = 1").select("dir", F.col("metric").alias("driver"))
    out = files.join(counts, "dir", "left").join(driver, "dir", "left").na.fill(0, ["gates", "suspicions"])
    return out.select("dir", "files", "gates", "suspicions", F.round(F.col("gates") / F.col("files"), 6).alias("density"), F.coalesce("driver", F.lit("")).alias("driver"))
