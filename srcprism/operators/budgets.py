"""Budget bands: defaults, per-language pins, directory overrides, and the band join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(base: DataFrame, override: DataFrame) -> DataFrame:
    """A stated bound replaces the base's; an unstated one keeps it. Keys: lang, metric."""
    o = override.select("lang", "metric", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    return base.join(o, ["lang", "metric"], "left").select("lang", "metric", F.coalesce("__lo", "lo").alias("lo"), F.coalesce("__hi", "hi").alias("hi"))


def banded(measured: DataFrame, budgets: DataFrame) -> DataFrame:
    """Measurements with the band of the deepest directory that holds them.

    ``budgets`` (scope, lang, metric, lo, hi; lang null: any) is configuration: a row for each
    metric and scope, small by its nature. It is gathered into one list a metric, the deepest
    scope and the stated language first; each row takes the first entry that holds it, so the
    measurements are neither shuffled nor given ids.
    """
    rank = [(-F.length("scope")).alias("above"), F.col("lang").isNull().alias("any")]
    lists = budgets.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct(*rank, "scope", "lang", "lo", "hi"))).alias("__bands"))
    holds = lambda b: ((b["scope"] == "") | F.col("path").startswith(F.concat(b["scope"], F.lit("/")))) & (b["lang"].isNull() | (b["lang"] == F.col("lang")))
    placed = measured.join(F.broadcast(lists), "metric").withColumn("__b", F.get(F.filter("__bands", holds), F.lit(0)))
    return placed.where("__b is not null").select(*measured.columns, "__b.lo", "__b.hi")
