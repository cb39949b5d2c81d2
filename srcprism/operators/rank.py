"""Rankings with total orders: offenders, neighbourhoods, bodies, policy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .aggregate import violated


def violations(banded: DataFrame) -> DataFrame:
    return banded.where(violated(banded)).withColumn("severity", T.severity(F.col("value"), F.col("lo"), F.col("hi")))


def worst_per_metric(broke: DataFrame, k: int = 10) -> DataFrame:
    """The k worst of each metric: value, then path, line and unit decide."""
    order = Window.partitionBy("metric").orderBy(F.desc("value"), "path", "line", "unit")
    return broke.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def neighbourhood(banded: DataFrame) -> DataFrame:
    """What a violation's file does elsewhere: peers, how many broke it, the largest clean
    value, and the clean peer with the same job word that does at least half the budget."""
    rows = banded.withColumn("broke", violated(banded)).withColumn("job", T.job_word(F.col("unit")))
    counts = rows.groupBy("path", "metric").agg(
        F.count("*").alias("n"),
        F.count_if("broke").alias("over"),
        F.coalesce(F.max(F.when(~F.col("broke"), F.col("value"))), F.lit(0.0)).alias("clean"),
    ).where("over > 0")
    able = rows.where(~F.col("broke") & F.col("job").isNotNull() & (F.col("hi").isNull() | (F.col("value") >= F.col("hi") / 2)))
    # Strictly larger wins, then the first line.
    kin = able.groupBy("path", "metric", "job").agg(F.max(F.struct("value", (-F.col("line")).alias("o"), T.own_name(F.col("unit")).alias("name"))).alias("k"))
    seen = rows.where("broke").join(counts, ["path", "metric"]).join(kin, ["path", "metric", "job"], "left")
    return seen.select(
        "path", "metric", "line", "unit", "value", (F.col("n") - 1).alias("peers"), (F.col("over") - 1).alias("also_over"), "clean",
        F.coalesce("k.name", F.lit("")).alias("kin"), F.col("k.value").alias("kin_value"),
    )


def bodies(broke: DataFrame, k: int = 5) -> DataFrame:
    """Violations grouped by body, the worst first; one per file, then one per claim.

    A claim is the sorted list of (metric, value): bodies that break the same budgets by the
    same values say the same thing once; ``alike`` counts the others.
    """
    ranked = broke.where("severity is not null")
    claim = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("metric", "value"))), lambda x: F.concat_ws("=", x["metric"], F.format_string("%.4f", x["value"]))), ";")
    body = ranked.groupBy("path", "line", "unit").agg(F.max("severity").alias("worst"), F.count("*").alias("findings"), claim.alias("claim"))
    alike = body.groupBy("claim").agg((F.count("*") - 1).alias("alike"))
    order = [F.desc("worst"), F.desc("findings"), "path", "line", "unit"]
    first = body.withColumn("f", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("f = 1")
    once = first.withColumn("c", F.row_number().over(Window.partitionBy("claim").orderBy(*order))).where("c = 1")
    return once.drop("f", "c").orderBy(*order).limit(k).join(alike, "claim")


def policy_rows(broke: DataFrame) -> DataFrame:
    """Unrankable violations (the crossed bound is 0) per metric: count, files, the worst."""
    rows = broke.where("severity is null")
    worst = F.max(F.struct("value", F.col("path"))).alias("w")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), worst).select(
        "metric", "n", "files", F.when(F.col("w.value") > 1, F.col("w.value")).alias("worst")
    )


def cost_clause(broke: DataFrame, bearing: DataFrame, untested: DataFrame, least: int = 8) -> DataFrame:
    """Why a body's violation costs: the first of load-bearing, untested, repeated, alike."""
    per = broke.groupBy("path", "metric").agg(F.count("*").alias("times"))
    same = broke.groupBy("metric", "value").agg((F.count("*") - 1).alias("others"))
    seen = (
        broke.join(per, ["path", "metric"]).join(same, ["metric", "value"])
        .join(bearing.select("path", "blast"), "path", "left")
        .join(untested.select("unit", F.lit(True).alias("bare")).distinct(), "unit", "left")
    )
    clause = F.coalesce(
        F.when(F.col("blast") > 0, F.concat(F.lit("load-bearing for "), F.col("blast"))),
        F.when(F.col("bare"), F.lit("untested")),
        F.when(F.col("times") >= least, F.concat(F.lit("repeated "), F.col("times"))),
        F.when(F.col("others") > 0, F.concat(F.lit("alike "), F.col("others"))),
        F.lit(""),
    )
    return seen.select("path", "line", "unit", "metric", "value", clause.alias("cost"))
