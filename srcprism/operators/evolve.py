"""What the history says: churn, co-change, authorship, debt age, recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

DAY, HALF_LIFE = 86_400.0, 180.0


def churn(commits: DataFrame) -> DataFrame:
    """Half-life-decayed churn per file from (at: unix seconds, author, file)."""
    newest = commits.agg(F.max("at").alias("newest"))  # one row
    aged = commits.crossJoin(F.broadcast(newest)).withColumn("age", (F.col("newest") - F.col("at")) / F.lit(DAY))
    weight = F.pow(F.lit(0.5), F.col("age") / F.lit(HALF_LIFE))
    return aged.groupBy("file").agg(F.round(F.sum(weight), 6).alias("churn"), F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def hotspots(commits: DataFrame, worst: DataFrame, k: int = 12) -> DataFrame:
    """Churn times the worst gate value of a file (file, metric, value); ties to the first metric."""
    top = worst.groupBy("file").agg(F.max("value").alias("value"), F.min_by("metric", F.struct(-F.col("value"), F.col("metric"))).alias("metric"))
    score = F.round(F.col("churn") * F.col("value"), 4)
    return churn(commits).join(top, "file").withColumn("score", score).orderBy(F.desc("score"), "file").limit(k)


def coupling(commits: DataFrame, most: int = 30, least: int = 3, strength: float = 0.6) -> DataFrame:
    """Pairs of files of different directories that change together.

    Commits of more than ``most`` files pair nothing (their files still count in the totals):
    that is the operator's meaning and bounds a commit's pairs.
    """
    rows = commits.select("sha", "file", "dir").distinct()
    totals = rows.groupBy("file").agg(F.count("*").alias("total"))
    narrow = rows.groupBy("sha").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("sha")
    few = rows.join(narrow, "sha")
    a = few.select("sha", F.col("file").alias("a"), F.col("dir").alias("da"))
    b = few.select("sha", F.col("file").alias("b"), F.col("dir").alias("db"))
    pairs = a.join(b, "sha").where("a < b and da <> db").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    ta, tb = totals.select(F.col("file").alias("a"), F.col("total").alias("ta")), totals.select(F.col("file").alias("b"), F.col("total").alias("tb"))
    share = F.col("shared") / F.least("ta", "tb")
    return pairs.join(ta, "a").join(tb, "b").where(share >= strength).select("a", "b", "shared", F.round(share, 6).alias("strength"))


def sole_authors(commits: DataFrame, least: int = 5) -> DataFrame:
    """Files with enough entries, all by one author."""
    per = commits.groupBy("file").agg(F.count("*").alias("commits"), F.countDistinct("author").alias("n"), F.min("author").alias("author"))
    return per.where((F.col("commits") >= least) & (F.col("n") == 1)).select("file", "author", "commits")


def debt_age(debts: DataFrame, blame: DataFrame, now: int) -> DataFrame:
    """Age in days of each debt marker (path, line) by the time its line was written."""
    days = F.floor((F.lit(now) - F.col("at")) / F.lit(DAY)).cast("long")
    return debts.join(blame, ["path", "line"]).select("path", "line", days.alias("days"))


def median_age(ages: DataFrame) -> DataFrame:
    """The element at half the count of the sorted ages."""
    counts = ages.groupBy("days").agg(F.count("*").alias("n"))
    upto = Window.orderBy("days").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per distinct age in days: a few thousand at most.
    ranked = counts.withColumn("to", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(total))
    return ranked.where("to > floor(all / 2)").agg(F.min("days").alias("median"), F.max("all").alias("n"))


def history_delta(runs: DataFrame, values: list[str]) -> DataFrame:
    """Each recorded run beside the change since the one before."""
    order = Window.orderBy("day")  # one row per recorded run
    return runs.select("day", *values, *[(F.col(v) - F.lag(v).over(order)).alias(f"d_{v}") for v in values])


def junk_drawers(files: DataFrame) -> DataFrame:
    names = "common|helper|helpers|misc|stuff|util|utils"
    return files.where(F.lower(T.stem(F.col("path"))).rlike(f"^({names})$"))
