"""Report sinks: JSON, SARIF, a TSV dump of facts, the context of a language, explanations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A

SCHEMA_VERSION = 2
LEVELS = {0: "error", 1: "error", 2: "error", 3: "warning", 4: "warning", 5: "note"}


def findings(broke: DataFrame, metrics: DataFrame) -> DataFrame:
    """Violations as JSON lines, distributed: one object per row."""
    rows = broke.join(metrics.select("metric", "rung"), "metric")
    return rows.select(F.to_json(F.struct("path", "line", "unit", "metric", "rung", "value", "lo", "hi", "severity")).alias("value"))


def summary(banded: DataFrame, files: DataFrame, metrics: DataFrame) -> dict:
    """The report's head: a few rows per metric and language, whatever the corpus holds."""
    rates = [r.asDict() for r in A.measured_violated(banded).collect()]
    return {
        "schema": SCHEMA_VERSION,
        "headline": [r.asDict() for r in A.headline(files).collect()],
        "metrics": sorted(rates, key=lambda r: (r["metric"], r["lang"] or "")),
        "verdict": [r.asDict() for r in A.verdict(banded, metrics).collect()],
    }


def brief(banded: DataFrame, k: int = 5) -> DataFrame:
    """The metrics that are broken most often."""
    return A.measured_violated(banded).where("total = 1 and violated > 0").orderBy(F.desc("rate"), "metric").limit(k).drop("lang", "total")


def sarif_results(broke: DataFrame, metrics: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 result per violation, as JSON lines."""
    level = F.element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.col("rung"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    text = F.concat(F.col("metric"), F.lit(" is "), F.format_string("%.2f", "value"), F.lit(", budget "), T.band_label(F.col("lo"), F.col("hi")))
    rows = broke.join(metrics.select("metric", "rung"), "metric")
    return rows.select(F.to_json(F.struct(F.regexp_replace("metric", " ", "-").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif(broke: DataFrame, metrics: DataFrame, most: int = 5000) -> str:
    """A whole SARIF log for a viewer, which itself takes at most ``most`` results: a top list.

    The log says how many results there are and how many it leaves out.
    """
    rules = [{"id": r["metric"].replace(" ", "-"), "defaultConfiguration": {"level": LEVELS[r["rung"]]}} for r in metrics.orderBy("rung", "metric").collect()]
    results = [json.loads(r[0]) for r in sarif_results(broke.orderBy("path", "line", "metric").limit(most), metrics).collect()]
    every = broke.count()
    told = {"results": every, "omitted": every - len(results)}
    run = {"tool": {"driver": {"name": "srcprism", "rules": rules}}, "results": results, "properties": told}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})


def context(banded: DataFrame, metrics: list[str]) -> DataFrame:
    """Median, 90th percentile and budget of chosen metrics per language."""
    found = A.nearest_rank(banded.where(F.col("metric").isin(metrics)), ["lang", "metric"], "value", {"p50": 0.5, "p90": 0.9})
    bounds = banded.groupBy("lang", "metric").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    return found.join(bounds, ["lang", "metric"]).select("lang", "metric", "n", "p50", "p90", T.band_label(F.col("lo"), F.col("hi")).alias("budget"))


def facts_tsv(facts: DataFrame) -> DataFrame:
    """Facts as rows (row, path, at, name, value); what is 0 or empty is left out."""
    names = ["lines", "blank_lines", "comment_lines", "parse_errors", "mass"]
    files = F.transform(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]), lambda x: F.struct(F.lit("file").alias("row"), F.lit(0).alias("at"), x["name"].alias("name"), x["value"].cast("string").alias("value")))
    found = F.transform("findings", lambda x: F.struct(F.lit("ffact").alias("row"), x["line"].alias("at"), x["kind"].alias("name"), F.lit("1").alias("value")))
    units = F.transform("units", lambda u: F.struct(F.lit("unit").alias("row"), u["line"].alias("at"), u["qualname"].alias("name"), u["lines"].cast("string").alias("value")))
    calls = F.flatten(F.transform("units", lambda u: F.transform(u["calls"], lambda c: F.struct(F.lit("call").alias("row"), u["line"].alias("at"), u["qualname"].alias("name"), c.alias("value")))))
    rows = facts.select("path", F.explode(F.concat(files, found, units, calls)).alias("r")).select("path", "r.*")
    return rows.where("value <> '0' and value <> ''").select("row", "path", "at", "name", "value")


def explain(banded: DataFrame, path: str, line: int | None = None) -> DataFrame:
    """Every measurement of one file, or of one line of it, beside its budget."""
    rows = banded.where(F.col("path") == path)
    rows = rows if line is None else rows.where(F.col("line") == line)
    return rows.select("line", "unit", "metric", "value", T.band_label(F.col("lo"), F.col("hi")).alias("budget"), A.violated(rows).alias("broke")).orderBy("line", "unit", "metric")
