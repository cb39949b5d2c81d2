"""What a repository keeps beside its sources: budgets, pins, the ledger and the history.

Budgets and pins are TOML, a few rows by their nature: a file is read whole on the driver. The
ledger and the history are JSON lines, read and written as DataFrames.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry

CONFIG = "srcprism.toml"
BANDS = "scope string, lang string, metric string, lo double, hi double"
LEDGER = "metric string, path string, unit string, value double"
RUN = "commit string, branch string, files long, lines long, units long, gates long, suspicions long, duplicated double, gated map<string,bigint>"


def _bounds(where: str, table: dict) -> list[tuple[str, float | None, float | None]]:
    known = {m for m, *_ in registry.rows()}
    rows = []
    for metric, band in table.items():
        if metric not in known:
            raise ValueError(f"{where}: unknown metric {metric!r}")
        rows.append((metric, *(float(band[k]) if k in band else None for k in ("lo", "hi"))))
    return rows


def calibration(spark: SparkSession, text: str) -> DataFrame:
    """Pins (scope '', lang, metric, lo, hi) of a TOML text with one table a language."""
    rows = [("", lang, *b) for lang, table in tomllib.loads(text).items() for b in _bounds(lang, table)]
    return spark.createDataFrame(rows, BANDS)


def calibration_text(pins: DataFrame) -> str:
    """The TOML text of pins (lang, metric, lo, hi): at most a row for each language and metric."""
    out, last = [], None
    for r in pins.select("lang", "metric", "lo", "hi").orderBy("lang", "metric").collect():
        if r["lang"] != last:
            out.append(f"{'' if last is None else chr(10)}[{r['lang']}]")
            last = r["lang"]
        band = ", ".join(f"{k} = {r[k]!r}" for k in ("lo", "hi") if r[k] is not None)
        out.append(f'"{r["metric"]}" = {{ {band} }}')
    return "\n".join(out) + "\n"


def configured(spark: SparkSession, root: str) -> DataFrame:
    """Overrides (scope, lang null, metric, lo, hi) of every configuration file under ``root``.

    The scope is the file's directory below the root, empty for the root's own. A malformed file
    or an unknown metric is an error that names the file.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", CONFIG).text(root, wholetext=True)
    rows = []
    for path, text in found.select(F.col("_metadata.file_path"), "value").collect():
        try:
            table = tomllib.loads(text).get("budgets", {})
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{path}: {e}") from e
        folder = path.rsplit("/", 1)[0].split(root.rstrip("/"), 1)[-1].strip("/")
        rows += [(folder, None, *b) for b in _bounds(path, table)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0], r[2])), BANDS)


def layered(defaults: DataFrame, pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """Bands in force: defaults by metric, pins of a language over them, overrides over both.

    A stated bound replaces what lies below it, an unstated one keeps it; a directory's override
    lies over the root's. All four tables are configuration.
    """
    langs = pins.select("lang").distinct().unionByName(pins.sparkSession.createDataFrame([(None,)], "lang string"))
    base = F.broadcast(langs).join(defaults.select("metric", "lo", "hi"))
    own = pins.select("metric", F.col("lang").alias("l"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    base = base.join(own, (base.metric == own.metric) & (base.lang == own.l), "left").select("lang", base.metric, F.coalesce("plo", "lo").alias("lo"), F.coalesce("phi", "hi").alias("hi"))
    at = lambda scope: overrides.where(scope).select("scope", "metric", F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    over = lambda b, o: b.join(o, "metric", "left").select("lang", "metric", F.coalesce("olo", "lo").alias("lo"), F.coalesce("ohi", "hi").alias("hi"))
    root = over(base, at("scope = ''").drop("scope"))
    nested = root.join(at("scope <> ''"), "metric").select("scope", "lang", "metric", F.coalesce("olo", "lo").alias("lo"), F.coalesce("ohi", "hi").alias("hi"))
    return root.select(F.lit("").alias("scope"), "lang", "metric", "lo", "hi").unionByName(nested)


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.select("metric", "path", "unit", "value").write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def record(run: DataFrame, path: str) -> None:
    """Append one run to the history; no run that is there is rewritten."""
    run.write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The readable runs, and the lines that are none: a corrupt line spoils no other."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    read = lines.withColumn("run", F.from_json("value", f"{RUN}, broken string", {"columnNameOfCorruptRecord": "broken"}))
    sound = F.col("run.broken").isNull() & F.col("run.gates").isNotNull()
    return read.where(sound).select("run.*").drop("broken"), read.where(~sound).select("value")


