"""Views of the driver tables as fact tables: each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budgets as B
from ..operators import durable
from ..operators import graph as G
from ..operators import rank as R
from ..operators import registry

WORDS = "[ \\n\\t]+"
VERBS = "get fetch load set store make create delete remove is has find validate run".split()
OBJECTS = "user order line_item key tax_rate cart audit".split()
BUDGETS = [
    ("", None, "params", None, 40.0), ("", None, "depth", None, 16.0), ("", None, "returns", None, 6.0),
    ("", None, "length", None, 60.0), ("", None, "magic numbers", None, 1.0), ("", None, "comment ratio", 0.02, 0.6),
    ("", None, "secrets", None, 0.0), ("", None, "suppressions", None, 0.0),
    ("src1", None, "params", None, 30.0), ("src1/de", None, "params", None, 50.0), ("src2", "fr", "depth", None, 12.0),
]


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._banded: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def files(self) -> DataFrame:
        docs = self.table("documents").where("text is not null")
        lines = F.when(F.col("text") == "", 0).otherwise(F.size(T.parts(F.col("text"))))
        return docs.select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "lang", "text", lines.alias("lines"), "doc_id", "source")

    def lines(self) -> DataFrame:
        return self.files().where("text <> ''").select("path", "lang", "doc_id", "source", F.posexplode(T.parts(F.col("text"))).alias("at", "body")).withColumn("line", F.col("at") + 1)

    def measured(self) -> DataFrame:
        words = F.filter(F.split("text", WORDS), lambda w: w != "")
        magic = F.size(F.filter(words, lambda w: w.rlike("^[0-9]+$") & ~w.isin("0", "1", "2", "10", "100")))
        odd = F.size(F.filter(T.parts(F.col("text")), lambda b: ~b.rlike("^[A-Za-z]")))
        secrets = F.size(F.regexp_extract_all("text", F.lit('(token|password) ?= ?"?[0-9a-f]{12,}'), F.lit(0)))
        notes = F.size(F.regexp_extract_all("text", F.lit("License"), F.lit(0)))
        # One pass over a file yields all its rows: an array of structs, not a union of scans.
        ratio = F.when(F.col("lines") > 0, F.round(odd / F.col("lines"), 6)).otherwise(0.0)
        pairs = {"length": F.col("lines"), "magic numbers": magic, "comment ratio": ratio, "secrets": secrets, "suppressions": notes}
        of_file = self.files().select("path", "lang", F.lit(1).alias("line"), F.lit("").alias("unit"), _stacked(pairs)).select("path", "lang", "m.*", "line", "unit")
        here = F.filter(F.split("body", "[ \\t]+"), lambda w: w != "")
        unit = F.concat(F.lit("L"), F.col("line"), F.lit("."), F.regexp_extract(F.lower("body"), "[a-z]+", 0))
        depth = F.coalesce(F.array_max(F.transform(here, F.length)), F.lit(0))
        commas = F.length("body") - F.length(F.replace(F.col("body"), F.lit(",")))
        pairs = {"params": F.size(here), "depth": depth, "returns": commas}
        of_line = self.lines().select("path", "lang", "line", unit.alias("unit"), _stacked(pairs)).select("path", "lang", "m.*", "line", "unit")
        return of_file.unionByName(of_line)

    def budgets(self) -> DataFrame:
        return self.spark.createDataFrame(BUDGETS, "scope string, lang string, metric string, lo double, hi double")

    def metrics(self) -> DataFrame:
        return registry.metrics(self.spark)

    def banded(self, often: bool = False) -> DataFrame:
        """Measurements with their bands; written once where a query uses them ``often``."""
        rows = B.banded(self.measured(), self.budgets())
        if often and self._banded is None:
            self._banded = durable.cut(rows)
        return self._banded if often else rows

    def broke(self, often: bool = False) -> DataFrame:
        return R.violations(self.banded(often))

    def names(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.concat(F.lit("n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".py")).alias("path"), F.col("c_mktsegment").alias("lang"),
            F.col("c_custkey").alias("unit_idx"), spelled(F.col("c_custkey")).alias("name"), (F.col("c_acctbal") > 3000).alias("is_public"), "c_name", "c_nationkey", "c_acctbal",
        )

    def comments(self) -> DataFrame:
        role = F.when(F.col("line") == 1, "ModuleHeader").when(F.col("body").rlike("[0-9]"), "FnSummary").otherwise("Inline")
        words = F.size(F.filter(F.split("body", "[ \\t]+"), lambda w: w != ""))
        stops = F.length("body") - F.length(F.replace(F.col("body"), F.lit(".")))
        return self.lines().select("path", "lang", "line", role.alias("role"), words.alias("words"), stops.alias("sentences"))

    def sites(self) -> DataFrame:
        mass = F.size(F.filter(F.split("body", "[ \\t]+"), lambda w: w != ""))
        return self.lines().select("path", "source", F.md5("body").alias("hash"), mass.alias("mass"), "line", F.col("line").alias("end_line")).where("mass >= 3")

    def tokens(self) -> DataFrame:
        words = F.filter(F.split("text", WORDS), lambda w: w != "")
        return self.files().select("path", F.lit("").alias("unit"), words.alias("tokens")).where(F.size("tokens") >= 40)

    def imports(self) -> DataFrame:
        n = self.names()
        own = F.concat(F.lit("pkg.c"), F.floor(F.abs("c_acctbal") / 7).cast("long"))
        hub = F.concat(F.lit(".c"), F.col("c_nationkey") + 100_000 * (F.col("unit_idx") % 9 == 0).cast("int"))
        return n.select(F.col("path").alias("src"), F.posexplode(F.array(own, hub, F.lower(F.col("lang")))).alias("ord", "target"))

    def resolved(self) -> DataFrame:
        return G.resolve(self.imports(), self.names())

    def edges(self) -> DataFrame:
        return G.edges(self.resolved())

    def commits(self) -> DataFrame:
        li, o, p = self.table("lineitem"), self.table("orders"), self.table("part")
        rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
        return rows.select(
            F.col("o_orderkey").alias("sha"), F.unix_timestamp("o_orderdate").alias("at"), F.col("o_custkey").alias("author"),
            F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_brand").alias("dir"), "p_size", "p_retailprice",
        )

    def ledger(self, after: bool) -> DataFrame:
        e = self.table("events").where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp") if after else F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
        return e.groupBy(
            F.col("event_type").alias("metric"), F.concat(F.lit("u"), F.col("user_id") + (F.lit(500) * (F.col("user_id") % 7 == 0).cast("int") if after else F.lit(0))).alias("path"),
            F.concat(F.lit("k"), F.col("user_id")).alias("unit"),
        ).agg(F.max("value").alias("value"))


def _stacked(values: dict[str, Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("m")


def _at(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def spelled(key: Column) -> Column:
    """A name for an integer: a verb and an object in one of five spellings."""
    v, o = _at(VERBS, key % len(VERBS)), _at(OBJECTS, F.floor(key / len(VERBS)) % len(OBJECTS))
    big = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))
    snake = F.concat_ws("_", v, o)
    style = key % 5
    return F.when(style == 0, snake).when(style == 1, F.concat(v, big(o))).when(style == 2, F.concat(big(v), big(o))).when(style == 3, F.upper(snake)).otherwise(F.concat(v, o))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def literal(x) -> str:
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


def spelled_sql(key: str) -> str:
    v, o = f"{_list(VERBS)}[({key} % {len(VERBS)}) + 1]", f"{_list(OBJECTS)}[(({key} // {len(VERBS)}) % {len(OBJECTS)}) + 1]"
    big = lambda x: f"(upper(left({x}, 1)) || substr({x}, 2))"
    return f"(CASE {key} % 5 WHEN 0 THEN {v} || '_' || {o} WHEN 1 THEN {v} || {big(o)} WHEN 2 THEN {big(v)} || {big(o)} WHEN 3 THEN upper({v} || '_' || {o}) ELSE {v} || {o} END)"


_WS = "'[ \\n\\t]+'"
_WORDS_OF = "list_filter(string_split_regex(body, '[ \\t]+'), lambda w: w <> '')"
_SPLIT = "(CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END)"

#: The same views in SQL; a query names what it needs and DuckDB skips the rest.
CTES = {
    "files": f"SELECT concat_ws('/', source, lang, doc_id) AS path, lang, text, len({_SPLIT}) AS lines, doc_id, source FROM documents WHERE text IS NOT NULL",
    "lines_": f"SELECT path, lang, doc_id, source, unnest(l) AS body, generate_subscripts(l, 1) AS line FROM (SELECT *, {_SPLIT} AS l FROM files)",
    "measured": f"""
        SELECT path, lang, unnest(['length', 'magic numbers', 'comment ratio', 'secrets', 'suppressions']) AS metric,
          unnest([lines::DOUBLE,
            len(list_filter(string_split_regex(text, {_WS}), lambda w: regexp_full_match(w, '[0-9]+') AND w NOT IN ('0', '1', '2', '10', '100')))::DOUBLE,
            CASE WHEN lines > 0 THEN round(len(list_filter({_SPLIT}, lambda b: NOT regexp_matches(b, '^[A-Za-z]'))) / lines::DOUBLE, 6) ELSE 0 END,
            len(regexp_extract_all(text, '(token|password) ?= ?"?[0-9a-f]{{12,}}'))::DOUBLE,
            len(regexp_extract_all(text, 'License'))::DOUBLE]) AS value, 1 AS line, '' AS unit FROM files
        UNION ALL
        SELECT path, lang, unnest(['params', 'depth', 'returns']), unnest([len({_WORDS_OF})::DOUBLE,
            coalesce(list_max(list_transform({_WORDS_OF}, lambda w: length(w))), 0)::DOUBLE, (length(body) - length(replace(body, ',', '')))::DOUBLE]),
          line, 'L' || line || '.' || regexp_extract(lower(body), '[a-z]+') FROM lines_""",
    "budgets": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, b)) + ")" for b in BUDGETS) + ") v(scope, blang, bmetric, lo, hi)",
    "metrics": "SELECT * FROM (VALUES "
    + ", ".join(f"({literal(m)}, {r}, {literal(c)})" for m, r, _, _, c in registry.rows())
    + ") v(metric, rung, calib)",
    "banded": """SELECT m.path, m.lang, m.metric, m.value, m.line, m.unit, b.lo, b.hi FROM (SELECT *, row_number() OVER () AS rid FROM measured) m
        JOIN budgets b ON b.bmetric = m.metric AND (b.blang IS NULL OR b.blang = m.lang) AND (b.scope = '' OR m.path LIKE b.scope || '/%')
        QUALIFY row_number() OVER (PARTITION BY m.rid ORDER BY length(b.scope) DESC, (b.blang IS NOT NULL) DESC) = 1""",
    "broke": """SELECT *, CASE WHEN value > hi THEN CASE WHEN hi <> 0 THEN value / hi END WHEN value < lo AND lo <> 0 THEN (lo - value) / lo + 1 END AS severity
        FROM banded WHERE coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE)""",
    "names": f"""SELECT 'n' || c_nationkey || '/c' || c_custkey || '.py' AS path, c_mktsegment AS lang, c_custkey AS unit_idx,
        {spelled_sql("c_custkey")} AS name, c_acctbal > 3000 AS is_public, c_name, c_nationkey, c_acctbal FROM customer""",
    "comments": f"""SELECT path, lang, line, CASE WHEN line = 1 THEN 'ModuleHeader' WHEN regexp_matches(body, '[0-9]') THEN 'FnSummary' ELSE 'Inline' END AS role,
        len({_WORDS_OF}) AS words, length(body) - length(replace(body, '.', '')) AS sentences FROM lines_""",
    "sites": f"SELECT * FROM (SELECT path, source, md5(body) AS hash, len({_WORDS_OF}) AS mass, line, line AS end_line FROM lines_) WHERE mass >= 3",
    "tokens": f"SELECT path, t FROM (SELECT path, list_filter(string_split_regex(text, {_WS}), lambda w: w <> '') AS t FROM files) WHERE len(t) >= 40",
    "imports": """SELECT path AS src, unnest([0, 1, 2]) AS ord, unnest(['pkg.c' || floor(abs(c_acctbal) / 7)::BIGINT,
        '.c' || (c_nationkey + 100000 * (unit_idx % 9 = 0)::INT), lower(lang)]) AS target FROM names""",
    "resolved": r"""SELECT i.src, i.ord, i.target, m.path AS dst, CASE WHEN m.path IS NOT NULL THEN 'internal' WHEN i.target LIKE '.%' THEN 'unresolved' ELSE 'external' END AS kind
        FROM imports i LEFT JOIN (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS last, path FROM names
          QUALIFY row_number() OVER (PARTITION BY last ORDER BY length(path), path) = 1) m ON m.last = string_split_regex(i.target, '[./]')[-1]""",
    "edges": "SELECT DISTINCT src, dst FROM resolved WHERE dst IS NOT NULL AND src <> dst",
    "commits": """SELECT o_orderkey AS sha, epoch(o_orderdate)::BIGINT AS at_, o_custkey AS author, p_brand || '/' || p_type AS file, p_brand AS dir, p_size, p_retailprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "ledger": """SELECT event_type AS metric, 'u' || user_id AS path, 'k' || user_id AS unit, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL""",
    "current_": """SELECT event_type AS metric, 'u' || (user_id + CASE WHEN user_id % 7 = 0 THEN 500 ELSE 0 END) AS path, 'k' || user_id AS unit, max(value) AS value
        FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL""",
}


def sql(query: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + query
