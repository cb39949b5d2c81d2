"""Registered queries over the driver tables, each beside the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate as A
from ..operators import budgets as B
from ..operators import durable
from ..operators import evolve as E
from ..operators import gates as C
from ..operators import graph as G
from ..operators import rank as R
from ..operators import recur as P
from . import made
from .views import Views, literal, spelled, spelled_sql, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function of the views under its name, with its SQL."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    """Counts as BIGINT, whatever they were summed in."""
    kinds = {"int", "smallint", "tinyint"}
    return df.select(*[F.col(c).cast("long").alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


# -- violations and ranking -----------------------------------------------------------

_TOPK = """SELECT metric, path, lang, line::BIGINT AS line, unit, value, hi, severity, rn FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, path, line, unit) AS rn FROM broke) WHERE rn <= 10"""


@query(_TOPK)
def violations_topk(v: Views) -> DataFrame:
    return longs(R.worst_per_metric(v.broke()).select("metric", "path", "lang", "line", "unit", "value", "hi", "severity", "rn"))


@query("SELECT path, line::BIGINT AS line, unit, metric, value, lo, hi FROM banded")
def nested_budget(v: Views) -> DataFrame:
    return longs(v.banded().select("path", "line", "unit", "metric", "value", "lo", "hi"))


@query(
    """SELECT a.blang AS lang, a.bmetric AS metric, coalesce(o.lo, a.lo) AS lo, coalesce(o.hi, a.hi) AS hi FROM
    (SELECT l.lang AS blang, bmetric, lo, hi FROM budgets CROSS JOIN (SELECT DISTINCT lang FROM files) l WHERE scope = '') a
    LEFT JOIN (SELECT blang, bmetric, lo, hi FROM budgets WHERE blang IS NOT NULL) o ON o.blang = a.blang AND o.bmetric = a.bmetric"""
)
def config_merge(v: Views) -> DataFrame:
    langs = v.files().select("lang").distinct()
    base = v.budgets().where("scope = ''").drop("lang", "scope").join(F.broadcast(langs))
    return B.merged(base.select("lang", "metric", "lo", "hi"), v.budgets().where("lang is not null"))


@query(
    """SELECT b.path, b.metric, b.line::BIGINT AS line, b.unit, b.value, c.n - 1 AS peers, c.over_ - 1 AS also_over, c.clean, coalesce(k.name, '') AS kin, k.value AS kin_value
    FROM broke b JOIN (SELECT path, metric, count(*) AS n, count(*) FILTER (WHERE bad) AS over_, coalesce(max(value) FILTER (WHERE NOT bad), 0) AS clean FROM
        (SELECT *, coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE) AS bad FROM banded) GROUP BY ALL) c USING (path, metric)
    LEFT JOIN (SELECT path, metric, string_split_regex(unit, '[.:]')[-1] AS name, value, string_split_regex(unit, '[.:]')[-1] AS job FROM banded
        WHERE NOT (coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE)) AND string_split_regex(unit, '[.:]')[-1] <> '' AND (hi IS NULL OR value >= hi / 2)
        QUALIFY row_number() OVER (PARTITION BY path, metric, job ORDER BY value DESC, line) = 1) k
    ON k.path = b.path AND k.metric = b.metric AND k.job = string_split_regex(b.unit, '[.:]')[-1]"""
)
def neighbourhood(v: Views) -> DataFrame:
    return longs(R.neighbourhood(v.banded(True)))


@query(
    """, bodies AS (SELECT path, line, unit, max(severity) AS worst, count(*) AS findings,
        string_agg(metric || '=' || printf('%.4f', value), ';' ORDER BY metric, value) AS claim FROM broke WHERE severity IS NOT NULL GROUP BY path, line, unit),
    firsts AS (SELECT * FROM bodies QUALIFY row_number() OVER (PARTITION BY path ORDER BY worst DESC, findings DESC, path, line, unit) = 1),
    once AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY claim ORDER BY worst DESC, findings DESC, path, line, unit) = 1)
    SELECT o.path, o.line::BIGINT AS line, o.unit, o.worst, o.findings, o.claim, a.alike FROM (SELECT * FROM once ORDER BY worst DESC, findings DESC, path, line, unit LIMIT 5) o
    JOIN (SELECT claim, count(*) - 1 AS alike FROM bodies GROUP BY claim) a USING (claim)"""
)
def ranked_bodies(v: Views) -> DataFrame:
    return longs(R.bodies(v.broke(True)).select("path", "line", "unit", "worst", "findings", "claim", "alike"))


@query(
    """SELECT metric, count(*) AS n, count(DISTINCT path) AS files, CASE WHEN max(value) > 1 THEN max(value) END AS worst FROM broke WHERE severity IS NULL GROUP BY metric"""
)
def policy_rows(v: Views) -> DataFrame:
    return R.policy_rows(v.broke())


_TEST_REFS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS name FROM benchmark"


def _test_refs(v: Views) -> DataFrame:
    return v.table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name")).distinct()


@query(
    f""", refs AS ({_TEST_REFS}), bare AS (SELECT DISTINCT unit FROM broke WHERE string_split_regex(unit, '[.:]')[-1] NOT IN (SELECT name FROM refs)),
    bearing AS (SELECT path, count(*) AS blast FROM sites WHERE mass >= 12 GROUP BY path HAVING count(*) >= 40)
    SELECT b.path, b.line::BIGINT AS line, b.unit, b.metric, b.value, coalesce(
      CASE WHEN g.blast > 0 THEN 'load-bearing for ' || g.blast END, CASE WHEN u.unit IS NOT NULL THEN 'untested' END,
      CASE WHEN count(*) OVER (PARTITION BY b.path, b.metric) >= 8 THEN 'repeated ' || count(*) OVER (PARTITION BY b.path, b.metric) END,
      CASE WHEN count(*) OVER (PARTITION BY b.metric, b.value) > 1 THEN 'alike ' || (count(*) OVER (PARTITION BY b.metric, b.value) - 1) END, '') AS cost
    FROM broke b LEFT JOIN bearing g USING (path) LEFT JOIN bare u USING (unit)"""
)
def cost_clause(v: Views) -> DataFrame:
    bearing = v.sites().where("mass >= 12").groupBy("path").agg(F.count("*").alias("blast")).where("blast >= 40")
    broke = v.broke(True)
    bare = C.untested(broke, _test_refs(v))
    return longs(R.cost_clause(broke, bearing, bare))


# -- aggregation ----------------------------------------------------------------------


@query("SELECT lang, grouping(lang) AS total, count(*) AS files, sum(lines)::BIGINT AS lines, count(*) FILTER (WHERE lines = 0) AS empty FROM files GROUP BY ROLLUP (lang)")
def headline(v: Views) -> DataFrame:
    return longs(A.headline(v.files()))


@query(
    """SELECT metric, lang, grouping(lang) AS total, count(*) AS measured, count(*) FILTER (WHERE bad) AS violated, round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 6) AS rate
    FROM (SELECT *, coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE) AS bad FROM banded) GROUP BY GROUPING SETS ((metric, lang), (metric))"""
)
def measured_violated_rollup(v: Views) -> DataFrame:
    return longs(A.measured_violated(v.banded()))


@query(
    """SELECT lang, metric, count(*) AS n, list_sort(list(value))[round((count(*) - 1) * 0.5::DOUBLE)::BIGINT + 1] AS p50, list_sort(list(value))[round((count(*) - 1) * 0.9::DOUBLE)::BIGINT + 1] AS p90,
    list_sort(list(value))[round((count(*) - 1) * 0.99::DOUBLE)::BIGINT + 1] AS p99, max(value) AS most FROM measured GROUP BY lang, metric"""
)
def nearest_rank_quantiles(v: Views) -> DataFrame:
    return A.nearest_rank(v.measured(), ["lang", "metric"], "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "most": 1.0})


@query(
    """SELECT lang, metric, value, count(*) AS here, CASE WHEN any_value(n) >= 200 THEN floor(100 * (any_value(r) - 1) / any_value(n))::BIGINT END AS percentile FROM
    (SELECT *, rank() OVER (PARTITION BY lang, metric ORDER BY value) AS r, count(*) OVER (PARTITION BY lang, metric) AS n FROM measured) GROUP BY lang, metric, value"""
)
def percentile_position(v: Views) -> DataFrame:
    return A.percentile_position(v.measured())


@query(
    """SELECT lang, metric, count(*) FILTER (WHERE value > 0) AS having, count(*) AS of, round(count(*) FILTER (WHERE value > 0) / count(*)::DOUBLE, 6) AS rate
    FROM measured WHERE metric IN ('secrets', 'suppressions', 'magic numbers') GROUP BY lang, metric"""
)
def coverage_rates(v: Views) -> DataFrame:
    return A.coverage(v.measured(), ["secrets", "suppressions", "magic numbers"])


@query("SELECT lang, role, count(*) AS runs, sum(words)::BIGINT AS words, sum(sentences)::BIGINT AS sentences, round(sum(words) / count(*)::DOUBLE, 6) AS per_run FROM comments GROUP BY lang, role")
def comment_role_tally(v: Views) -> DataFrame:
    return A.role_tally(v.comments())


_CASE = """CASE WHEN regexp_matches(name, '[A-Z]') AND NOT regexp_matches(name, '[a-z]') THEN CASE WHEN length(name) > 1 THEN 'screaming' ELSE 'neutral' END
  WHEN contains(trim(name, '_'), '_') AND NOT regexp_matches(name, '[A-Z]') THEN 'snake' WHEN regexp_matches(name, '^_*[A-Z]') THEN 'pascal'
  WHEN regexp_matches(name, '[A-Z]') THEN 'camel' ELSE 'neutral' END"""


@query(
    f""", c AS (SELECT lang, {_CASE} AS k FROM names), w AS (SELECT lang, count(*) FILTER (WHERE k = 'snake') AS snake, count(*) FILTER (WHERE k = 'camel') AS camel,
      count(*) FILTER (WHERE k = 'pascal') AS pascal, count(*) FILTER (WHERE k = 'screaming') AS screaming FROM c WHERE k <> 'neutral' GROUP BY lang)
    SELECT *, ['snake', 'camel', 'pascal', 'screaming'][list_position([snake, camel, pascal, screaming], greatest(snake, camel, pascal, screaming))] AS dominant,
      round(CASE WHEN len(list_filter([snake, camel, pascal, screaming], lambda x: x > 0)) < 2 THEN 0 ELSE
        list_sum(list_transform(list_filter([snake, camel, pascal, screaming], lambda x: x > 0), lambda x: -(x / (snake + camel + pascal + screaming)::DOUBLE) * log2(x / (snake + camel + pascal + screaming)::DOUBLE))) / 2 END, 6) AS entropy FROM w"""
)
def idiom_entropy(v: Views) -> DataFrame:
    return A.spelling(v.names())


@query(
    """, s AS (SELECT CASE WHEN rung <= 2 THEN 'gate' ELSE 'suspicion' END AS class, metric, count(*) AS n FROM broke JOIN metrics USING (metric) WHERE rung <= 4 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, metric) AS r, sum(n) OVER (PARTITION BY class) AS total FROM s)
    SELECT class, max(total)::BIGINT AS total, string_agg(metric || '=' || n, ',' ORDER BY r) AS drivers FROM r WHERE r <= 3 GROUP BY class"""
)
def verdict(v: Views) -> DataFrame:
    return A.verdict(v.banded(), v.metrics())


def _calls(v: Views) -> DataFrame:
    o, c = v.table("orders"), v.names().select("path", "lang", "unit_idx", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.unit_idx)
    return rows.select(F.concat(F.lit("n"), "c_nationkey").alias("path"), "lang", "unit_idx", spelled(F.col("o_orderkey")).alias("callee"))


@query(
    f""", first AS (SELECT 'n' || c_nationkey AS path, name AS callee, min(unit_idx) AS at_ FROM names GROUP BY ALL),
    calls AS (SELECT 'n' || c_nationkey AS path, lang, unit_idx, {spelled_sql("o_orderkey")} AS callee FROM orders JOIN names ON o_custkey = unit_idx)
    SELECT lang, count(*) FILTER (WHERE at_ > unit_idx) AS down, count(*) FILTER (WHERE at_ < unit_idx) AS up FROM calls JOIN first USING (path, callee) GROUP BY lang"""
)
def narrative(v: Views) -> DataFrame:
    return A.narrative(v.names().withColumn("path", F.concat(F.lit("n"), "c_nationkey")), _calls(v))


@query(
    """, u AS (SELECT 'n' || c_nationkey AS path, lang, unit_idx, is_public FROM names)
    SELECT a.lang, count(*) FILTER (WHERE a.is_public) AS first, count(*) AS pairs FROM u a JOIN u b ON a.path = b.path AND a.lang = b.lang AND a.unit_idx < b.unit_idx AND a.is_public <> b.is_public GROUP BY a.lang"""
)
def public_first(v: Views) -> DataFrame:
    units = v.names().withColumn("path", F.concat_ws(":", F.concat(F.lit("n"), "c_nationkey"), "lang"))
    return A.public_first(units)


@query(
    """, p AS (SELECT lang, metric, count(*) AS n, list_sort(list(value)) AS l FROM measured GROUP BY lang, metric HAVING count(*) >= 200)
    SELECT * FROM (SELECT lang, metric, n, CASE WHEN calib = 'band' THEN round(l[round((n - 1) * 0.05::DOUBLE)::BIGINT + 1], 2) END AS lo,
      CASE WHEN calib = 'band' THEN round(l[round((n - 1) * 0.95::DOUBLE)::BIGINT + 1], 2) ELSE ceil(l[round((n - 1) * 0.99::DOUBLE)::BIGINT + 1]) END AS hi
    FROM p JOIN metrics USING (metric) WHERE calib <> 'policy') WHERE lo IS NOT NULL OR hi > 0"""
)
def calibrate_pins(v: Views) -> DataFrame:
    return A.pins(v.measured(), v.metrics())


@query(
    """SELECT metric, measured, violated, rate, rung::BIGINT AS rung FROM (SELECT metric, count(*) AS measured, count(*) FILTER (WHERE bad) AS violated,
      round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 6) AS rate FROM (SELECT *, coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE) AS bad FROM banded) GROUP BY metric)
    JOIN metrics USING (metric) WHERE calib = 'policy' AND rate > CASE WHEN rung <= 2 THEN 0.01 ELSE 0.05 END"""
)
def policy_audit(v: Views) -> DataFrame:
    return longs(A.policy_audit(v.banded(), v.metrics()))


@query(
    r""", r AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, metric, rung, coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE) AS bad FROM banded JOIN metrics USING (metric)),
    g AS (SELECT dir, count(DISTINCT path) AS files, count(*) FILTER (WHERE bad AND rung <= 2) AS gates, count(*) FILTER (WHERE bad AND rung BETWEEN 3 AND 4) AS suspicions FROM r GROUP BY dir HAVING count(DISTINCT path) >= 3),
    d AS (SELECT dir, metric FROM r WHERE bad AND rung <= 2 GROUP BY dir, metric QUALIFY row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, metric) = 1)
    SELECT dir, files, gates, suspicions, round(gates / files::DOUBLE, 6) AS density, coalesce(d.metric, '') AS driver FROM g LEFT JOIN d USING (dir)"""
)
def dir_rollup(v: Views) -> DataFrame:
    return A.dir_rollup(v.banded(True), v.metrics())


# -- scalar functions -----------------------------------------------------------------

_CUT = r"list_filter(string_split_regex(lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')), '[_\-. \t]+'), lambda w: w <> '')"


@query(f"SELECT path, name, array_to_string({_CUT}, ' ') AS words, {_CUT}[1] AS job, {_CASE} AS style FROM names")
def name_words(v: Views) -> DataFrame:
    n = F.col("name")
    return v.names().select("path", "name", F.array_join(T.name_words(n), " ").alias("words"), T.job_word(n).alias("job"), T.case_of(n).alias("style"))


_VERB_LIST = "[" + ", ".join(f"'{x}'" for x in T.VERBS) + "]"


@query(f"SELECT path, {_CUT}[1] AS verb, array_to_string({_CUT}[2:], '_') AS object FROM names WHERE list_contains({_VERB_LIST}, {_CUT}[1]) AND len({_CUT}) > 1")
def split_synonym(v: Views) -> DataFrame:
    return v.names().select("path", T.split_synonym(F.col("name")).alias("s")).where("s is not null").select("path", "s.verb", "s.object")


@query(f"SELECT array_to_string({_CUT}[2:], '_') AS object, count(DISTINCT {_CUT}[1]) AS verbs, string_agg(DISTINCT {_CUT}[1], ',' ORDER BY {_CUT}[1]) AS spelled FROM names WHERE list_contains({_VERB_LIST}, {_CUT}[1]) AND len({_CUT}) > 1 GROUP BY 1 HAVING count(DISTINCT {_CUT}[1]) >= 2")
def synonym_drift(v: Views) -> DataFrame:
    return P.synonym_drift(v.names())


_HOLDERS = ["api_key", "token", "user_password"]


def _credentials(v: Views) -> DataFrame:
    h, k = F.md5("c_name"), F.col("c_custkey") % 8
    value = (
        F.when(k == 0, F.concat(F.lit("ghp_"), h)).when(k == 1, F.concat(F.lit("AKIA"), F.upper(F.left(h, F.lit(16))))).when(k == 2, h)
        .when(k == 3, F.concat(F.lit("example"), h)).when(k == 4, F.concat(F.lit("postgres://u:"), F.left(h, F.lit(9)), F.lit("@host/db")))
        .when(k == 5, F.concat(F.lit("/usr/"), h)).when(k == 6, F.concat(F.lit("${"), h, F.lit("}"))).otherwise(F.lit("PLAIN_WORDS"))
    )
    return v.table("customer").select("c_custkey", F.get(F.array(*map(F.lit, _HOLDERS)), (F.col("c_custkey") % 3).cast("int")).alias("name"), value.alias("value"))


_CREDENTIALS = f"""SELECT c_custkey, {_HOLDERS}[c_custkey % 3 + 1] AS name, CASE c_custkey % 8 WHEN 0 THEN 'ghp_' || md5(c_name) WHEN 1 THEN 'AKIA' || upper(left(md5(c_name), 16)) WHEN 2 THEN md5(c_name)
  WHEN 3 THEN 'example' || md5(c_name) WHEN 4 THEN 'postgres://u:' || left(md5(c_name), 9) || '@host/db' WHEN 5 THEN '/usr/' || md5(c_name) WHEN 6 THEN '${{' || md5(c_name) || '}}' ELSE 'PLAIN_WORDS' END AS value FROM customer"""
_VENDOR_SQL = rf"""((contains(value, 'PRIVATE KEY-----') AND length(value) >= 60) OR (regexp_matches(value, '://[^\s/?#:@]*:[^\s/?#@{{$%<]{{6,}}@')
  AND regexp_matches(value, '://[^\s/?#:@]*:[^\s/?#@]*([0-9]|[A-Z][^@]*[a-z]|[a-z][^@]*[A-Z])[^\s/?#@]*@')) OR regexp_matches(value, '{T.VENDOR}'))"""
_KEY_SQL = r"""(length(value) >= 8 AND NOT regexp_matches(value, '[{$<\s%:.]') AND NOT starts_with(value, '/') AND (NOT contains(value, '/') OR regexp_matches(value, '^[A-Za-z0-9+/=]{20,}$'))
  AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '^[A-Z_]+[0-9]*$') AND regexp_matches(value, '[A-Za-z0-9]{12,}'))"""


@query(
    f""", c AS ({_CREDENTIALS}), d AS (SELECT *, {_VENDOR_SQL} AS vendor, {_KEY_SQL} AS key_like, regexp_matches(lower(value), '{T.PLACEHOLDER}') AS placeholder FROM c)
    SELECT *, NOT placeholder AND (vendor OR (regexp_matches(lower(name), '{T.CREDENTIAL}') AND key_like)) AS leaked FROM d"""
)
def leaked_credential(v: Views) -> DataFrame:
    name, value = F.col("name"), F.col("value")
    return _credentials(v).select(
        "*", T.vendor_key(value).alias("vendor"), T.looks_like_a_key(value).alias("key_like"), T.is_placeholder(value).alias("placeholder"), T.is_leaked_credential(name, value).alias("leaked")
    )


@query(
    r"""SELECT scope, bmetric AS metric, blang AS lang, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN n(lo) || '-' || n(hi) WHEN hi IS NOT NULL THEN '<=' || n(hi) ELSE '>=' || n(lo) END AS label FROM budgets""".replace(
        "n(lo)", r"regexp_replace(regexp_replace(printf('%.2f', lo), '0+$', ''), '\.$', '')"
    ).replace("n(hi)", r"regexp_replace(regexp_replace(printf('%.2f', hi), '0+$', ''), '\.$', '')")
)
def band_label(v: Views) -> DataFrame:
    return v.budgets().select("scope", "metric", "lang", T.band_label(F.col("lo"), F.col("hi")).alias("label"))


@query("SELECT path, line::BIGINT AS line, unit, metric, value, severity FROM broke")
def severity(v: Views) -> DataFrame:
    return longs(v.broke().select("path", "line", "unit", "metric", "value", "severity"))


_DEP = "'app/node_modules/' || CASE p_size % 3 WHEN 0 THEN '@s' || p_size || '/' || p_type WHEN 1 THEN 'git.x/' || p_type || '/' || p_size ELSE p_type END || '/lib/' || p_partkey || '.js'"


def _dep_path() -> F.Column:
    middle = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("@s"), "p_size", F.lit("/"), "p_type")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("git.x/"), "p_type", F.lit("/"), "p_size")).otherwise(F.col("p_type"))
    return F.concat(F.lit("app/node_modules/"), middle, F.lit("/lib/"), "p_partkey", F.lit(".js"))


@query(
    rf""", d AS (SELECT {_DEP} AS path, 'values-' || lower(p_type) || '.yaml' AS chart FROM part)
    SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '') AS stem, CASE WHEN path LIKE 'app/node_modules/@%' THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4)
      WHEN contains(split_part(path, '/', 3), '.') THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4) || '/' || split_part(path, '/', 5) ELSE split_part(path, '/', 3) END AS package,
      regexp_extract(chart, 'values-(.*)\.yaml', 1) AS env FROM d"""
)
def path_fns(v: Views) -> DataFrame:
    chart = F.concat(F.lit("values-"), F.lower("p_type"), F.lit(".yaml"))
    rows = v.table("part").select(_dep_path().alias("path"), chart.alias("chart"))
    p = F.col("path")
    return rows.select("path", T.dir_of(p).alias("dir"), T.stem(p).alias("stem"), T.package_of(p).alias("package"), T.environment_of(F.col("chart")).alias("env"))


# -- recurrence -----------------------------------------------------------------------


@query(
    """SELECT hash, count(*) AS sites, max(mass)::BIGINT AS mass, arg_min(path || ':' || line, (path, line)) AS first, ((count(*) - 1) * max(mass))::BIGINT AS spare FROM sites GROUP BY hash HAVING count(*) >= 2"""
)
def clone_classes(v: Views) -> DataFrame:
    return longs(P.clone_classes(v.sites()))


@query()
def maximal_clones(v: Views) -> DataFrame:
    return P.maximal_clones(v.sites())


_PRINTS = """, g AS (SELECT path, list_transform(range(1, len(t) - 3), lambda i: md5(array_to_string(list_slice(t, i, i + 4), ' '))) AS g FROM tokens),
    fp AS (SELECT DISTINCT path || '#' AS u, unnest(list_transform(range(1, len(g) - 2), lambda i: list_min(list_slice(g, i, i + 3)))) AS fp FROM g),
    posts AS (SELECT fp, count(*) AS n FROM fp GROUP BY fp)"""


@query(
    f"""{_PRINTS}, sizes AS (SELECT u, count(*) AS n FROM fp GROUP BY u), l AS (SELECT fp.* FROM fp JOIN posts USING (fp) WHERE n BETWEEN 2 AND 12),
    p AS (SELECT x.u AS a, y.u AS b, count(*) AS shared FROM l x JOIN l y ON x.fp = y.fp AND x.u < y.u GROUP BY ALL)
    SELECT a, b, shared, round(shared / least(s.n, t.n)::DOUBLE, 6) AS overlap FROM p JOIN sizes s ON s.u = a JOIN sizes t ON t.u = b WHERE shared / least(s.n, t.n)::DOUBLE >= 0.6"""
)
def near_clones(v: Views) -> DataFrame:
    return P.near_clones(P.print_sets(v.tokens()))


@query(f"{_PRINTS} SELECT count(*) AS suppressed, coalesce(max(n), 0) AS widest FROM posts WHERE n > 12")
def suppressed_prints(v: Views) -> DataFrame:
    tokens = v.tokens()
    return P.suppressed_prints(P.print_sets(tokens), tokens.select("path", "unit"))


@query(
    """, p AS (SELECT l_orderkey AS o, 'p' || (l_suppkey % 12) AS name FROM lineitem GROUP BY ALL), k AS (SELECT o FROM p GROUP BY o HAVING count(*) BETWEEN 3 AND 8),
    q AS (SELECT p.* FROM p JOIN k USING (o)),
    s AS (SELECT a.name || ',' || b.name || ',' || c.name AS clump FROM q a JOIN q b ON a.o = b.o AND a.name < b.name JOIN q c ON c.o = a.o AND b.name < c.name UNION ALL
      SELECT a.name || ',' || b.name || ',' || c.name || ',' || d.name FROM q a JOIN q b ON a.o = b.o AND a.name < b.name JOIN q c ON c.o = a.o AND b.name < c.name JOIN q d ON d.o = a.o AND c.name < d.name),
    n AS (SELECT clump, count(*) AS n FROM s GROUP BY clump HAVING count(*) >= 3)
    SELECT clump, n FROM n x WHERE NOT EXISTS (SELECT 1 FROM n y WHERE y.n = x.n AND len(string_split(y.clump, ',')) = 4 AND len(string_split(x.clump, ',')) = 3
      AND list_has_all(string_split(y.clump, ','), string_split(x.clump, ',')))"""
)
def param_clumps(v: Views) -> DataFrame:
    rows = v.table("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_suppkey") % 12)).alias("params"))
    return P.param_clumps(rows)


@query(
    """SELECT labels, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT 'o' || (l_orderkey // 10) AS path, l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '|' ORDER BY l_returnflag || l_linestatus) AS labels
      FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag || l_linestatus) >= 3) GROUP BY labels HAVING count(*) >= 3"""
)
def label_sets(v: Views) -> DataFrame:
    path = F.concat(F.lit("o"), F.floor(F.col("l_orderkey") / 10))
    sets = v.table("lineitem").groupBy(path.alias("path"), "l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("labels"))
    return P.label_sets(sets)


# -- evolution ------------------------------------------------------------------------

_CHURN = """churn AS (SELECT file, round(sum(pow(0.5::DOUBLE, ((SELECT max(at_) FROM commits) - at_) / 86400::DOUBLE / 180::DOUBLE)), 6) AS churn, count(*) AS commits, count(DISTINCT author) AS authors FROM commits GROUP BY file)"""


@query(
    f""", {_CHURN}, w AS (SELECT file, max(p_size)::DOUBLE AS a, round(max(p_retailprice) / 100, 2) AS b FROM commits GROUP BY file)
    SELECT file, churn, commits, authors, greatest(a, b) AS value, CASE WHEN a >= b THEN 'length' ELSE 'params' END AS metric, round(churn * greatest(a, b), 4) AS score FROM churn JOIN w USING (file) ORDER BY score DESC, file LIMIT 12"""
)
def hotspots(v: Views) -> DataFrame:
    c = v.commits()
    size = c.groupBy("file").agg(F.max("p_size").cast("double").alias("a"), F.round(F.max("p_retailprice") / 100, 2).alias("b"))
    worst = size.select("file", F.explode(F.array(F.struct(F.lit("length").alias("metric"), F.col("a").alias("value")), F.struct(F.lit("params").alias("metric"), F.col("b").alias("value")))).alias("w")).select("file", "w.*")
    return E.hotspots(c, worst)


@query(
    """, r AS (SELECT DISTINCT sha, file, dir FROM commits), t AS (SELECT file, count(*) AS n FROM r GROUP BY file), k AS (SELECT sha FROM r GROUP BY sha HAVING count(*) BETWEEN 2 AND 30), f AS (SELECT r.* FROM r JOIN k USING (sha)),
    p AS (SELECT x.file AS a, y.file AS b, count(*) AS shared FROM f x JOIN f y ON x.sha = y.sha AND x.file < y.file AND x.dir <> y.dir GROUP BY ALL HAVING count(*) >= 3)
    SELECT a, b, shared, round(shared / least(s.n, u.n)::DOUBLE, 6) AS strength FROM p JOIN t s ON s.file = a JOIN t u ON u.file = b WHERE shared / least(s.n, u.n)::DOUBLE >= 0.05"""
)
def coupling_pairs(v: Views) -> DataFrame:
    return E.coupling(v.commits(), strength=0.05)


@query("SELECT 'c' || o_custkey AS file, min(c_nationkey)::BIGINT AS author, count(*) AS commits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey HAVING count(*) >= 5 AND count(DISTINCT c_nationkey) = 1")
def sole_authors(v: Views) -> DataFrame:
    o, c = v.table("orders"), v.table("customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("c"), "o_custkey").alias("file"), F.col("c_nationkey").cast("long").alias("author"))
    return E.sole_authors(rows)


_AGES = "ages AS (SELECT path, line::BIGINT AS line, floor((1700000000 - (1600000000 + 86400 * (7 * line + doc_id % 500))) / 86400::DOUBLE)::BIGINT AS days FROM lines_ WHERE regexp_matches(body, '[0-9]'))"


def _ages(v: Views) -> DataFrame:
    lines = v.lines()
    debts = lines.where(F.col("body").rlike("[0-9]")).select("path", "line")
    blame = lines.select("path", "line", (1_600_000_000 + F.lit(86_400).cast("long") * (7 * F.col("line") + F.col("doc_id") % 500)).alias("at"))
    return E.debt_age(debts, blame, 1_700_000_000)


@query(f", {_AGES} SELECT * FROM ages")
def debt_age(v: Views) -> DataFrame:
    return longs(_ages(v))


@query(f", {_AGES} SELECT list_sort(list(days))[count(*) // 2 + 1] AS median, count(*) AS n FROM ages")
def debt_median(v: Views) -> DataFrame:
    return E.median_age(_ages(v))


@query(
    """, d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'error') AS gates, count(*) FILTER (WHERE event_type = 'view') AS suspicions FROM events GROUP BY ALL)
    SELECT day, gates, suspicions, gates - lag(gates) OVER (ORDER BY day) AS d_gates, suspicions - lag(suspicions) OVER (ORDER BY day) AS d_suspicions FROM d"""
)
def history_delta(v: Views) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    runs = v.table("events").groupBy(day.alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("gates"), F.count_if(F.col("event_type") == "view").alias("suspicions"))
    return E.history_delta(runs, ["gates", "suspicions"])


# -- graph ----------------------------------------------------------------------------

_REACH = "reach(node, by_) AS (SELECT dst, src FROM edges UNION SELECT r.node, e.src FROM reach r JOIN edges e ON e.dst = r.by_)"
_SCC = f"""{_REACH}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
    scc AS (SELECT n.node, least(n.node, coalesce(min(r.by_), n.node)) AS scc FROM nodes n LEFT JOIN (SELECT a.node, a.by_ FROM reach a JOIN reach b ON a.node = b.by_ AND a.by_ = b.node) r USING (node) GROUP BY n.node)"""


@query("SELECT src, dst FROM edges")
def edges(v: Views) -> DataFrame:
    return v.edges()


@query("SELECT kind, count(*) AS n FROM resolved GROUP BY kind")
def import_kinds(v: Views) -> DataFrame:
    return v.resolved().groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE kind = 'internal') AS internal, count(*) FILTER (WHERE kind = 'external') AS external, count(*) FILTER (WHERE kind = 'unresolved') AS unresolved,
    round(count(*) FILTER (WHERE kind = 'internal') / count(*) FILTER (WHERE kind <> 'external')::DOUBLE, 6) AS rate FROM resolved""")
def resolve_rate(v: Views) -> DataFrame:
    return G.resolve_rate(v.resolved())


@query(r"SELECT src, dst, count(*) AS n FROM (SELECT regexp_replace(src, '/[^/]*$', '') AS src, regexp_replace(dst, '/[^/]*$', '') AS dst FROM edges) WHERE src <> dst GROUP BY ALL")
def dir_edges(v: Views) -> DataFrame:
    return G.dir_edges(v.edges())


@query(f", {_SCC} SELECT node, scc FROM scc")
def components(v: Views) -> DataFrame:
    return G.components(v.edges())


@query(f", {_SCC}, s AS (SELECT scc, count(*) AS n FROM scc GROUP BY scc) SELECT sum(n)::BIGINT AS modules, count(*) FILTER (WHERE n > 1) AS cycles, max(n) AS largest, round(100 * coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n)::DOUBLE, 6) AS mass FROM s")
def cycle_mass(v: Views) -> DataFrame:
    return G.cycle_mass(G.components(v.edges()))


_DEPTH = f"""{_SCC}, dag AS (SELECT DISTINCT a.scc AS s, b.scc AS d FROM edges e JOIN scc a ON a.node = e.src JOIN scc b ON b.node = e.dst WHERE a.scc <> b.scc),
    chain(c, k) AS (SELECT DISTINCT scc, 1 FROM scc UNION SELECT dag.s, k + 1 FROM chain JOIN dag ON dag.d = chain.c), level AS (SELECT c, max(k) AS depth FROM chain GROUP BY c)"""


@query(f", {_DEPTH}, l AS (SELECT list_sort(list(depth)) AS l, count(*) AS n FROM scc JOIN level ON c = scc) SELECT n, l[round((n - 1) * 0.5::DOUBLE)::BIGINT + 1]::DOUBLE AS p50, l[round((n - 1) * 0.9::DOUBLE)::BIGINT + 1]::DOUBLE AS p90, l[n]::DOUBLE AS deepest FROM l")
def depth_quantiles(v: Views) -> DataFrame:
    return G.depth_quantiles(G.depths(v.edges()))


@query(f", {_REACH} SELECT m.path, count(r.by_) AS blast FROM names m LEFT JOIN (SELECT * FROM reach WHERE node <> by_) r ON r.node = m.path GROUP BY m.path")
def blast_radius(v: Views) -> DataFrame:
    return G.blast_radius(v.names(), v.edges())


@query(f", {_REACH} SELECT m.path, count(r.by_) AS blast FROM names m JOIN (SELECT * FROM reach WHERE node <> by_) r ON r.node = m.path GROUP BY m.path ORDER BY blast DESC, path LIMIT 5")
def load_bearing(v: Views) -> DataFrame:
    return G.load_bearing(G.blast_radius(v.names(), v.edges()))


@query(f", {_REACH} SELECT count(*) AS judged, count(*) FILTER (WHERE b = 0) AS free, round(100 * count(*) FILTER (WHERE b = 0) / count(*)::DOUBLE, 6) AS share FROM (SELECT m.path, count(r.by_) AS b FROM names m LEFT JOIN (SELECT * FROM reach WHERE node <> by_) r ON r.node = m.path GROUP BY m.path)")
def deletable(v: Views) -> DataFrame:
    return G.deletable(v.names(), G.blast_radius(v.names(), v.edges()))


#: Files of a made project, and imports among them: source, target, where it leads, kind.
_PROJECT = {
    "py": ["pkg{k}/__init__.py", "pkg{k}/a.py", "pkg{k}/types.py", "pkg{k}/sub/__init__.py", "pkg{k}/sub/b.py", "plain/tool{k}.py"], "ts": ["web/x.ts", "web/lib/index.ts", "web/y.tsx"],
    "rs": ["src/lib.rs", "src/a/mod.rs", "src/a/b.rs", "src/c.rs"], "go": ["go/util/u.go", "go/main.go"], "java": ["jv/com/x{k}/Foo.java", "jv/com/x{k}/Bar.java"],
}
_IMPORTS = [
    ("py", "pkg{k}/a.py", ".types", "pkg{k}/types.py", "internal"), ("py", "pkg{k}/a.py", "types", None, "external"), ("py", "pkg{k}/a.py", "pkg{k}.sub.b", "pkg{k}/sub/b.py", "internal"),
    ("py", "pkg{k}/sub/b.py", "..a", "pkg{k}/a.py", "internal"), ("py", "pkg{k}/sub/b.py", ".", "pkg{k}/sub/__init__.py", "internal"), ("py", "pkg{k}/sub/b.py", ".gone", None, "unresolved"),
    ("py", "pkg{k}/sub/b.py", "sub.b", None, "external"), ("py", "pkg{k}/a.py", "plain.tool{k}", "plain/tool{k}.py", "internal"), ("py", "pkg{k}/a.py", "pkg{k}", "pkg{k}/__init__.py", "internal"),
    ("ts", "web/x.ts", "./lib", "web/lib/index.ts", "internal"), ("ts", "web/lib/index.ts", "../y", "web/y.tsx", "internal"), ("ts", "web/x.ts", "react", None, "external"),
    ("ts", "web/x.ts", "./none", None, "unresolved"), ("rs", "src/lib.rs", "crate::a::b::Thing", "src/a/b.rs", "internal"), ("rs", "src/a/b.rs", "super::c", "src/a/mod.rs", "internal"),
    ("rs", "src/a/mod.rs", "self::b", "src/a/b.rs", "internal"), ("rs", "src/c.rs", "std::fs", None, "external"), ("rs", "src/c.rs", "crate::Root", "src/lib.rs", "internal"),
    ("rs", "src/c.rs", "serde::Serialize", None, "external"), ("rs", "src/a/b.rs", "crate::c::*", "src/c.rs", "internal"), ("go", "go/main.go", "example.com/r{k}/go/util", "go/util/u.go", "internal"),
    ("go", "go/main.go", "fmt", None, "external"), ("java", "jv/com/x{k}/Foo.java", "com.x{k}.Bar", "jv/com/x{k}/Bar.java", "internal"),
    ("java", "jv/com/x{k}/Foo.java", "com.x{k}.Bar.Inner", "jv/com/x{k}/Bar.java", "internal"), ("java", "jv/com/x{k}/Foo.java", "java.util.List", None, "external"),
]


def _filled(text: str | None, sep: str) -> str:
    return "NULL" if text is None else " || ".join(f"'{x}'" for x in (sep + text).split("{k}")).replace(" || ", " || s_suppkey || ")


def import_resolution(v: Views) -> DataFrame:
    """Imports of made projects, one a supplier, in five languages."""
    from ..operators import resolve as S

    made_of = lambda text: F.expr(_filled(text, "").replace(" || s_suppkey || ", " || cast(s_suppkey as string) || "))
    below = lambda text: F.concat(F.lit("r"), F.col("s_suppkey").cast("string"), F.lit("/"), made_of(text))
    s = v.table("supplier").select("s_suppkey")
    files = F.array(*[F.struct(below(f).alias("path"), F.lit(lang).alias("lang")) for lang, fs in _PROJECT.items() for f in fs])
    rows = F.array(*[F.struct(below(src).alias("src"), F.lit(i).alias("ord"), F.lit(lang).alias("lang"), made_of(target).alias("target")) for i, (lang, src, target, *_) in enumerate(_IMPORTS)])
    modules = s.select(F.explode(files).alias("f")).select("f.*")
    return longs(S.resolve(s.select(F.explode(rows).alias("i")).select("i.*"), modules))


QUERIES["import_resolution"] = lambda spark, sf_dir: import_resolution(Views(spark, sf_dir))
ORACLES["import_resolution"] = " UNION ALL ".join(
    f"SELECT 'r' || s_suppkey || {_filled(src, '/')} AS src, {i}::BIGINT AS ord, {_filled(target, '')} AS target, {'NULL' if dst is None else f"'r' || s_suppkey || {_filled(dst, '/')}"} AS dst, '{kind}' AS kind FROM supplier"
    for i, (_, src, target, dst, kind) in enumerate(_IMPORTS)
)


@query("SELECT path FROM names WHERE path NOT IN (SELECT dst FROM edges)")
def orphans(v: Views) -> DataFrame:
    return G.orphans(v.names(), v.edges())


def _exports(v: Views) -> DataFrame:
    return v.names().select("path", F.concat_ws("_", "name", F.col("unit_idx") % 40).alias("name"))


def _mentions(v: Views) -> DataFrame:
    return v.table("orders").select(F.concat(F.lit("f"), "o_custkey").alias("path"), F.concat_ws("_", spelled(F.col("o_custkey")), F.col("o_orderkey") % 90).alias("name"))


_EXPORTS = f"ex AS (SELECT path, name || '_' || (unit_idx % 40) AS name FROM names), me AS (SELECT 'f' || o_custkey AS path, {spelled_sql('o_custkey')} || '_' || (o_orderkey % 90) AS name FROM orders)"


@query(f", {_EXPORTS} SELECT ex.path, ex.name FROM ex LEFT JOIN (SELECT name, count(DISTINCT path) AS f FROM me GROUP BY name) m USING (name) WHERE coalesce(f, 0) <= 1")
def dead_exports(v: Views) -> DataFrame:
    return G.dead_exports(_exports(v), _mentions(v))


@query(f", {_EXPORTS} SELECT ex.path, count(*) AS exports, count(*) FILTER (WHERE ex.name IN (SELECT name FROM me)) AS hits FROM ex GROUP BY ex.path")
def fat_surface(v: Views) -> DataFrame:
    ex = _exports(v)
    used = ex.join(_mentions(v).select("name").distinct(), "name", "left_semi").select("path", "name")
    return G.fat_surfaces(ex, used)


@query("SELECT path, round(mass / cost::DOUBLE, 6) AS depth FROM (SELECT path, sum(mass) AS mass, count(*) AS cost FROM sites GROUP BY path)")
def interface_depth(v: Views) -> DataFrame:
    return G.interface_depth(v.sites().groupBy("path").agg(F.sum("mass").alias("mass"), F.count("*").alias("cost")))


_LAYERS = [("core", "n1/"), ("edge", "n2"), ("data", "n21"), ("tools", "c1")]


@query(
    f""", layers AS (SELECT * FROM (VALUES {", ".join(map(str, _LAYERS))}) v(layer, holds)), placed AS (SELECT n.path, layer FROM names n JOIN layers ON contains(n.path, holds) QUALIFY row_number() OVER (PARTITION BY n.path ORDER BY length(holds) DESC, layer) = 1)
    SELECT src, dst, a.layer AS from_layer, b.layer AS to_layer FROM edges JOIN placed a ON a.path = src JOIN placed b ON b.path = dst WHERE (a.layer, b.layer) IN (('core', 'edge'), ('data', 'tools'), ('tools', 'core'))"""
)
def layer_breaches(v: Views) -> DataFrame:
    layers = v.spark.createDataFrame(_LAYERS, "layer string, holds string")
    forbidden = v.spark.createDataFrame([("core", "edge"), ("data", "tools"), ("tools", "core")], "from_layer string, to_layer string")
    return G.layer_breaches(v.edges(), layers, forbidden)


# -- gates and sets -------------------------------------------------------------------


@query("SELECT metric, path, unit, max(value) AS value FROM broke JOIN metrics USING (metric) WHERE rung <= 2 GROUP BY ALL")
def baseline_write(v: Views) -> DataFrame:
    return C.baseline(v.broke(), v.metrics())


#: A ceiling, a floor, a band and an unknown metric among the kinds of events.
_WAYS = [("click", None, 1.0), ("purchase", 1.0, None), ("error", 0.1, 0.9), ("view", None, 2.0)]


@query(
    f""", ways AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(literal, w)) + ")" for w in _WAYS)}) v(metric, wlo, whi)),
    gone AS (SELECT metric, unit, CASE WHEN any_value(wlo) IS NOT NULL AND any_value(whi) IS NULL THEN min(value) ELSE max(value) END AS m
      FROM ledger LEFT JOIN ways USING (metric) WHERE path NOT IN (SELECT path FROM current_) GROUP BY ALL),
    x AS (SELECT c.*, coalesce(l.value, g.m) AS was, w.wlo, w.whi FROM current_ c LEFT JOIN ledger l USING (metric, path, unit) LEFT JOIN gone g USING (metric, unit) LEFT JOIN ways w USING (metric))
    SELECT metric, path, unit, value, was, CASE WHEN was IS NULL THEN 'new' ELSE 'worse' END AS why FROM x
    WHERE was IS NULL OR (wlo IS NULL AND whi IS NOT NULL AND value > was) OR (wlo IS NOT NULL AND whi IS NULL AND value < was)"""
)
def ratchet_check(v: Views) -> DataFrame:
    now = v.ledger(True)
    return C.ratchet(now, v.ledger(False), now, v.spark.createDataFrame(_WAYS, "metric string, lo double, hi double"))


@query(
    """, h AS (SELECT concat_ws('/', source, d.lang, doc_id) AS path, 1 + quality * 3 AS first, 1 + quality * 3 + toxic * 2 AS last FROM labels JOIN documents d USING (doc_id)),
    u AS (SELECT path, 'L' || line AS unit, line, line + 2 AS end_line FROM lines_)
    SELECT DISTINCT u.path, unit, line::BIGINT AS line, end_line::BIGINT AS end_line FROM u JOIN h ON u.path = h.path AND line <= last AND end_line >= first"""
)
def diff_overlap(v: Views) -> DataFrame:
    rows = v.table("labels").join(v.files().select("doc_id", "path"), "doc_id")
    header = F.concat(F.lit("@@ -1,9 +"), 1 + F.col("quality") * 3, F.lit(","), 1 + F.col("toxic") * 2, F.lit(" @@ x"))
    hunks = rows.select("path", T.hunk(header).alias("h")).where("h is not null").select("path", "h.first", "h.last")
    units = v.lines().select("path", F.concat(F.lit("L"), "line").alias("unit"), "line", (F.col("line") + 2).alias("end_line"))
    return longs(C.changed_units(units, hunks))


_API = """api AS (SELECT 'f' || p_partkey AS qualname, p_partkey % 11 AS k, (p_size % 4)::INT AS n, list_slice(['a', 'b', 'c', 'd'], 1, (p_size % 4)::INT) AS bp,
    list_slice(['int', '', 'str', 'T'], 1, (p_size % 4)::INT) AS bt, list_slice([FALSE, FALSE, TRUE, TRUE], 1, (p_size % 4)::INT) AS bo, 'str' AS bret FROM part),
  w AS (SELECT *, CASE WHEN k IN (1, 2) THEN list_append(bp, 'z') WHEN k = 3 THEN bp[1:greatest(n - 1, 0)] WHEN k IN (4, 7) AND n > 0 THEN list_concat(['q'], bp[2:]) ELSE bp END AS ap,
      CASE WHEN k IN (1, 2) THEN list_append(bt, '') WHEN k = 3 THEN bt[1:greatest(n - 1, 0)] WHEN k IN (5, 7) AND n > 0 THEN list_concat(['float'], bt[2:]) WHEN k = 8 THEN list_transform(bt, lambda x: '') ELSE bt END AS at_,
      CASE WHEN k = 1 THEN list_append(bo, FALSE) WHEN k = 2 THEN list_append(bo, TRUE) WHEN k = 3 THEN bo[1:greatest(n - 1, 0)] WHEN k = 6 THEN list_transform(bo, lambda x: FALSE) ELSE bo END AS ao,
      CASE WHEN k = 9 THEN 'int' ELSE 'str' END AS aret FROM api WHERE k <> 0)"""


@query(
    f""", {_API} SELECT qualname, 'removed' AS broke, '' AS detail FROM api WHERE k = 0
    UNION ALL SELECT qualname, broke, detail FROM (SELECT qualname, CASE WHEN k = 1 THEN 'gained required' WHEN k = 3 AND n > 0 THEN 'dropped'
        WHEN k IN (5, 7) AND n > 0 THEN 'type' WHEN k = 4 AND n > 0 THEN 'renamed' WHEN k = 6 AND n >= 3 THEN 'became required' WHEN k = 9 THEN 'returns' END AS broke,
      CASE k WHEN 1 THEN 'z' WHEN 3 THEN bp[n] WHEN 5 THEN 'a: int -> float' WHEN 7 THEN 'a: int -> float' WHEN 4 THEN 'a -> q' WHEN 6 THEN 'c' WHEN 9 THEN 'str -> int' END AS detail FROM w) WHERE broke IS NOT NULL"""
)
def api_breaks(v: Views) -> DataFrame:
    n = (F.col("p_size") % 4).cast("int")
    of = lambda values: F.slice(F.array(*map(F.lit, values)), F.lit(1), n)
    p = v.table("part").select(
        F.concat(F.lit("f"), "p_partkey").alias("qualname"), (F.col("p_partkey") % 11).alias("k"), n.alias("n"),
        of("abcd").alias("params"), of(["int", "", "str", "T"]).alias("types"), of([False, False, True, True]).alias("optional"), F.lit("str").alias("returns"),
    )
    k, some, short = F.col("k"), F.col("n") > 0, F.greatest(F.col("n") - 1, F.lit(0))
    grown = lambda c, x: F.concat(c, F.array(F.lit(x)))
    first = lambda c, x: F.concat(F.array(F.lit(x)), F.slice(c, F.lit(2), short))
    params = F.when(k.isin(1, 2), grown("params", "z")).when(k == 3, F.slice("params", F.lit(1), short)).when(k.isin(4, 7) & some, first("params", "q")).otherwise(F.col("params"))
    types = F.when(k.isin(1, 2), grown("types", "")).when(k == 3, F.slice("types", F.lit(1), short)).when(k.isin(5, 7) & some, first("types", "float"))
    types = types.when(k == 8, F.transform("types", lambda _: F.lit(""))).otherwise(F.col("types"))
    optional = F.when(k == 1, grown("optional", False)).when(k == 2, grown("optional", True)).when(k == 3, F.slice("optional", F.lit(1), short))
    optional = optional.when(k == 6, F.transform("optional", lambda _: F.lit(False))).otherwise(F.col("optional"))
    after = p.where("k <> 0").select("qualname", params.alias("params"), types.alias("types"), optional.alias("optional"), F.when(k == 9, "int").otherwise("str").alias("returns"))
    return C.api_breaks(p.drop("k", "n"), after)


_KEYS = "keys AS (SELECT DISTINCT p_type AS resource, 'k' || p_partkey AS key, l_returnflag AS env FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _keys(v: Views) -> DataFrame:
    li, p = v.table("lineitem"), v.table("part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_type").alias("resource"), F.concat(F.lit("k"), "p_partkey").alias("key"), F.col("l_returnflag").alias("env"))


@query(f", {_KEYS} SELECT resource, key, count(*) AS n, string_agg(env, ',' ORDER BY env) AS found_in FROM keys GROUP BY ALL HAVING count(*) < (SELECT count(DISTINCT env) FROM keys)")
def env_drift(v: Views) -> DataFrame:
    return C.drift(_keys(v))


@query(f", {_KEYS} SELECT resource, key FROM keys GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT env) FROM keys)")
def env_everywhere(v: Views) -> DataFrame:
    return C.everywhere(_keys(v))


@query(f", refs AS ({_TEST_REFS}) SELECT path, unit, metric, value FROM broke WHERE string_split_regex(unit, '[.:]')[-1] NOT IN (SELECT name FROM refs)")
def untested(v: Views) -> DataFrame:
    return C.untested(v.broke(), _test_refs(v))


@query(
    """, f AS (SELECT DISTINCT path, 'gate' AS fact FROM broke JOIN metrics USING (metric) WHERE rung <= 2 UNION ALL SELECT DISTINCT path, 'suspicion' FROM broke JOIN metrics USING (metric) WHERE rung > 2
      UNION ALL SELECT DISTINCT path, 'cloned' FROM sites WHERE hash IN (SELECT hash FROM sites GROUP BY hash HAVING count(*) >= 2) UNION ALL SELECT DISTINCT path, 'debt' FROM lines_ WHERE regexp_matches(body, '[0-9]'))
    SELECT path, count(*) AS n, string_agg(fact, ',' ORDER BY fact) AS facts FROM f GROUP BY path HAVING count(*) >= 3"""
)
def tensions(v: Views) -> DataFrame:
    broke = v.broke().join(v.metrics().select("metric", "rung"), "metric")
    sites = v.sites()
    facts = {
        "broke": broke.where("rung is not null").withColumn("fact", F.when(F.col("rung") <= 2, "gate").otherwise("suspicion")),
        "cloned": sites.join(P.clone_classes(sites).select("hash"), "hash", "left_semi"), "debt": v.lines().where(F.col("body").rlike("[0-9]")),
    }
    return C.tensions(facts)


@query(
    """, d AS (SELECT hash, arg_min(path, (path, line)) AS p, arg_min(line, (path, line)) AS l FROM sites WHERE source NOT IN ('src0', 'src1') GROUP BY hash)
    SELECT s.path, s.line::BIGINT AS line, s.mass::BIGINT AS mass, d.p AS dep_path, d.l::BIGINT AS dep_line FROM sites s JOIN d USING (hash) WHERE s.source IN ('src0', 'src1') AND s.mass >= 5"""
)
def dep_straddle(v: Views) -> DataFrame:
    sites = v.sites()
    own = F.col("source").isin("src0", "src1")
    return longs(C.straddles(sites.where(own), sites.where(~own), least=5))


@query(rf""", d AS (SELECT {_DEP} AS path, p_size AS lines, (p_size % 5 = 0)::INT AS secrets, (p_size % 2)::INT AS suppressions FROM part), e AS (SELECT *, CASE WHEN path LIKE 'app/node_modules/@%' THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4)
      WHEN contains(split_part(path, '/', 3), '.') THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4) || '/' || split_part(path, '/', 5) ELSE split_part(path, '/', 3) END AS package FROM d)
    SELECT package, count(*) AS files, sum(lines)::BIGINT AS lines, sum(secrets)::BIGINT AS secrets, sum(suppressions)::BIGINT AS suppressions FROM e GROUP BY package""")
def dep_totals(v: Views) -> DataFrame:
    rows = v.table("part").select(_dep_path().alias("path"), F.col("p_size").alias("lines"), (F.col("p_size") % 5 == 0).cast("int").alias("secrets"), (F.col("p_size") % 2).alias("suppressions"))
    return C.dependency_totals(rows)


# -- sources, reports and streams -----------------------------------------------------


@query("SELECT 'ts' AS lang, count(*) AS files, sum(lines)::BIGINT AS lines FROM files")
def scan_sources(v: Views) -> DataFrame:
    """The lexing front-end over whole texts, as sources of a language that needs a lexer."""
    from ..sources import extract as X

    d = v.table("documents").where("text is not null")
    rows = d.select(F.concat(F.lit("d/"), "doc_id", F.lit(".ts")).alias("path"), F.lit("ts").alias("lang"), "text", F.lit(False).alias("is_test_file"), F.lit(False).alias("is_script_file"))
    return X.extract(rows).groupBy("lang").agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("lines"))


def _spread(v: Views, sources: DataFrame) -> DataFrame:
    """Parsing costs far more than moving: every core gets files, however few bytes they are."""
    return sources.repartition(2 * v.spark.sparkContext.defaultParallelism, "path")


def metric_closed_forms(v: Views) -> DataFrame:
    """Measurements of made sources: totals per target and pair of numbers that made the file."""
    from ..operators import measure
    from ..sources import extract as X

    at = F.split("path", "/")
    made_by = F.split(F.get(at, F.lit(1)), "_")
    targets = v.spark.createDataFrame([t[:3] for t in made.TARGETS], "file string, unit string, metric string")
    rows = measure.measurements(durable.cut(X.extract(_spread(v, made.sources(v.table("supplier"))))))
    rows = rows.withColumns({"file": F.get(at, F.lit(0)), "n": F.get(made_by, F.lit(0)).cast("long"), "m": F.get(made_by, F.lit(1)).cast("long")})
    counts = rows.join(F.broadcast(targets), ["file", "unit", "metric"]).groupBy("file", "unit", "metric", "n", "m")
    return counts.agg(F.countDistinct("path").alias("files"), F.round(F.sum(F.round("value", 6)), 4).alias("total"))


QUERIES["metric_closed_forms"] = lambda spark, sf_dir: metric_closed_forms(Views(spark, sf_dir))
ORACLES["metric_closed_forms"] = made.totals_sql()


def braced_closed_forms(v: Views) -> DataFrame:
    """Measurements of made sources in languages with braces, of the one function in each."""
    from ..operators import measure
    from ..sources import extract as X

    made_by = F.split(F.get(F.split("path", "/"), F.lit(1)), "_")
    targets = v.spark.createDataFrame([(lang, t[0]) for t in made.BRACED_TARGETS for lang in t[1].split()], "lang string, metric string")
    rows = measure.unit_measures(X.extract(_spread(v, made.braced(v.table("supplier"))))).where("unit <> '<module>'")
    rows = rows.withColumns({"n": F.get(made_by, F.lit(0)).cast("long"), "m": F.get(made_by, F.lit(1)).cast("long")})
    counts = rows.join(F.broadcast(targets), ["lang", "metric"]).groupBy("lang", "metric", "n", "m")
    return counts.agg(F.countDistinct("path").alias("files"), F.sum("value").alias("total"))


QUERIES["braced_closed_forms"] = lambda spark, sf_dir: braced_closed_forms(Views(spark, sf_dir))
ORACLES["braced_closed_forms"] = made.braced_sql()


@query("SELECT metric, measured, violated, rate FROM (SELECT metric, count(*) AS measured, count(*) FILTER (WHERE bad) AS violated, round(count(*) FILTER (WHERE bad) / count(*)::DOUBLE, 6) AS rate FROM (SELECT *, coalesce(value > hi, FALSE) OR coalesce(value < lo, FALSE) AS bad FROM banded) GROUP BY metric) WHERE violated > 0 ORDER BY rate DESC, metric LIMIT 5")
def brief_report(v: Views) -> DataFrame:
    from . import report

    return report.brief(v.banded())


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS changes, round(sum(value), 4) AS weight FROM events GROUP BY ALL")
def stream_churn(v: Views) -> DataFrame:
    from ..streaming import jobs

    return jobs.drain(jobs.windowed_churn(jobs.event_stream(v.spark, v.sf_dir, "events")), "complete")


@query("SELECT event_type AS metric, 'u' || user_id AS path, 'k' || user_id AS unit, max(value) AS value FROM events GROUP BY ALL")
def stream_ratchet(v: Views) -> DataFrame:
    from ..streaming import jobs

    e = jobs.event_stream(v.spark, v.sf_dir, "events")
    rows = e.select(F.col("event_type").alias("metric"), F.concat(F.lit("u"), "user_id").alias("path"), F.concat(F.lit("k"), "user_id").alias("unit"), "value")
    return jobs.drain(jobs.worst_so_far(rows), "complete")
