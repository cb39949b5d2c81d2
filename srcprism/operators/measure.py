"""Facts to measurements: every metric as an expression, guarded where it is not measured.

A metric that a file or unit cannot be judged by has no row, so it never enters a denominator.
Each level (file, unit, comment, class, interface) is exploded once from an array of metric
rows: one pass over the facts, no union of scans per metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import brace_front
from ..sources.files import low_confidence

JUNK = set(
    "bar baz common data foo func function generic handle handler handlers helper helpers impl info manager managers method misc obj process stuff temp thing things tmp util utils val wrapper".split()
)
CRUSHED = set(
    "arg attr buf bufr calc cfg cmd cnt conv ctx curr dest dst elem err func idx impl init mgr msg num obj opts params pos prev ptr ref req res resp src str tmp usr val".split()
)
DOC_METRIC = {"ModuleHeader": "module doc", "TypeDoc": "type doc", "FnSummary": "fn doc", "FieldDoc": "field doc", "Inline": "inline doc"}
#: Languages whose front-end has a syntax tree.
TREES = ("py",)
_ALL = " ".join(brace_front.LANGS)
_CATCH = "ts tsx js java cs cpp php scala"
#: What the front-end for braces tells, and of which languages.
BRACED = dict.fromkeys(
    (
        "cognitive", "cyclomatic", "depth", "loop depth", "length", "params", "flag params", "magic numbers", "negations", "and name", "generic name", "lying name",
        "abbreviated", "test asserts", "sleepy test", "asserts", "public docs", "untyped params", "loose types", "confusable", "stringly id", "bool traps",
    ),
    _ALL,
) | {"swallowed": _CATCH, "broad catch": "java cs cpp php", "casts": "ts tsx rs", "wildcard match": "rs go ts tsx js java cs c cpp cu swift scala php sol", "returns": "go rs swift", "unwraps": "rs go swift zig"}
TYPED = ("py", "ts", "tsx", "rs", "go", "java", "cs", "swift", "scala", "php")


def measurable(facts: DataFrame) -> DataFrame:
    return facts.where(~low_confidence(F.col("parse_errors"), F.col("mass"), F.col("too_deep")))


def _rows(values: dict[str, tuple[Column, Column | None]]) -> Column:
    """An array of (metric, value) without those whose guard fails."""
    each = [F.struct(F.lit(m).alias("metric"), F.when(guard, v.cast("double")).alias("value") if guard is not None else v.cast("double").alias("value")) for m, (v, guard) in values.items()]
    return F.explode(F.filter(F.array(*each), lambda r: r["value"].isNotNull())).alias("m")


def unit_measures(facts: DataFrame) -> DataFrame:
    u = measurable(facts).select("path", "lang", "is_test_file", "is_script_file", F.explode("units").alias("u"))
    f = lambda name: F.col(f"u.{name}")
    c = lambda name: F.col(f"u.counts.{name}")
    inner, test = ~f("is_module"), f("is_test") | F.col("is_test_file")
    plain, named = inner & ~test, f("named_test")
    words = T.name_words(f("name"))
    params = f("params")
    count = lambda test: F.size(F.filter(params, test))
    typed = F.col("lang").isin(*TYPED) & inner
    boolish_name = F.get(words, F.lit(0)).isin("is", "has", "can", "should")
    known = F.transform(params, lambda p: F.lower(p["name"]))
    stated = F.transform(f("documented"), F.lower)
    splat = F.exists(params, lambda p: p["splat"])
    unknown = F.array_except(stated, known)
    values = {
        "cognitive": (c("cognitive"), None), "cyclomatic": (c("cyclomatic"), None), "depth": (c("max_vis_depth"), None),
        "expr depth": (c("max_expr_depth"), None), "negations": (c("negations"), None), "loop depth": (c("max_loop_depth"), None),
        "alloc in loop": (c("allocs_in_loop"), None), "length": (f("lines"), inner), "params": (F.size(params), inner),
        "flag params": (count(lambda p: p["boolish"]), inner), "live span": (c("max_live_span"), inner), "returns": (c("return_arity"), inner),
        "demeter": (c("demeter"), ~test), "magic numbers": (c("magic_numbers"), ~test), "pass-through": (f("pass_through").cast("int"), inner),
        "kw opacity": (F.exists(params, lambda p: p["kw_splat"]).cast("int"), f("is_public")),
        "and name": (F.array_contains(words, "and").cast("int"), inner & ~named),
        "generic name": ((F.size(words) > 0).cast("int") * F.forall(words, lambda w: w.isin(*JUNK)).cast("int"), inner & ~named),
        "feature envy": (F.when((c("envy_count") >= 4) & (c("envy_count") > c("self_accesses")), c("envy_count")).otherwise(0), f("is_method")),
        "swallowed": (c("swallowed"), inner), "broad catch": (c("broad_catch"), inner), "lost context": (c("lost_context"), inner),
        "unawaited coroutine": (c("unawaited"), inner), "casts": (c("casts"), plain), "wildcard match": (c("wildcard_matches"), inner),
        "lying name": ((boolish_name & (f("returns") != "") & ~T.promises_a_boolean(F.col("lang"), f("returns"))).cast("int"), inner & ~named),
        "test asserts": (c("assert_calls"), named), "vacuous asserts": (c("vacuous_asserts"), named), "sleepy test": (c("sleep_calls"), named),
        "asserts": (c("assert_calls"), c("cognitive") >= 10), "public docs": ((c("doc_lines") > 0).cast("int"), f("is_public")),
        "untyped params": (count(lambda p: ~p["typed"] & ~p["splat"]), typed), "loose types": (count(lambda p: p["loose"]), typed),
        "confusable": (T.confusable_run(F.transform(params, lambda p: p["type_name"])), typed),
        "stringly id": (count(lambda p: T.stringly_id(p["name"], p["type_name"])), typed),
        "terse name": (F.when((F.length(f("live_var")).between(1, 2)) & (c("max_live_span") >= 12), c("max_live_span")).otherwise(0), inner),
        "abbreviated": (F.size(F.filter(words, lambda w: w.isin(*CRUSHED))), inner & ~named),
        "blocking async": (c("blocking_calls"), plain & ~F.col("is_script_file")), "dropped tasks": (c("dropped_tasks"), plain),
        "repurposed": (c("repurposed"), f("is_module") | ~test), "bool traps": (c("bool_traps"), plain),
        "ceremony": ((f("literal_body") & (c("doc_lines") >= 3)).cast("int"), inner & ~f("is_method") & ~test & (F.size(params) == 0)),
        "doc param": (F.size(unknown), inner & (F.size(stated) > 0) & ~(splat & (F.size(F.array_intersect(stated, known)) > 0))),
    }
    values["unwraps"] = (c("unwraps"), plain & F.col("lang").isin("rs", "go", "swift", "zig"))
    # A front-end that reads braces tells less than a tree: the rest has no row.
    tree = F.col("lang").isin(*TREES)
    told = {m: tree for m in values} | {m: tree | F.col("lang").isin(*langs.split()) for m, langs in BRACED.items()}
    values = {m: (v, told[m] if guard is None else told[m] & guard) for m, (v, guard) in values.items()}
    return u.select("path", "lang", f("line").alias("line"), f("qualname").alias("unit"), _rows(values)).select("path", "lang", "m.*", "line", "unit")


def file_measures(facts: DataFrame) -> DataFrame:
    rows = measurable(facts)
    # What only a syntax tree tells has no row where there is only a lexer.
    tree = F.col("lang").isin(*TREES)
    kinds = {
        "spooky": ("spooky", tree & ~F.col("is_test_file")), "suppressions": ("suppressions", None), "echo comments": ("echo", tree), "magic strings": ("magic_strings", tree),
        "skipped tests": ("skipped_tests", tree), "commented code": ("commented_code", tree), "built query": ("built_query", tree), "shelled out": ("shelled_out", tree),
    }
    leaked = F.filter("literals", lambda x: T.is_leaked_credential(x["name"], x["value"]))
    of_kind = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    sites = {m: (of_kind(k), g) for m, (k, g) in kinds.items()}
    sites["secrets"] = (leaked, None)
    ratio = F.col("comment_lines") / F.greatest(F.col("lines") - F.col("blank_lines"), F.lit(1))
    entry = lambda m, value, line, guard: F.struct(F.lit(m).alias("metric"), (F.when(guard, value) if guard is not None else value).cast("double").alias("value"), line.alias("line"))
    each = [entry(m, F.size(s), F.coalesce(F.array_min(F.transform(s, lambda x: x["line"])), F.lit(1)), g) for m, (s, g) in sites.items()]
    each.append(entry("comment ratio", ratio, F.lit(1), None))
    out = rows.select("path", "lang", F.explode(F.filter(F.array(*each), lambda r: r["value"].isNotNull())).alias("m"))
    return out.select("path", "lang", "m.metric", "m.value", "m.line", F.lit("").alias("unit"))


def part_measures(facts: DataFrame) -> DataFrame:
    """Words of comment runs, groups of classes, methods of interfaces."""
    rows = measurable(facts)
    role = F.element_at(F.create_map(*[F.lit(x) for p in DOC_METRIC.items() for x in p]), F.col("c.role"))
    docs = rows.select("path", "lang", F.explode("comments").alias("c")).select("path", "lang", role.alias("metric"), F.col("c.words").cast("double").alias("value"), "c.line", F.lit("").alias("unit")).where("metric is not null")
    cohesion = rows.where("not is_test_file").select("path", "lang", F.explode("classes").alias("c")).where("c.groups > 0")
    classes = cohesion.select("path", "lang", F.lit("cohesion").alias("metric"), F.col("c.groups").cast("double").alias("value"), "c.line", F.col("c.name").alias("unit"))
    wide = rows.select("path", "lang", F.explode("interfaces").alias("c"))
    interfaces = wide.select("path", "lang", F.lit("interface width").alias("metric"), F.col("c.methods").cast("double").alias("value"), "c.line", F.col("c.name").alias("unit"))
    return docs.unionByName(classes).unionByName(interfaces)


def measurements(facts: DataFrame) -> DataFrame:
    """(path, lang, metric, value, line, unit) of all metrics."""
    return unit_measures(facts).unionByName(file_measures(facts)).unionByName(part_measures(facts))
