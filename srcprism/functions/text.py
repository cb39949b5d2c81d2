"""Scalar functions as Column builders: everything stays inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verb families whose members name one operation.
SYNONYM_FAMILIES = [
    x.split()
    for x in (
        "fetch get load read retrieve",
        "put save set store write",
        "build construct create make",
        "delete destroy drop remove",
        "check ensure validate verify",
        "convert transform translate",
        "find locate lookup search",
        "begin launch spawn start",
        "abort cancel halt stop",
    )
]
VERBS = sorted(v for family in SYNONYM_FAMILIES for v in family)

PLACEHOLDER = "changeme|dummy|example|fake|fixture|mock|none|null|placeholder|redacted|sample|smoketest|stub|todo|xxx|your"
CREDENTIAL = (
    "access_?key|access_?token|api_?key|api_?token|auth_?token|auth_key|bearer|credential|passwd|password|private_key|refresh_token|secret"
)
#: Prefixes of keys that name their issuer, with the tail that a whole key has.
VENDOR = (
    r"(?:^|[^A-Za-z0-9])(?:(?:gh[opsu]_|github_pat_|glpat-|xox[abp]-|sk_live_|rk_live_|sk-ant-|npm_|AIza|hf_)[A-Za-z0-9_-]{12,}"
    r"|A[KS]IA[A-Z0-9]{16}(?:[^A-Z0-9]|$))"
)


def name_words(name: Column) -> Column:
    """Lower-case words of a name: cut at ``_ - .``, white space and camel humps."""
    cut = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.filter(F.split(F.lower(cut), r"[_\-. \t]+"), lambda w: w != "")


def own_name(qualname: Column) -> Column:
    return F.element_at(F.split(qualname, "[.:]"), -1)


def job_word(qualname: Column) -> Column:
    """The first word of a unit's own name; null if it has none."""
    return F.get(name_words(own_name(qualname)), F.lit(0))


def case_of(name: Column) -> Column:
    """Spelling of a name by its letters: the first rule that holds."""
    upper, lower, bar = name.rlike("[A-Z]"), name.rlike("[a-z]"), F.trim(name, F.lit("_")).contains("_")
    return (
        F.when(upper & ~lower, F.when(F.length(name) > 1, "screaming").otherwise("neutral"))
        .when(bar & ~upper, "snake")
        .when(upper & name.rlike("^_*[A-Z]"), "pascal")
        .when(upper, "camel")
        .otherwise("neutral")
    )


def split_synonym(name: Column) -> Column:
    """(verb, object) where the leading word is a verb that has synonyms and words follow."""
    words = name_words(name)
    verb = F.get(words, F.lit(0))
    known = verb.isin(VERBS) & (F.size(words) > 1)
    return F.when(known, F.struct(verb.alias("verb"), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), "_").alias("object")))


def entropy_share(counts: Column, kinds: int = 4) -> Column:
    """Entropy of an array of counts over the entropy of ``kinds`` equal ones; 0 below two."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    parts = F.aggregate(counts, F.lit(0.0), lambda a, c: F.when(c > 0, a - (c / total) * F.log2(c / total)).otherwise(a))
    return F.when(F.size(F.filter(counts, lambda c: c > 0)) < 2, F.lit(0.0)).otherwise(parts / F.log2(F.lit(float(kinds))))


def is_placeholder(value: Column) -> Column:
    return F.lower(value).rlike(PLACEHOLDER)


def vendor_key(value: Column) -> Column:
    """A value whose own shape says that it is a credential."""
    pem = value.contains("PRIVATE KEY-----") & (F.length(value) >= 60)
    login = value.rlike(r"://[^\s/?#:@]*:[^\s/?#@{$%<]{6,}@") & value.rlike(r"://[^\s/?#:@]*:[^\s/?#@]*([0-9]|[A-Z][^@]*[a-z]|[a-z][^@]*[A-Z])[^\s/?#@]*@")
    return pem | login | value.rlike(VENDOR)


def looks_like_a_key(value: Column) -> Column:
    """Digits and letters in a long run, without the marks of structure or interpolation."""
    base64 = value.rlike("^[A-Za-z0-9+/=]{20,}$")
    return (
        (F.length(value) >= 8)
        & ~value.rlike(r"[{$<\s%:.]")
        & ~value.startswith("/")
        & (~value.contains("/") | base64)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike("^[A-Z_]+[0-9]*$")
        & value.rlike("[A-Za-z0-9]{12,}")
    )


def is_leaked_credential(name: Column, value: Column) -> Column:
    return ~is_placeholder(value) & (vendor_key(value) | (F.lower(name).rlike(CREDENTIAL) & looks_like_a_key(value)))


def violates(value: Column, lo: Column, hi: Column) -> Column:
    """Strictly outside the band; an open side is never crossed."""
    return F.coalesce(value > hi, F.lit(False)) | F.coalesce(value < lo, F.lit(False))


def severity(value: Column, lo: Column, hi: Column) -> Column:
    """How far outside the band; null inside it and where the crossed bound is 0."""
    below = F.when((value < lo) & (lo != 0), (lo - value) / lo + 1)
    return F.when(value > hi, F.when(hi != 0, value / hi)).otherwise(below)


def band_label(lo: Column, hi: Column) -> Column:
    def number(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), "0+$", ""), r"\.$", "")

    return (
        F.when(lo.isNotNull() & hi.isNotNull(), F.concat(number(lo), F.lit("-"), number(hi)))
        .when(hi.isNotNull(), F.concat(F.lit("<="), number(hi)))
        .when(lo.isNotNull(), F.concat(F.lit(">="), number(lo)))
        .otherwise(F.lit(""))
    )


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def package_of(path: Column) -> Column:
    """The dependency that a path under a dependency folder belongs to."""
    inside = F.regexp_extract(path, r"^(?:.*/)?(?:node_modules|vendor|third_party|venv|\.venv|site-packages)/(.*)$", 1)
    scoped = F.regexp_extract(inside, r"^(@[^/]+/[^/]+)", 1)
    dotted = F.regexp_extract(inside, r"^([^/]*\.[^/]*/[^/]+/[^/]+)/", 1)
    return F.when(scoped != "", scoped).when(dotted != "", dotted).otherwise(F.regexp_extract(inside, r"^([^/]+)", 1))


def environment_of(path: Column) -> Column:
    return F.regexp_extract(path, r"values[-_.]([A-Za-z0-9_-]+)\.ya?ml$", 1)


def promises_a_boolean(lang: Column, returns: Column) -> Column:
    word = F.lower(returns).rlike(r"\b(bool|boolean)\b")
    return word | (lang.isin("ts", "tsx") & returns.rlike(r"\bis\b")) | ((lang == "c") & (returns == "int"))


def stringly_id(name: Column, type_name: Column) -> Column:
    named = name.rlike("(^|_)(guid|handle|id|key|token|uuid)$")
    return named & F.regexp_replace(type_name, "&('static )?", "").isin("str", "string", "String", "text")


def confusable_run(types: Column) -> Column:
    """Length of the longest run of equal, adjacent, stated types."""
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(t == "", 0).when(t == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(types, state, step, lambda a: a["best"])


def hunk(line: Column) -> Column:
    """(first, last) new-side lines of a unified diff's hunk header; null for deletions."""
    at = F.regexp_extract(line, r"^@@ [^+]*\+([0-9]+)(?:,([0-9]+))? @@", 1)
    count = F.regexp_extract(line, r"^@@ [^+]*\+[0-9]+,([0-9]+) @@", 1)
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    first = at.cast("int")
    return F.when((at != "") & (n > 0), F.struct(first.alias("first"), (first + n - 1).alias("last")))


def parts(text: Column) -> Column:
    """Lines of a text without the empty piece after a final line break."""
    lines = F.split(text, "\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
