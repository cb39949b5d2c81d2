"""Import resolution by language: each import yields the paths it may name, best first.

Relative imports name exact paths. Dotted ones name a module by its path below a root: a module
answers to every dotted suffix of its path whose parent directory is not itself a package, so a
standard module never lands on a file of the same name inside a package. All matching is by
equality joins; candidates of an import are a handful, suffixes of a module as many as its
directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_SCRIPT = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]


def normalised(path: Column) -> Column:
    """A path without ``.`` and ``..``; what climbs above the top keeps nothing of it."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _joined(*parts) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _python(target: Column, folder: Column) -> Column:
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    rest = F.replace(F.substring(target, dots + 1, F.length(target)), F.lit("."), F.lit("/"))
    base = normalised(F.concat(folder, F.lit("/"), up, rest))
    return F.array(F.concat(base, F.lit(".py")), _joined(base, "__init__.py"))


def _rust(target: Column, path: Column, folder: Column) -> Column:
    parts = F.filter(F.split(target, "::"), lambda s: ~s.isin("", "*"))
    first, stem = F.get(parts, F.lit(0)), T.stem(path)
    src = F.regexp_extract(path, r"^(.*/src|src)/", 1)
    own = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(_joined(folder, stem))
    base = F.when(first == "crate", src).when(first == "self", own).when(first == "super", T.dir_of(own)).otherwise(src)
    names = F.when(first.isin("crate", "self", "super"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    # The last name may be a symbol of the module before it.
    shorter = F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    files = lambda ns: F.array(F.concat(_joined(base, F.array_join(ns, "/")), F.lit(".rs")), _joined(base, F.array_join(ns, "/"), "mod.rs"))
    root = F.array(_joined(base, "mod.rs"), F.concat(base, F.lit(".rs")), _joined(base, "lib.rs"), _joined(base, "main.rs"))
    return F.concat(files(names), F.when(F.size(shorter) > 0, files(shorter)).otherwise(root))


def candidates(lang: Column, path: Column, target: Column) -> Column:
    """Exact paths that an import may name, best first; empty where only a dotted name counts."""
    folder = T.dir_of(path)
    script = F.transform(F.array(*map(F.lit, _SCRIPT)), lambda e: F.concat(normalised(_joined(folder, target)), e))
    ruby = F.array(F.concat(normalised(_joined(folder, target)), F.lit(".rb")), normalised(_joined(folder, target)))
    return (
        F.when((lang == "py") & target.startswith("."), _python(target, folder))
        .when(lang.isin("ts", "tsx", "js") & target.startswith("."), script)
        .when((lang == "rs") & ~F.regexp_extract(target, "^[a-z]*", 0).isin("std", "core", "alloc"), _rust(target, path, folder))
        .when((lang == "rb") & target.startswith("."), ruby)
        .otherwise(F.array().cast("array<string>"))
    )


def dotted(lang: Column, target: Column) -> Column:
    """Dotted names that an absolute import may mean, the whole one first."""
    parts = F.split(target, r"\.")
    short = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), ".")
    # A Go import is a path below a host: any tail of it may be a directory here.
    tail = F.split(target, "/")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(tail), F.lit(2))), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    return (
        F.when((lang == "py") & ~target.startswith("."), F.array(target))
        .when(lang.isin("java", "scala", "cs") & ~target.rlike(r"^(java|javax|scala|System)(\.|$)"), F.array(target, short))
        .when((lang == "go") & F.get(tail, F.lit(0)).contains("."), tails)
        .otherwise(F.array().cast("array<string>"))
    )


def _named(modules: DataFrame) -> DataFrame:
    """(family, name, dst): the dotted names that each module answers to."""
    family = F.when(F.col("lang") == "py", "py").when(F.col("lang").isin("java", "scala", "cs"), "jvm").when(F.col("lang") == "go", "go")
    rows = modules.withColumn("family", family).where("family is not null")
    bare = F.regexp_replace("path", r"(/__init__)?\.[A-Za-z]+$", "")
    parts = F.split(F.when(F.col("family") == "go", T.dir_of(F.col("path"))).otherwise(bare), "/")
    suffix = lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("name"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("above"))
    named = rows.select("family", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), suffix)).alias("s")).select("family", "path", "s.name", "s.above")
    packages = modules.where(F.col("path").endswith("/__init__.py")).select(T.dir_of(F.col("path")).alias("above"), F.lit("py").alias("family")).distinct()
    rooted = named.join(packages, ["family", "above"], "left_anti")
    return rooted.groupBy("family", "name").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("dst"))


def resolve(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, ord, target, dst, kind) of (src, ord, lang, target) against (path, lang).

    kind is internal (with dst), unresolved (a relative import that names nothing here) or
    external.
    """
    lang, target = F.col("lang"), F.col("target")
    family = F.when(lang.isin("java", "scala", "cs"), "jvm").otherwise(lang)
    exact = imports.select("src", "ord", F.posexplode(candidates(lang, F.col("src"), target)).alias("at", "dst"))
    exact = exact.join(modules.select(F.col("path").alias("dst")), "dst").where("dst <> src").select("src", "ord", "at", "dst")
    loose = imports.select("src", "ord", family.alias("family"), F.posexplode(dotted(lang, target)).alias("at", "name"))
    loose = loose.join(_named(modules), ["family", "name"]).select("src", "ord", "at", "dst")
    best = exact.unionByName(loose).groupBy("src", "ord").agg(F.min(F.struct("at", "dst")).alias("b")).select("src", "ord", "b.dst")
    relative = target.startswith(".") | ((lang == "rs") & target.rlike("^(crate|self|super)(::|$)"))
    kind = F.when(F.col("dst").isNotNull(), "internal").when(relative, "unresolved").otherwise("external")
    return imports.join(best, ["src", "ord"], "left").select("src", "ord", "target", "dst", kind.alias("kind"))
