"""The scan: files listed and read by Spark, their language, and the filters before parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRUNED = "__pycache__|dist|node_modules|target|third_party|vendor|\\.venv|venv"
DEPENDENCIES = "node_modules|site-packages|third_party|vendor|\\.venv|venv"

#: Languages by extension; a later table decides extensionless scripts by their first line.
EXTENSIONS = {
    "py": "py", "rs": "rs", "ts": "ts mts cts", "tsx": "tsx", "go": "go", "js": "js mjs cjs jsx", "zig": "zig", "lua": "lua",
    "rb": "rb rake gemspec", "pl": "pl pm t", "php": "php", "java": "java", "cs": "cs", "swift": "swift", "scala": "scala sc",
    "ex": "ex exs", "sol": "sol", "c": "c h", "ml": "ml mli", "sh": "sh bash", "cpp": "cpp cc cxx hpp hh hxx ipp inl", "cu": "cu cuh",
}
SHEBANGS = {"sh": "sh bash dash ksh zsh", "pl": "perl", "py": "python python2 python3", "rb": "ruby", "lua": "lua luajit"}
GENERATED = "@generated|do not edit|automatically generated|autogenerated|auto-generated|code generated by"


def read_files(spark: SparkSession, *roots: str, dependencies: bool = False) -> DataFrame:
    """(path, text) of every file under the roots; text is null where it is not UTF-8.

    Pruned folders are left out, or with ``dependencies`` they alone are kept.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    inside = F.col("path").rlike(f"(^|/)({DEPENDENCIES})/")
    kept = raw.where(inside) if dependencies else raw.where(~F.col("path").rlike(f"(^|/)({PRUNED})/"))
    return kept.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).dropDuplicates(["path"])


def language(path: Column, text: Column) -> Column:
    """Language by extension, else by the interpreter that a script names; null if unknown."""
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    table = {e: lang for lang, exts in EXTENSIONS.items() for e in exts.split()}
    by_ext = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), ext)
    program = F.regexp_extract(text, r"^#!\s*(?:\S*/)?(?:env\s+)?(?:\S*/)?([A-Za-z0-9.]+)", 1)
    scripts = {s: lang for lang, names in SHEBANGS.items() for s in names.split()}
    by_bang = F.element_at(F.create_map(*[F.lit(x) for pair in scripts.items() for x in pair]), program)
    cuda = text.rlike(r"\b__(constant|device|global|host|shared)__\b")
    cpp = text.rlike(r"(?m)^\s*(namespace |template ?<|(public|private|protected):|class [A-Za-z_])")
    header = F.when(cuda, "cu").when(cpp, "cpp").otherwise("c")
    base = F.regexp_extract(path, "[^/]*$", 0)
    linguist = (ext == "ts") & text.rlike(r"^\s*(<\?xml|<!DOCTYPE TS|<TS)")
    return F.when(linguist, F.lit(None)).when(ext == "h", header).when(ext != "", by_ext).when(~base.contains("."), by_bang)


def is_generated(text: Column) -> Column:
    """A marker opens a line of the first 1024 characters, or follows what opens a comment."""
    return F.lower(F.substring(text, 1, 1024)).rlike(rf"(?m)^\s*(({GENERATED})|[^a-z0-9\s].*({GENERATED}))")


def is_minified(path: Column, text: Column) -> Column:
    return path.rlike(r"\.min\.m?js$") & F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > 200)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|_tests?\.[a-z]+$|\.(test|spec)\.[a-z]+$|(^|/)conftest\.py$")


def is_script_path(path: Column) -> Column:
    names = "bench|benches|benchmark|benchmarks|build|ci|demo|demos|example|examples|fixtures|hack|script|scripts|tool|tools"
    return path.rlike(rf"(^|/)([^/]*[-_])?({names})/")


def low_confidence(errors: Column, mass: Column, too_deep: Column) -> Column:
    """Files whose parse says too little: counted, kept in the graph, not measured."""
    return too_deep | ((errors > 0) & ((mass == 0) | (errors * 200 > mass)))


def sources(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, lang, text, is_test_file, is_script_file): what a front-end is given."""
    rows = read_files(spark, *roots).where("text is not null").withColumn("lang", language(F.col("path"), F.col("text")))
    kept = rows.where(F.col("lang").isNotNull() & ~is_generated(F.col("text")) & ~is_minified(F.col("path"), F.col("text")))
    return kept.select("path", "lang", "text", is_test_path(F.col("path")).alias("is_test_file"), is_script_path(F.col("path")).alias("is_script_file"))


def git_log(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Commits (sha, at, author, file) from ``git log --numstat --format=%H%x09%at%x09%an``.

    ``lines`` (n, value): numbered lines of one log. A header and the files below it share the
    header's number, found by a running maximum inside blocks of lines.
    """
    from pyspark.sql.window import Window

    head = F.regexp_extract("value", "^([0-9a-f]{40})\t([0-9]+)\t(.*)$", 1)
    marked = lines.withColumn("sha", head).withColumn("block", F.floor(F.col("n") / 100_000))
    inside = Window.partitionBy("block").orderBy("n")
    state = F.struct("n", "sha", F.regexp_extract("value", "^[0-9a-f]{40}\t([0-9]+)\t", 1).cast("long").alias("at"), F.regexp_extract("value", "^[0-9a-f]{40}\t[0-9]+\t(.*)$", 1).alias("author"))
    seen = marked.withColumn("h", F.max(F.when(F.col("sha") != "", state)).over(inside))
    ends = marked.where("sha <> ''").groupBy("block").agg(F.max(state).alias("last"))
    carried = ends.select((F.col("block") + 1).alias("block"), "last")
    full = seen.join(carried, "block", "left").withColumn("h", F.coalesce("h", "last"))
    file = F.regexp_extract("value", "^[-0-9]+\t[-0-9]+\t(.+)$", 1)
    return full.where((F.col("sha") == "") & (file != "")).select("h.sha", "h.at", "h.author", file.alias("file"))
