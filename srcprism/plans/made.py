"""Python sources made from two small numbers a row, whose measurements have closed forms.

Each supplier gives four files by n = s_suppkey % 4 and m = s_suppkey % 5. ``TARGETS`` names, for each
metric, the file and unit that shows it and the value it must have: the same arithmetic in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _numbers() -> tuple[Column, Column]:
    return F.col("n"), F.col("m")


def _each(count: Column, row) -> Column:
    """``row(k)`` for k from 0 to count - 1, joined."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: row(k.cast("string")))
    return F.when(count > 0, F.array_join(rows, "")).otherwise("")


def _times(count: Column, text: str) -> Column:
    return F.repeat(F.lit(text), count)


def _list(count: Column, before: str, after: str) -> Column:
    """Names numbered from 0, joined by commas."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.concat(F.lit(before), k.cast("string"), F.lit(after)))
    return F.when(count > 0, F.array_join(rows, ", ")).otherwise("")


def _nested(count: Column, head: str) -> Column:
    rows = F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(F.repeat(F.lit("    "), k), F.lit(f"{head}\n")))
    return F.array_join(rows, "")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _main() -> Column:
    n, m = _numbers()
    inside = F.repeat(F.lit("    "), n + 2)
    return _text(
        '"""Alpha beta', _times(n, " gamma"), '."""\nimport copy\nimport time\n\n\nclass Box:\n    """Box doc', _times(m, " more"), '."""\n\n',
        _each(n + 2, lambda k: F.concat(F.lit("    def m"), k, F.lit("(self):\n        return self.a"), k, F.lit("\n\n"))),
        "    def envy(self, o):\n        return [o.b0, o.b1, o.b2, o.b3", _times(m, ", o.b"), "]\n\n\nclass Wide(Protocol):\n",
        _each(n + 1, lambda k: F.concat(F.lit("    def w"), k, F.lit("(self): ...\n"))),
        "\n\ndef deep(x):\n", _nested(n + 1, "if x:"), inside, "pass\n\n\ndef loops(x):\n", _nested(n + 1, "for i in x:"),
        F.repeat(F.concat(inside, F.lit("copy.deepcopy(x)\n")), m), inside, "pass\n\n\ndef long(x):\n", _times(m, "    x()\n"), "    return x\n\n\n",
        "def wide(", _list(m, "a", ""), "):\n    pass\n\n\ndef flags(", _list(n, "b", "=True"), "):\n    pass\n\n\ndef loose(", _list(m, "a", ": Any"),
        "):\n    pass\n\n\ndef alike(", _list(m, "k", ": int"), "):\n    pass\n\n\ndef ids(", _list(n, "u", "_id: str"), "):\n    pass\n\n\ndef tall(x):\n    return ",
        _times(n, "f("), "x", _times(n, ")"), "\n\n\ndef nots(x):\n", _times(m, "    x = not (x != 1)\n"), "    return x\n\n\ndef live():\n    v = 1\n",
        _times(m + 12, "    print()\n"), "    return v\n\n\ndef many():\n    return (1, 1", _times(m, ", 1"), ")\n\n\ndef chain(x):\n", _times(m, "    x.a.b.c()\n"),
        "    pass\n\n\ndef magic():\n", _times(m + 1, "    y = 77\n"), "\n\ndef passes(a):\n    return wide(a)\n\n\ndef opaque(**kw):\n    pass\n\n\n",
        "def load_and_save(x):\n    pass\n\n\ndef process(x):\n    pass\n\n\ndef quiet(x):\n", _times(m, "    try:\n        x()\n    except ValueError:\n        pass\n"),
        "    return x\n\n\ndef broad(x):\n", _times(n, "    try:\n        x()\n    except Exception:\n        x()\n"), "    return x\n\n\ndef lost(x):\n",
        _times(n, "    try:\n        x()\n    except ValueError:\n        raise KeyError(x)\n"), "    return x\n\n\ndef is_ready(x) -> str:\n    return x\n\n\n",
        "def cast_it(x):\n", _times(m, "    x = cast(int, x)\n"), "    return x\n\n\ndef ctx_cfg(x):\n    pass\n\n\nasync def waits():\n", _times(m, "    time.sleep(1)\n"),
        "    pass\n\n\ndef spawns(loop):\n", _times(n, "    loop.create_task(1)\n"), "    pass\n\n\nasync def coro():\n    pass\n\n\nasync def calls():\n",
        _times(n, "    coro()\n"), "    pass\n\n\ndef matched(x):\n    match x:\n        case 1:\n            pass\n        case _:\n            pass\n\n\n",
        "def traps(f):\n", _times(m, "    f(True, False)\n"), '    pass\n\n\ndef ceremony():\n    """One.\n\n    Two.\n    """\n    return 1\n\n\n',
        'def told(a):\n    """Say.\n\n    :param a: x\n', _each(n, lambda k: F.concat(F.lit("    :param z"), k, F.lit(": x\n"))), '    """\n    pass\n',
    )


def _test() -> Column:
    n, m = _numbers()
    return _text(
        "import time\n\n\ndef test_it(x):\n", _times(m, "    assert x == 1\n"), _times(n, "    assert True\n"), _times(n, "    time.sleep(1)\n"), "    pass\n",
        _each(n, lambda k: F.concat(F.lit("\n\n@pytest.mark.skip\ndef test_s"), k, F.lit("():\n    pass\n"))),
    )


def _notes() -> Column:
    n, m = _numbers()
    shared = F.concat(F.lit("("), _list(n, '"magic text ', '"'), F.lit(")"))
    return _text(
        '"""Head words."""\nimport os\n\nx = 1\n', _times(n, "y = 1  # noqa\n"), "# set the grand value", _times(m, " more"), "\nz = 1\n",
        _times(n, "# total price\ntotal_price = 1\n"), _times(m, "# a = foo(1)\n# b = bar(2)\nw = 1\n"),
        _each(n, lambda k: F.concat(F.lit("password"), k, F.lit(' = "q7w8e9r0t1y2u3i'), k, F.lit('"\n'))),
        '\n\ndef run(x):\n    """Word', _times(m, " word"), '."""\n', _times(n, "    eval(x)\n"), _times(m, "    os.system(x)\n"), _times(n, '    q = "select a from b where c = " + x\n'),
        "    return x\n\n\ndef one():\n    return ", shared, "\n\n\ndef two():\n    return ", shared, "\n\n\ndef three():\n    return ", shared, "\n",
    )


def _ratio() -> Column:
    n, m = _numbers()
    return _text(_times(n + 1, "# note\n"), _times(m + 1, "x = 1\n"))


FILES = {"main": _main, "test": _test, "notes": _notes, "ratio": _ratio}

#: file | unit | metric | total value | rows
TARGETS = [
    ("main", "deep", "cognitive", "(n + 1) * (n + 2) / 2"), ("main", "deep", "cyclomatic", "n + 2"), ("main", "deep", "depth", "n + 1"),
    ("main", "loops", "loop depth", "n + 1"), ("main", "loops", "alloc in loop", "m"), ("main", "loops", "depth", "n + 1"), ("main", "long", "length", "m + 2"),
    ("main", "wide", "params", "m"), ("main", "wide", "untyped params", "m"), ("main", "flags", "flag params", "n"), ("main", "loose", "loose types", "m"),
    ("main", "alike", "confusable", "m"), ("main", "alike", "untyped params", "0"), ("main", "ids", "stringly id", "n"), ("main", "tall", "expr depth", "n + 1"),
    ("main", "nots", "negations", "m"), ("main", "live", "live span", "m + 13"), ("main", "live", "terse name", "m + 13"), ("main", "many", "returns", "m + 2"),
    ("main", "chain", "demeter", "m"), ("main", "magic", "magic numbers", "m + 1"), ("main", "magic", "repurposed", "m"), ("main", "passes", "pass-through", "1"),
    ("main", "wide", "pass-through", "0"), ("main", "opaque", "kw opacity", "1"), ("main", "wide", "kw opacity", "0"), ("main", "load_and_save", "and name", "1"),
    ("main", "process", "generic name", "1"), ("main", "wide", "generic name", "0"), ("main", "Box.envy", "feature envy", "m + 4"), ("main", "quiet", "swallowed", "m"),
    ("main", "broad", "broad catch", "n"), ("main", "quiet", "broad catch", "0"), ("main", "lost", "lost context", "n"), ("main", "is_ready", "lying name", "1"),
    ("main", "cast_it", "casts", "m"), ("main", "ctx_cfg", "abbreviated", "2"), ("main", "waits", "blocking async", "m"), ("main", "spawns", "dropped tasks", "n"),
    ("main", "calls", "unawaited coroutine", "n"), ("main", "matched", "wildcard match", "1"), ("main", "traps", "bool traps", "m"), ("main", "ceremony", "ceremony", "1"),
    ("main", "told", "doc param", "n"), ("main", "told", "public docs", "1"), ("main", "wide", "public docs", "0"), ("main", "deep", "asserts", "CASE WHEN n = 3 THEN 0 END"),
    ("main", "Box", "cohesion", "n + 2"), ("main", "Wide", "interface width", "n + 1"), ("main", "", "module doc", "n + 2"), ("main", "", "type doc", "m + 2"),
    ("test", "test_it", "test asserts", "n + m"), ("test", "test_it", "vacuous asserts", "n"), ("test", "test_it", "sleepy test", "n"), ("test", "", "skipped tests", "n"),
    ("notes", "", "suppressions", "n"), ("notes", "", "echo comments", "n"), ("notes", "", "commented code", "m"), ("notes", "", "secrets", "n"), ("notes", "", "spooky", "n"),
    ("notes", "", "shelled out", "m"), ("notes", "", "built query", "n"), ("notes", "", "magic strings", "n"), ("notes", "", "inline doc", "4 + m + 2 * n + 6 * m"),
    ("notes", "", "fn doc", "m + 1"), ("ratio", "", "comment ratio", "round((n + 1) / (n + m + 2)::DOUBLE, 6)"), ("ratio", "", "module doc", "n + 1"),
]


#: Language | head of a function, its parameters, what opens and closes it | a condition | a number | a language's own row.
BRACED = {
    "ts": ("export function pick(", "a", ": any", "): number {", "}", "if (x && y) {", "    y = 77;", "    y = z as number;"),
    "js": ("const pick = (", "a", "", ") => {", "};", "if (x && y) {", "    y = 77;", ""),
    "go": ("package main\n\nfunc Pick(", "a", " interface{}", ") (int, error) {", "}", "if x && y {", "    y = 77", '    panic("no")'),
    "rs": ("pub fn pick(", "a", ": bool", ") -> u8 {", "}", "if x && y {", "    y = 77;", "    z.unwrap();"),
    "java": ("class Box {\npublic int pick(", "Object a", "", ") {", "}\n}", "if (x && y) {", "    y = 77;", "    try { z(); } catch (Exception e) { }"),
    "cs": ("class Box {\npublic int Pick(", "object a", "", ") {", "}\n}", "if (x && y) {", "    y = 77;", "    try { Z(); } catch { }"),
    "c": ("int pick(", "int a", "", ") {", "}", "if (x && y) {", "    y = 77;", "    f(true, false);"),
    "php": ("<?php\nfunction pick(", "$a", "", ") {", "}", "if ($x && $y) {", "    $y = 77;", "    try { z(); } catch (Throwable $e) { }"),
    "swift": ("public func pick(", "_ a", ": Any", ") -> Int {", "}", "if x && y {", "    y = 77", "    try! z()"),
    "scala": ("def pick(", "a", ": Any", "): Int = {", "}", "if (x && y) {", "    y = 77", ""),
    "zig": ("pub fn pick(", "a", ": bool", ") void {", "}", "if (x and y) {", "    y = 77;", "    unreachable;"),
}

#: Metric | languages | value, by n and m; a handler adds a branch to its unit.
_SOME = "ts js go rs java cs c php swift scala zig"
BRACED_TARGETS = [
    ("cognitive", "ts js go rs c swift scala zig", "(n + 1) * (n + 2) / 2 + (n + 1)"), ("cognitive", "java cs php", "(n + 1) * (n + 2) / 2 + (n + 1) + n"),
    ("cyclomatic", "ts js go rs c swift scala zig", "2 * n + 3"), ("cyclomatic", "java cs php", "3 * n + 3"), ("depth", _SOME, "n + 1"), ("params", _SOME, "m"),
    ("magic numbers", _SOME, "m"), ("loop depth", _SOME, "0"), ("untyped params", "ts go rs", "0"), ("untyped params", "php", "m"), ("untyped params", "java cs swift scala", "0"),
    ("loose types", "ts go java cs swift scala", "m"), ("flag params", "rs zig", "m"), ("flag params", "ts js java", "0"), ("casts", "ts", "n"), ("unwraps", "go rs swift zig", "n"),
    ("swallowed", "java cs php", "n"), ("broad catch", "java cs php", "n"), ("returns", "go", "2"), ("bool traps", "c", "n"), ("public docs", "ts go rs c java cs swift zig", "0"),
    ("length", "ts js go rs c php swift scala zig", "2 * n + 4 + m + n"),
]


def braced(rows: DataFrame) -> DataFrame:
    """One small file a supplier and language with braces, in the columns of ``sources``."""
    n, m = _numbers()
    files = []
    for lang, (head, before, after, opened, closed, condition, number, own) in BRACED.items():
        lines = [_times(m, f"{number}\n"), _times(n, f"{own}\n") if own else _times(n, "\n")]
        ends = F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda k: F.concat(F.repeat(F.lit("    "), n + 2 - k), F.lit("}\n"))), "")
        text = _text(head, _list(m, before, after), f"{opened}\n", _nested(n + 1, condition), ends, *lines, f"{closed}\n")
        files.append(F.struct(F.lit(lang).alias("kind"), text.alias("text")))
    rows = rows.select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("n"), (F.col("s_suppkey") % 5).cast("int").alias("m"))
    rows = rows.select("s_suppkey", "n", "m", F.explode(F.array(*files)).alias("f"))
    path = F.concat_ws("/", "f.kind", F.concat_ws("_", "n", "m"), F.concat_ws(".", "s_suppkey", "f.kind"))
    return rows.select(path.alias("path"), F.col("f.kind").alias("lang"), "f.text", F.lit(False).alias("is_test_file"), F.lit(False).alias("is_script_file"))


def braced_sql() -> str:
    each = [f"SELECT '{lang}' AS lang, '{metric}' AS metric, n, m, files, (files * ({value}))::DOUBLE AS total FROM p" for metric, langs, value in BRACED_TARGETS for lang in langs.split()]
    return f"""WITH p AS (SELECT (s_suppkey % 4)::BIGINT AS n, (s_suppkey % 5)::BIGINT AS m, count(*) AS files FROM supplier GROUP BY ALL) {" UNION ALL ".join(each)}"""


def sources(rows: DataFrame) -> DataFrame:
    """(path, lang, text, is_test_file, is_script_file) of all files of (s_suppkey)."""
    rows = rows.select("s_suppkey", (F.col("s_suppkey") % 4).cast("int").alias("n"), (F.col("s_suppkey") % 5).cast("int").alias("m"))
    # One pass over the suppliers: an array of files a row.
    files = F.array(*[F.struct(F.lit(kind).alias("kind"), make().alias("text")) for kind, make in FILES.items()])
    path = F.concat_ws("/", "f.kind", F.concat_ws("_", "n", "m"), F.concat("s_suppkey", F.lit(".py")))
    rows = rows.select("s_suppkey", "n", "m", F.explode(files).alias("f"))
    return rows.select(path.alias("path"), F.lit("py").alias("lang"), "f.text", (F.col("f.kind") == "test").alias("is_test_file"), F.lit(False).alias("is_script_file"))


def totals_sql() -> str:
    each = [f"SELECT '{f}' AS file, '{u}' AS unit, '{metric}' AS metric, n, m, files, round((files * ({value}))::DOUBLE, 4) AS total FROM p" for f, u, metric, value in TARGETS]
    return f"""WITH p AS (SELECT (s_suppkey % 4)::BIGINT AS n, (s_suppkey % 5)::BIGINT AS m, count(*) AS files FROM supplier GROUP BY ALL),
        x AS ({" UNION ALL ".join(each)}) SELECT * FROM x WHERE total IS NOT NULL"""
