"""The front-ends on small files: scores, guards, detectors, containers, sources, reports."""

import json

from pyspark.sql import functions as F

from srcprism.operators import budgets, measure, rank, registry
from srcprism.plans import report
from srcprism.sources import containers, extract, files, python_front

SCORED = '''
def pick(items, limit):
    """Pick.

    :param items: some
    :param depth: none such
    """
    for item in items:
        if item > limit and item:
            return 1
        elif item:
            return 2
        else:
            return 3
'''
SEEDED = '''
import os, time, requests
from typing import Any

api_key = "sk_live_9f8a7b6c5d4e3f2a1b0c"

class Cart:
    def total(self): return self.items
    def count(self): return self.items
    def owner(self): return self.name

def get_user(user_id: str, flag=False, **kw: Any) -> int:
    # fetch the user
    user = fetch(user_id)
    try:
        return user.account.owner.name.first, 1, 2, 3
    except Exception:
        pass

async def work(path):
    requests.get(path)
    time.sleep(3)
    work2()

async def work2():
    return eval("1")

def run(q, name):
    os.system("rm " + name)
    return q.execute(f"SELECT * FROM users WHERE id = {name}")

def is_open(x) -> str:
    return send(x)

def send(x):
    return deliver(x)
    # y = compute(1)
    # z = compute(y)

def data_helper(a, b, c):
    t = 1
    t = 2
    return t  # noqa
'''


def rows(spark, *texts):
    df = spark.createDataFrame([(p, "py", t, "test" in p, False) for p, t in texts], "path string, lang string, text string, is_test_file boolean, is_script_file boolean")
    return extract.extract(df)


def values(spark, text, path="a.py"):
    out = {}
    for r in measure.measurements(rows(spark, (path, text))).collect():
        out.setdefault(r.metric, {})[r.unit] = r.value
    return out


def test_worked_score(spark):
    v = values(spark, SCORED)
    assert (v["cognitive"]["pick"], v["cyclomatic"]["pick"], v["depth"]["pick"], v["params"]["pick"]) == (6, 5, 2, 2)
    assert v["doc param"]["pick"] == 1
    assert "length" not in v or "<module>" not in v["length"]


def test_detectors_find_what_is_seeded(spark):
    v = values(spark, SEEDED)
    at_least = {
        "secrets": 1, "spooky": 1, "shelled out": 1, "built query": 1, "suppressions": 1, "echo comments": 1, "commented code": 1, "comment ratio": 0.01,
        "swallowed": 1, "broad catch": 1, "demeter": 1, "blocking async": 2, "unawaited coroutine": 1, "flag params": 1, "kw opacity": 1, "loose types": 1,
        "stringly id": 1, "returns": 4, "lying name": 1, "pass-through": 1, "generic name": 1, "repurposed": 1, "cohesion": 2, "untyped params": 1,
    }
    missing = {m: v.get(m) for m, least in at_least.items() if sum(v.get(m, {}).values()) < least}
    assert not missing


def test_quiet_on_plain_code(spark):
    v = values(spark, "def add(left: int, right: int) -> int:\n    return left + right\n")
    loud = {m: u for m, u in v.items() if sum(u.values()) and m not in ("cyclomatic", "length", "params", "expr depth", "confusable")}
    assert not loud


def test_broken_and_deep_files_are_counted_not_measured(spark):
    deep = "x = " + "-" * 400 + "1\n"
    facts = rows(spark, ("bad.py", "def (:\n"), ("deep.py", deep), ("ok.py", "x = 1\n"))
    assert {r.path for r in facts.where("parse_errors > 0 or too_deep").collect()} >= {"bad.py"}
    assert {r.path for r in measure.unit_measures(facts).select("path").distinct().collect()} <= {"ok.py", "deep.py"}


def test_clone_sites_ignore_names(spark):
    body = "def {n}(rows):\n    total = 0\n    for row in rows:\n        if row.price > 3 and row.count < 9:\n            total += row.price * row.count\n    return total\n"
    facts = rows(spark, ("a.py", body.format(n="one")), ("b.py", body.replace("total", "sum_").format(n="two")))
    sites = facts.select("path", F.explode("sites").alias("s")).select("path", "s.hash")
    assert sites.groupBy("hash").agg(F.countDistinct("path").alias("n")).where("n = 2").count() >= 1


def test_documented_names_in_three_conventions():
    assert python_front.documented(":param int a: x\n:param b: y") == ["a", "b"]
    assert python_front.documented("Do.\n\nArgs:\n    a: x\n    b (int): y\n        more: z\n") == ["a", "b"]
    assert python_front.documented("Parameters\n----------\na : int\n    x\nb : str\n") == ["a", "b"]


def test_containers_keep_lines():
    cells = {"cells": [{"cell_type": "markdown", "source": ["x\n"]}, {"cell_type": "code", "source": ["a = 1\n", "%magic\n", "b = 2"]}]}
    text = json.dumps(cells, indent=1)
    lang, code = containers.unwrap("n.ipynb", text)
    placed = [(i, c) for i, c in enumerate(code.split("\n")) if c]
    assert lang == "py" and [c for _, c in placed] == ["a = 1", "b = 2"]
    assert all(c in text.split("\n")[i] for i, c in placed)
    assert containers.unwrap("n.ipynb", "{") is None
    lang, code = containers.unwrap("c.vue", "<template/>\n<script lang=\"ts\">\nlet a = 1\n</script>\n")
    assert lang == "ts" and code.split("\n")[2] == "let a = 1"
    flow = "on: push\njobs:\n  a:\n    steps:\n      - run: |\n          echo ${{ x }}\n      - run: make\n      - uses: y\n"
    assert containers.unwrap(".github/workflows/a.yml", flow)[1].split("\n")[5:7] == ["          echo ________", "make"]
    assert containers.dockerfile('FROM x\nRUN a \\\n  && b\nRUN ["c"]\nENV k=v\n').split("\n")[:5] == ["", "a \\", "  && b", "", "k=v"]
    assert containers.workflow("on: push\n") is None


def test_scan_reads_filters_and_names_languages(spark, tmp_path):
    put = {
        "a.py": "x = 1\n", "node_modules/p/b.js": "x\n", "gen.py": "# Code generated by x\n", "run": "#!/usr/bin/env bash\necho\n", "q.ts": "<?xml?>\n",
        "h.h": "namespace a {\n}\n", "k.h": "int x;\n", "m.min.js": "x" * 300, "n.txt": "x",
    }
    for name, text in put.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    got = {r.path.rsplit("/", 1)[1]: r.lang for r in files.sources(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "py", "run": "sh", "h.h": "cpp", "k.h": "c"}
    assert files.read_files(spark, str(tmp_path)).where("text is null").count() == 1
    deps = files.read_files(spark, str(tmp_path), dependencies=True).collect()
    assert [r.path.rsplit("/", 1)[1] for r in deps] == ["b.js"]


def test_git_log_is_split_at_its_headers(spark):
    log = ["a" * 40 + "\t100\tann", "", "1\t2\tx.py", "-\t-\tb.bin", "b" * 40 + "\t200\tbob", "", "3\t0\tx.py"]
    df = spark.createDataFrame(list(enumerate(log)), "n long, value string")
    assert sorted((r.sha[0], r["at"], r.author, r.file) for r in files.git_log(spark, df).collect()) == [("a", 100, "ann", "b.bin"), ("a", 100, "ann", "x.py"), ("b", 200, "bob", "x.py")]


def test_lexer_measures_no_units(spark):
    df = spark.createDataFrame([("a.lua", "lua", '-- TODO: x\nrequire "fmt"\n\napiKey = "abcdef1234567890abcd"\n', False, False)], "path string, lang string, text string, is_test_file boolean, is_script_file boolean")
    facts = extract.extract(df)
    r = facts.first()
    assert (r.lines, r.blank_lines, r.comment_lines, len(r.units), r.imports[0].target) == (4, 1, 1, 0, "fmt")
    seen = {x.metric: x.value for x in measure.measurements(facts).collect()}
    assert "cognitive" not in seen and seen["secrets"] == 1
    # What a lexer cannot tell has no row, not a row of 0.
    assert not seen.keys() & {"spooky", "echo comments", "magic strings", "skipped tests", "commented code", "built query", "shelled out"}


def test_reports(spark):
    metrics = registry.metrics(spark)
    assert metrics.count() == 62
    facts = rows(spark, ("src/a.py", SEEDED), ("src/b.py", SCORED))
    bands = metrics.select(F.lit("").alias("scope"), F.lit(None).cast("string").alias("lang"), "metric", "lo", "hi")
    banded = budgets.banded(measure.measurements(facts), bands).persist()
    broke = rank.violations(banded)
    log = json.loads(report.sarif(broke, metrics))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == broke.count()
    assert {r["level"] for r in log["runs"][0]["results"]} <= {"error", "warning", "note"}
    head = report.summary(banded, facts.select("lang", "lines"), metrics)
    pooled = {r["metric"]: r["violated"] for r in head["metrics"] if r["total"]}
    assert sum(pooled.values()) == broke.count()
    assert all(json.loads(r[0])["metric"] for r in report.findings(broke, metrics).collect())
    assert report.brief(banded).count() == 5 and report.explain(banded, "src/b.py", 2).count() > 5
    tsv = report.facts_tsv(facts).collect()
    assert {r.row for r in tsv} == {"file", "ffact", "unit", "call"} and all(r.value != "0" for r in tsv)
    assert report.context(banded, ["length"]).first().n == 11


def picked(head, loop, bare=False, before="", after="", both="&&"):
    left, right = ("", "") if bare else ("(", ")")
    return (
        f"{before}{head} {{\n    {loop} {{\n        if {left}row < most {both} row > 1{right} {{\n            keep(row);\n        }} else if {left}row > most{right} {{\n"
        f"            lose(row);\n        }} else {{\n            break;\n        }}\n    }}\n    return kept;\n}}\n{after}"
    )


PICKS = {
    "ts": picked("export function pick(rows: number[], most: number): number", "for (const row of rows)"), "js": picked("const pick = (rows, most) =>", "for (const row of rows)"),
    "rs": picked("pub fn pick(rows: Vec<i64>, most: i64) -> i64", "for row in rows", True), "go": picked("func Pick(rows []int64, most int64) int64", "for _, row := range rows", True, "package p\n"),
    "zig": picked("fn pick(rows: []const i64, most: i64) i64", "for (rows) |row|", both="and"), "c": picked("long pick(const long *rows, long most)", "for (int i = 0; rows[i]; i++)"),
    "cpp": picked("long pick(const std::vector<long>& rows, long most)", "for (long row : rows)"), "java": picked("public long pick(List<Long> rows, long most)", "for (long row : rows)", before="class A {\n", after="}\n"),
    "cs": picked("public long Pick(List<long> rows, long most)", "foreach (var row in rows)", before="class A {\n", after="}\n"), "swift": picked("func pick(_ rows: [Int], most: Int) -> Int", "for row in rows", True),
    "scala": picked("def pick(rows: Seq[Int], most: Int): Int =", "for (row <- rows)"), "php": picked("function pick($rows, $most)", "foreach ($rows as $row)", before="<?php\n"),
    "sol": picked("function pick(uint[] rows, uint most) public returns (uint)", "for (uint i = 0; i < n; i++)", before="contract A {\n", after="}\n"),
}


def units_of(lang, text, is_test=False):
    return {u["qualname"]: u for u in extract.facts_of(f"a.{lang}", lang, text, is_test, False)["units"]}


def test_one_function_scores_alike_in_every_language_with_braces():
    for lang, text in PICKS.items():
        units = units_of(lang, text)
        u = next(v for k, v in units.items() if k != "<module>")
        c = u["counts"]
        assert (c["cognitive"], c["cyclomatic"], c["max_vis_depth"], c["max_loop_depth"], u["lines"]) == (6, 5, 2, 1, 12), lang
        assert [p["name"] for p in u["params"]] == ["rows", "most"] and len(units) == 2, lang


def test_units_of_languages_with_braces():
    ts = """class Cart {
  constructor(private readonly items: Item[], flag = false) { this.items = items; }
  async total(by?: string): Promise<number> { return by ? this.items.map(x => { if (x) { return x; } return 0; }).length : 0; }
}
export const open = async (id: string) => { while (id) if (id !== "") id = next(id); };
interface Shape { area(): number; name(x: string): void }
"""
    u = units_of("ts", ts)
    assert set(u) == {"<module>", "Cart.constructor", "Cart.total", "open"}
    assert [(p["name"], p["boolish"], p["optional"]) for p in u["Cart.constructor"]["params"]] == [("items", False, False), ("flag", True, True)]
    assert u["Cart.total"]["counts"]["cyclomatic"] == 3 and u["Cart.total"]["params"][0]["optional"]
    assert u["open"]["is_public"] and u["open"]["counts"]["max_vis_depth"] == 2 and u["open"]["counts"]["cognitive"] == 3
    assert extract.facts_of("a.ts", "ts", ts, False, False)["interfaces"] == [{"name": "Shape", "line": 6, "methods": 2}]
    rs = "struct A;\nimpl A {\n    /// Says.\n    pub fn go<'a>(&self, x: &'a str) -> (u8, u8) {\n        match x { \"a\" => 1, _ => self.b().unwrap() as u8 };\n        (1, 2)\n    }\n}\n"
    go = units_of("rs", rs)["A.go"]
    assert (go["counts"]["cyclomatic"], go["counts"]["wildcard_matches"], go["counts"]["unwraps"], go["counts"]["casts"], go["counts"]["return_arity"], go["counts"]["doc_lines"]) == (3, 1, 1, 1, 2, 1)
    assert [p["name"] for p in go["params"]] == ["x"] and go["is_public"] and go["is_method"]
    got = units_of("go", "func (s *Srv) Run(a, b int, ok bool) (int, error) {\n    switch a {\n    case 1:\n        return 1, nil\n    default:\n        panic(1)\n    }\n}\n")["Run"]
    assert [(p["name"], p["type_name"]) for p in got["params"]] == [("a", "int"), ("b", "int"), ("ok", "bool")]
    assert (got["counts"]["cyclomatic"], got["counts"]["unwraps"], got["counts"]["return_arity"], got["counts"]["wildcard_matches"]) == (2, 1, 2, 1)
    java = "class A {\n  A(int n) { if (n > 3) do { n--; } while (n > 0 && ok); }\n  int f() { try { g(true, false); } catch (Exception e) { } return x ? 5 : 1; }\n  abstract int h(int a);\n}\n"
    u = units_of("java", java)
    assert set(u) == {"<module>", "A.A", "A.f"}
    assert u["A.A"]["counts"]["cyclomatic"] == 4 and u["A.A"]["counts"]["max_loop_depth"] == 1
    f = u["A.f"]["counts"]
    assert (f["swallowed"], f["broad_catch"], f["bool_traps"], f["magic_numbers"], f["cyclomatic"]) == (1, 1, 1, 1, 3)
    assert units_of("c", "static int f(void);\n#define X(a) {\nint g(int a[N], char *b) { return a[0]; }\n")["g"]["params"][0]["name"] == "a"
    broken = extract.facts_of("a.go", "go", "func f( {\n", False, False)
    assert broken["parse_errors"] > 0


def test_every_metric_that_a_front_end_tells_has_a_closed_form():
    from srcprism.plans import made

    assert {m for m, *_ in registry.rows()} - {t[2] for t in made.TARGETS} - {t[0] for t in made.BRACED_TARGETS} == {"conditional hook", "field doc"}


def test_ratchet_follows_the_direction_of_a_metric(spark):
    from srcprism.operators import gates

    metrics = spark.createDataFrame([("up", None, 1.0), ("down", 1.0, None), ("band", 0.1, 0.9)], "metric string, lo double, hi double")
    row = "metric string, path string, unit string, value double"
    ledger = spark.createDataFrame([("up", "a", "u", 2.0), ("down", "a", "u", 0.5), ("band", "a", "u", 0.5), ("down", "old", "v", 0.5), ("down", "gone", "v", 0.2), ("up", "a", "n", None)], row)
    now = [("up", "a", "u", 3.0), ("down", "a", "u", 0.0), ("band", "a", "u", 5.0), ("down", "b", "v", 0.3), ("up", "a", "n", 9.0), ("up", "b", "x", 1.0), ("down", "c", "v", 0.1)]
    current = spark.createDataFrame(now, row)
    got = {(r.metric, r.path, r.unit): (r.was, r.why) for r in gates.ratchet(current, ledger, current, metrics).collect()}
    assert got == {("up", "a", "u"): (2.0, "worse"), ("down", "a", "u"): (0.5, "worse"), ("up", "b", "x"): (None, "new"), ("down", "c", "v"): (0.2, "worse")}


def test_totals_keep_a_null_language_apart(spark):
    from srcprism.operators import aggregate

    df = spark.createDataFrame([("m", None, 2.0), ("m", "py", 0.0)], "metric string, lang string, value double").withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(1.0)})
    got = sorted(((r.lang, r.total, r.measured, r.violated) for r in aggregate.measured_violated(df).collect()), key=repr)
    assert got == sorted([(None, 0, 1, 1), ("py", 0, 1, 0), (None, 1, 2, 1)], key=repr)


def test_state_round_trips(spark, tmp_path):
    from srcprism.sources import state

    pins = state.calibration(spark, '[py]\n"length" = { hi = 76.0 }\n"comment ratio" = { lo = 0.0, hi = 0.47 }\n[go]\n"params" = { hi = 4 }\n')
    assert sorted(map(tuple, state.calibration(spark, state.calibration_text(pins)).collect())) == sorted(map(tuple, pins.collect()))
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "srcprism.toml").write_text('[budgets]\n"length" = { hi = 90 }\n')
    (tmp_path / "a" / "b" / "srcprism.toml").write_text('[budgets]\n"params" = { hi = 9 }\n')
    over = state.configured(spark, str(tmp_path))
    assert sorted((r.scope, r.metric, r.lo, r.hi) for r in over.collect()) == [("", "length", None, 90.0), ("a/b", "params", None, 9.0)]
    bands = {(r.scope, r.lang, r.metric): (r.lo, r.hi) for r in state.layered(registry.metrics(spark), pins, over).collect()}
    assert bands["", "py", "length"] == (None, 90.0) and bands["", "go", "params"] == (None, 4.0) and bands["a/b", "go", "params"] == (None, 9.0)
    assert bands["", "py", "comment ratio"] == (0.0, 0.47) and bands["", None, "params"] == (None, 5.0)
    (tmp_path / "srcprism.toml").write_text('[budgets]\n"lenght" = { hi = 90 }\n')
    try:
        state.configured(spark, str(tmp_path))
        raise AssertionError("an unknown metric was let through")
    except ValueError as e:
        assert "lenght" in str(e)
    ledger = spark.createDataFrame([("length", "a.py", "f", 70.0), ("params", "b.py", "", None)], state.LEDGER)
    state.write_ledger(ledger, str(tmp_path / "ledger"))
    assert sorted(map(tuple, state.read_ledger(spark, str(tmp_path / "ledger")).collect())) == sorted(map(tuple, ledger.collect()))
    for n in (3, 2):
        state.record(spark.createDataFrame([("c", "main", 1, 2, 3, n, 1, 0.5, {"length": n})], state.RUN), str(tmp_path / "runs"))
    (tmp_path / "runs" / "part-broken.json").write_text("{not json\n")
    runs, broken = state.history(spark, str(tmp_path / "runs"))
    assert sorted(r.gates for r in runs.collect()) == [2, 3] and broken.count() == 1
