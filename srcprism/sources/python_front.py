"""Front-end for Python: one pass over a file's syntax tree yields its facts.

Runs inside ``mapInArrow``; whatever cannot be parsed has ``parse_errors`` 1 and no units. All
scoring that can be relational is left to the DataFrame side.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections import Counter, defaultdict

DEPTH_LIMIT = 300
TRIVIAL = {0, 1, 2, 0.5, 10, 100}
BLOCKING = {"time.sleep", "urlopen", "open", "os.system", "subprocess.run", "subprocess.call"}
SHELLS = {"system", "popen", "getoutput", "getstatusoutput"}
SPOOKY = {"eval", "exec", "__import__", "globals", "locals"}
NESTED = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.ExceptHandler)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
VISUAL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.Try, ast.With, ast.AsyncWith)
QUERY = re.compile(r"^\s*(select\b.*\bfrom|insert\s+into|update\b.*\bset|delete\s+from)\b", re.I | re.S)
GLUE = set("a an and are as at be by for from in is it its of on or so that the this to we with".split())

COUNTERS = """magic_numbers demeter negations repurposed swallowed broad_catch lost_context casts blocking_calls bool_traps sleep_calls
unawaited allocs_in_loop wildcard_matches dropped_tasks assert_calls vacuous_asserts self_accesses envy_count cognitive cyclomatic doc_lines
return_arity max_vis_depth max_expr_depth max_loop_depth max_live_span unwraps""".split()


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def calls_in(node: ast.AST) -> list[ast.Call]:
    return [n for n in ast.walk(node) if isinstance(n, ast.Call)]


def own_nodes(root: ast.AST):
    """Nodes of a unit without those of the functions defined inside it."""
    stack = [*ast.iter_child_nodes(root)]
    while stack:
        node = stack.pop()
        yield node
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            stack.extend(ast.iter_child_nodes(node))


class Unit:
    def __init__(self, node: ast.AST, name: str, qualname: str, module: bool, method: bool, public: bool, test_file: bool):
        self.node, self.name, self.qualname = node, name, qualname
        self.is_module, self.is_method, self.is_public = module, method, public
        self.named_test = name.startswith("test") and test_file and not module
        self.count = Counter()
        self.score(getattr(node, "body", []), 0, 0, 0)
        self.count["cyclomatic"] += 1
        self.scan()

    def score(self, body, cog: int, vis: int, loops: int) -> None:
        for child in body if isinstance(body, list) else [body]:
            self.event(child, cog, vis, loops)

    def event(self, node: ast.AST, cog: int, vis: int, loops: int, elif_: bool = False) -> None:
        """Cognitive and cyclomatic events, and the depths, from one node down."""
        c = self.count
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            return  # a unit of its own
        if isinstance(node, NESTED):
            c["cognitive"] += 1 if elif_ else 1 + cog
            c["cyclomatic"] += not isinstance(node, ast.Match)
        if isinstance(node, ast.match_case):
            c["cyclomatic"] += 1
            c["wildcard_matches"] += isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None
        if isinstance(node, ast.BoolOp):
            c["cognitive"] += 1
            c["cyclomatic"] += len(node.values) - 1
        if isinstance(node, ast.comprehension):
            c["cognitive"] += len(node.ifs)
            c["cyclomatic"] += len(node.ifs)
        deeper_cog = cog + (isinstance(node, (*NESTED, ast.Lambda)) and not elif_)
        deeper_vis = vis + (isinstance(node, (*VISUAL, ast.ClassDef)) and not elif_)
        deeper_loops = loops + isinstance(node, LOOPS)
        c["max_vis_depth"] = max(c["max_vis_depth"], deeper_vis)
        c["max_loop_depth"] = max(c["max_loop_depth"], deeper_loops)
        if isinstance(node, ast.Call) and loops and dotted(node.func).split(".")[-1] == "deepcopy":
            c["allocs_in_loop"] += 1
        if isinstance(node, ast.If):
            self.event(node.test, deeper_cog, deeper_vis, deeper_loops)
            self.score(node.body, deeper_cog, deeper_vis, deeper_loops)
            if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset:
                self.event(node.orelse[0], deeper_cog, deeper_vis, deeper_loops, True)
            elif node.orelse:
                c["cognitive"] += 1
                self.score(node.orelse, deeper_cog, deeper_vis, deeper_loops)
            return
        for child in ast.iter_child_nodes(node):
            self.event(child, deeper_cog, deeper_vis, deeper_loops)

    def scan(self) -> None:
        c, node = self.count, self.node
        doc = ast.get_docstring(node, clean=False) if not isinstance(node, ast.Lambda) else None
        c["doc_lines"] = len(doc.strip().split("\n")) if doc else 0
        foreign, assigned = Counter(), defaultdict(list)
        first, last = {}, {}
        for n in own_nodes(node):
            if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
                c["magic_numbers"] += n.value not in TRIVIAL and not getattr(n, "named", False)
            elif isinstance(n, ast.Attribute):
                self.attribute(n, foreign)
            elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not):
                text = ast.unparse(n.operand)[:80]
                c["negations"] += "!=" in text or bool(re.match(r"(not_|no_|disabled|invalid|missing|unset)", text))
            elif isinstance(n, ast.ExceptHandler):
                self.handler(n)
            elif isinstance(n, ast.Call):
                self.call(n)
            elif isinstance(n, ast.Assert):
                c["assert_calls"] += 1
                c["vacuous_asserts"] += isinstance(n.test, ast.Constant)
            elif isinstance(n, ast.Return) and isinstance(n.value, ast.Tuple):
                c["return_arity"] = max(c["return_arity"], len(n.value.elts))
            elif isinstance(n, ast.Name) and not self.is_module:
                if isinstance(n.ctx, ast.Store):
                    first.setdefault(n.id, n.lineno)
                    first[n.id] = min(first[n.id], n.lineno)
                    assigned[n.id].append(n.lineno)
                elif n.id:
                    last[n.id] = max(last.get(n.id, 0), n.lineno)
            if isinstance(n, ast.expr) and getattr(n, "end_lineno", 0) == getattr(n, "lineno", -1):
                c["max_expr_depth"] = max(c["max_expr_depth"], height(n))
        spans = {k: last[k] - v for k, v in first.items() if k in last and last[k] > v and not k.startswith("_")}
        best = min(spans, key=lambda k: (-spans[k], k), default="")
        c["max_live_span"], self.live_var = spans.get(best, 0), best
        c["envy_count"] = max(foreign.values(), default=0)
        self.straight(getattr(node, "body", []))

    def straight(self, body) -> None:
        """Names given an unrelated second value in straight-line code."""
        seen = set()
        for s in body if isinstance(body, list) else []:
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                name = s.targets[0].id
                mentions = any(isinstance(n, ast.Name) and n.id == name for n in ast.walk(s.value))
                self.count["repurposed"] += name in seen and not mentions and not isinstance(self.node, ast.ClassDef)
                seen.add(name)

    def attribute(self, n: ast.Attribute, foreign: Counter) -> None:
        base, links = n, 0
        while isinstance(base, ast.Attribute):
            base, links = base.value, links + 1
        if isinstance(base, ast.Name):
            if base.id in ("self", "cls"):
                self.count["self_accesses"] += 1
                links -= 1
            else:
                foreign[base.id] += 1
            if not getattr(n, "inner", False) and links >= 3 and not base.id[:1].isupper():
                self.count["demeter"] += 1
        if isinstance(n.value, ast.Attribute):
            n.value.inner = True

    def handler(self, n: ast.ExceptHandler) -> None:
        c, name = self.count, dotted(n.type) if n.type else ""
        c["broad_catch"] += n.type is None or name in ("Exception", "BaseException")
        c["swallowed"] += all(isinstance(s, ast.Pass) or (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) for s in n.body)
        for s in n.body:
            if isinstance(s, ast.Raise) and isinstance(s.exc, ast.Call) and s.cause is None:
                c["lost_context"] += 1

    def call(self, n: ast.Call) -> None:
        c, name = self.count, dotted(n.func)
        leaf = name.split(".")[-1]
        c["casts"] += leaf == "cast"
        c["assert_calls"] += leaf.lower().startswith(("assert", "expect")) or leaf.lower().endswith("assert")
        c["sleep_calls"] += leaf == "sleep"
        c["bool_traps"] += sum(isinstance(a, ast.Constant) and isinstance(a.value, bool) for a in n.args) >= 2
        if isinstance(self.node, ast.AsyncFunctionDef):
            c["blocking_calls"] += name in BLOCKING or bool(re.match(r"(requests|httpx)\.(get|post|put|patch|delete|head|request)$", name))
        self.recursive = getattr(self, "recursive", False) or (name in (self.name, f"self.{self.name}"))

    def params(self) -> list[dict]:
        if not isinstance(self.node, ast.FunctionDef | ast.AsyncFunctionDef):
            return []
        a, out = self.node.args, []
        positional = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(positional) - len(a.defaults)) + a.defaults
        every = [(p, d, "") for p, d in zip(positional, defaults, strict=True)] + ([(a.vararg, None, "*")] if a.vararg else [])
        every += [(p, d, "") for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)] + ([(a.kwarg, None, "**")] if a.kwarg else [])
        for i, (p, d, star) in enumerate(every):
            if i == 0 and self.is_method and p.arg in ("self", "cls"):
                continue
            kind = ast.unparse(p.annotation) if p.annotation else ""
            flag = isinstance(d, ast.Constant) and isinstance(d.value, bool)
            loose = bool({"Any", "object"} & set(re.findall(r"\w+", kind)))
            out.append({"name": p.arg, "type_name": kind, "boolish": flag or kind == "bool", "kw_splat": star == "**", "splat": bool(star), "optional": d is not None, "typed": bool(kind), "loose": loose})
        return out

    def passes_through(self) -> bool:
        body = [s for s in getattr(self.node, "body", []) if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        if self.is_module or len(body) != 1:
            return False
        value = body[0].value if isinstance(body[0], ast.Return | ast.Expr) else None
        if not isinstance(value, ast.Call) or value.keywords or "super" in ast.unparse(value.func):
            return False
        names, mine = [a.id if isinstance(a, ast.Name) else None for a in value.args], [p["name"] for p in self.params()]
        return bool(names) and names == mine[: len(names)]

    def literal_body(self) -> bool:
        body = [s for s in getattr(self.node, "body", []) if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
        return len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Constant)


def height(n: ast.AST) -> int:
    if not hasattr(n, "tall"):
        n.tall = 1 + max((height(x) for x in ast.iter_child_nodes(n) if isinstance(x, ast.expr)), default=0)
    return n.tall


def deepest(tree: ast.AST) -> int:
    most, stack = 0, [(tree, 1)]
    while stack:
        n, d = stack.pop()
        most = max(most, d)
        stack.extend((x, d + 1) for x in ast.iter_child_nodes(n))
    return most


def documented(doc: str) -> list[str]:
    """Parameter names in Sphinx, Google and numpydoc conventions."""
    names = re.findall(r":param\s+(?:[\w\[\], .]+\s+)?\*{0,2}(\w+)\s*:", doc)
    for block in re.findall(r"^\s*Args:\s*\n((?:[ \t]+.*\n?|\s*\n)*)", doc, re.M):
        lines = [x for x in block.split("\n") if x.strip()]
        depth = min((len(x) - len(x.lstrip()) for x in lines), default=0)
        names += [m[1] for x in lines if len(x) - len(x.lstrip()) == depth and (m := re.match(r"\s*\*{0,2}(\w+)\s*(?:\([^)]*\))?:", x))]
    for block in re.findall(r"^\s*Parameters\s*\n\s*-{3,}\n((?:.+\n?)*)", doc, re.M):
        names += re.findall(r"^\s*\*{0,2}(\w+)\s*:", block, re.M)
    return names


def words_of(text: str) -> set[str]:
    cut = re.sub(r"([a-z])([A-Z])", r"\1 \2", text[:200])
    return {w for w in re.findall(r"[a-z0-9]{2,}", cut.lower())} - GLUE


def comment_facts(text: str, tree: ast.Module | None, facts: dict) -> None:
    rows: dict[int, str] = {}
    code: set[int] = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                rows[t.start[0]] = t.string.lstrip("#! ")
            elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                code.update(range(t.start[0], t.end[0] + 1))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    facts["comment_lines"] = len(rows.keys() - code)
    lines = text.split("\n")
    run: list[int] = []
    for n in [*sorted(rows.keys() - code), None]:
        if run and n != run[-1] + 1:
            close_run(run, rows, lines, facts)
            run = []
        if n is not None:
            run.append(n)
    for n, note in rows.items():
        if re.search(r"\b(noqa|type:\s*ignore|pylint:\s*disable|nosec|pragma:\s*no cover)\b", note):
            facts["findings"].append({"kind": "suppressions", "line": n})
        if re.match(r"(TODO|FIXME|HACK|XXX)(?:$|[:( \t!-])", note):
            facts["findings"].append({"kind": "debt", "line": n})
        if n in code:
            facts["comments"].append(prose(n, "Trailing", note))
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and (doc := ast.get_docstring(n)):
            role = "ModuleHeader" if isinstance(n, ast.Module) else "TypeDoc" if isinstance(n, ast.ClassDef) else "FnSummary"
            facts["comments"].append(prose(n.body[0].lineno, role, doc))


def close_run(run: list[int], rows: dict[int, str], lines: list[str], facts: dict) -> None:
    text = "\n".join(rows[n] for n in run)
    facts["comments"].append(prose(run[0], "ModuleHeader" if run[0] == 1 else "Inline", text))
    target = lines[run[-1]] if run[-1] < len(lines) else ""
    said = words_of(text)
    if len(said) >= 2 and len(said & words_of(target)) >= 0.65 * len(said):
        facts["findings"].append({"kind": "echo", "line": run[0]})
    if len(run) >= 2 and 2 * sum(bool(re.search(r"[=(){}\[\]:]\s*$|^\s*(return|import|from|def|if|for)\b|\w+\(", rows[n])) for n in run) >= len(run):
        try:
            if len(ast.parse("\n".join(rows[n] for n in run)).body) >= 2:
                facts["findings"].append({"kind": "commented_code", "line": run[0]})
        except SyntaxError:
            pass


def prose(line: int, role: str, text: str) -> dict:
    text = re.sub(r"```.*?```|`[^`]*`|https?://\S+|^\s{4,}.*$", " ", text, flags=re.S | re.M)
    return {"line": line, "role": role, "words": min(65535, len(re.findall(r"\w+", text))), "sentences": min(255, len(re.findall(r"[.!?](?:\s|$)", text)) or int(bool(text.strip())))}


def class_groups(node: ast.ClassDef) -> int:
    """Groups of methods that share an own member or call each other."""
    methods = [m for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    names = {m.name for m in methods}
    uses = {m.name: {n.attr for n in ast.walk(m) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"} for m in methods}
    uses = {k: v for k, v in uses.items() if v}
    if len(uses) < 2:
        return 0
    groups: list[set[str]] = []
    for name, used in uses.items():
        mine = used | {name} if name in names else used
        met = [g for g in groups if g & mine]
        groups = [g for g in groups if not g & mine] + [mine.union(*met)]
    return len(groups)


def clone_sites(tree: ast.Module, facts: dict) -> None:
    """Hashes of subtrees with identifiers and literals by kind only."""

    def visit(n: ast.AST) -> tuple[str, int, int]:
        kids = [visit(x) for x in ast.iter_child_nodes(n) if not isinstance(x, ast.expr_context)]
        mass, logic = 1 + sum(k[1] for k in kids), isinstance(n, ast.stmt | ast.Call | ast.BoolOp) + sum(k[2] for k in kids)
        key = hashlib.md5("|".join([type(n).__name__, *(k[0] for k in kids)]).encode()).hexdigest()
        if isinstance(n, ast.stmt) and mass >= 24 and logic >= 3 and n.end_lineno - n.lineno >= 2:
            facts["sites"].append({"hash": key, "mass": mass, "line": n.lineno, "end_line": n.end_lineno})
        return key, mass, logic

    facts["mass"] = visit(tree)[1]


def strings(tree: ast.Module, units: list[Unit], facts: dict, is_test: bool) -> None:
    seen = defaultdict(set)
    lines = {}
    for i, u in enumerate(units):
        for n in own_nodes(u.node):
            if isinstance(n, ast.Constant) and isinstance(n.value, str) and len(n.value) >= 8 and not getattr(n, "named", False):
                seen[n.value].add(i)
                lines[n.value] = min(lines.get(n.value, n.lineno), n.lineno)
    facts["findings"] += [{"kind": "magic_strings", "line": lines[s]} for s, where in seen.items() if len(where) >= 3]
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign | ast.AnnAssign | ast.keyword | ast.Dict):
            pairs = [(dotted(t).split(".")[-1], n.value) for t in n.targets] if isinstance(n, ast.Assign) else []
            if isinstance(n, ast.AnnAssign) and n.value:
                pairs = [(dotted(n.target).split(".")[-1], n.value)]
            if isinstance(n, ast.keyword):
                pairs = [(n.arg or "", n.value)]
            if isinstance(n, ast.Dict):
                pairs = [(k.value, v) for k, v in zip(n.keys, n.values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)]
            facts["literals"] += [{"name": k, "value": v.value, "line": v.lineno} for k, v in pairs if isinstance(v, ast.Constant) and isinstance(v.value, str)]
        built = isinstance(n, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in n.values)
        text = "".join(v.value if isinstance(v, ast.Constant) else "?" for v in n.values) if built else ""
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Mod | ast.Add) and isinstance(n.left, ast.Constant) and isinstance(n.left.value, str):
            built, text = True, n.left.value + "?"
        if built and QUERY.search(text):
            facts["findings"].append({"kind": "built_query", "line": n.lineno})
        if isinstance(n, ast.Call):
            leaf, name = dotted(n.func).split(".")[-1], dotted(n.func)
            shell = leaf in SHELLS or any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords)
            if shell and n.args and not isinstance(n.args[0], ast.Constant) and not is_test:
                facts["findings"].append({"kind": "shelled_out", "line": n.lineno})
            computed = leaf in ("getattr", "setattr", "delattr") and len(n.args) >= 2 and not isinstance(n.args[1], ast.Constant)
            if name in SPOOKY or (computed and len(n.args) == 2) or (leaf == "import_module" and n.args and not isinstance(n.args[0], ast.Constant)):
                facts["findings"].append({"kind": "spooky", "line": n.lineno})


def extract(path: str, text: str, is_test: bool, is_script: bool) -> dict:
    """All facts of one file."""
    rows = text.split("\n")
    rows = rows[:-1] if rows and rows[-1] == "" else rows
    facts = {
        "path": path, "lang": "py", "lines": len(rows), "blank_lines": sum(not r.strip() for r in rows), "comment_lines": 0, "parse_errors": 0,
        "too_deep": False, "mass": 0, "is_test_file": is_test, "is_script_file": is_script,
    } | {k: [] for k in ("units", "findings", "comments", "classes", "interfaces", "imports", "exports", "mentions", "sites", "literals")}
    try:
        tree = ast.parse(text)
        facts["too_deep"] = deepest(tree) > DEPTH_LIMIT
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree, facts["parse_errors"] = None, 1
    if facts["too_deep"]:
        tree = None
    comment_facts(text, tree, facts)
    if tree is None:
        return facts
    for n in ast.walk(tree):  # values bound to a constant's name are named already
        target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, ast.AnnAssign) else None
        if isinstance(target, ast.Name) and (target.id.isupper() or isinstance(n, ast.AnnAssign)):
            for x in ast.walk(n):
                x.named = True
    units = [Unit(tree, "<module>", "<module>", True, False, False, is_test)]

    def open_units(node: ast.AST, scope: list[str], in_class: bool, nested: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                public = not child.name.startswith("_") and not nested
                units.append(Unit(child, child.name, ".".join([*scope, child.name]), False, in_class, public, is_test))
                open_units(child, [*scope, child.name], False, True)
            elif isinstance(child, ast.ClassDef):
                facts["classes"].append({"name": child.name, "line": child.lineno, "groups": class_groups(child)})
                bases = {dotted(b).split(".")[-1] for b in child.bases}
                if bases & {"Protocol", "ABC"}:
                    facts["interfaces"].append({"name": child.name, "line": child.lineno, "methods": sum(isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef) for m in child.body)})
                open_units(child, [*scope, child.name], True, nested)
            else:
                open_units(child, scope, in_class, nested)

    open_units(tree, [], False, False)
    coroutines = defaultdict(list)
    for u in units:
        coroutines[u.name].append(isinstance(u.node, ast.AsyncFunctionDef))
    for u in units:
        for n in own_nodes(u.node):
            if isinstance(n, ast.Expr) and isinstance(n.value, ast.Call):
                name = dotted(n.value.func)
                u.count["unawaited"] += bool(coroutines.get(name)) and all(coroutines[name])
                u.count["dropped_tasks"] += name.split(".")[-1] in ("create_task", "ensure_future", "spawn")
    clone_sites(tree, facts)
    strings(tree, units, facts, is_test)
    for i, u in enumerate(units):
        n = u.node
        doc = ast.get_docstring(n) or ""
        facts["units"].append({
            "unit_idx": i, "name": u.name, "qualname": u.qualname, "line": getattr(n, "lineno", 1), "lines": len(rows) if u.is_module else n.end_lineno - n.lineno + 1,
            "is_module": u.is_module, "is_method": u.is_method, "is_public": u.is_public, "is_async": isinstance(n, ast.AsyncFunctionDef),
            "is_test": is_test, "named_test": u.named_test, "returns": ast.unparse(n.returns) if getattr(n, "returns", None) else "",
            "live_var": u.live_var, "pass_through": u.passes_through(), "literal_body": u.literal_body(), "params": u.params(), "documented": documented(doc),
            "calls": [dotted(c.func).split(".")[-1] for c in own_nodes(n) if isinstance(c, ast.Call)],
            "counts": {k: int(u.count[k]) + (k == "cognitive" and getattr(u, "recursive", False)) for k in COUNTERS},
        })
        decorators = [dotted(d.func if isinstance(d, ast.Call) else d) for d in getattr(n, "decorator_list", [])]
        if any(d.split(".")[-1] in ("skip", "skipif") for d in decorators):
            facts["findings"].append({"kind": "skipped_tests", "line": n.lineno})
        if u.is_public:
            facts["exports"].append(u.name)
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            facts["imports"] += [{"target": a.name, "names": []} for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            facts["imports"].append({"target": "." * n.level + (n.module or ""), "names": [a.name for a in n.names]})
    facts["mentions"] = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)})
    return facts
