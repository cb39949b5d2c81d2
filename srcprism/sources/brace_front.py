"""Front-end for languages with braces: tokens, units and their scores, without a full grammar.

Tokens are cut by one pattern; brackets are paired; functions are found by their keyword, or, in
languages that have none, by a name and its parentheses before a block. A unit's body is walked
once: conditions, loops, branches and handlers nest, a statement without braces ends at its
semicolon. What this reading cannot tell (expression depth, live spans, cohesion and others) has
no counter here and gets no measurement.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from .python_front import COUNTERS, TRIVIAL

#: How a language declares functions: by keyword, or by a type before a name.
KEYWORD = {"rs": "fn", "ts": "function", "tsx": "function", "js": "function", "go": "func", "swift": "func", "scala": "def", "php": "function", "zig": "fn", "sol": "function"}
TYPED_FIRST = {"java", "cs", "c", "cpp", "cu"}
LANGS = (*KEYWORD, *sorted(TYPED_FIRST))
SCRIPT = {"ts", "tsx", "js"}
#: Languages whose conditions need no parentheses.
BARE = {"rs", "go", "swift", "zig", "scala"}
CONTAINERS = set("class struct interface trait impl object enum contract extension protocol namespace union".split())
BRANCH, LOOPS, CHOICES, HANDLERS = {"if", "elseif", "unless", "guard"}, {"for", "while", "foreach", "loop", "do", "repeat"}, {"switch", "match", "select"}, {"catch"}
NOT_NAMES = BRANCH | LOOPS | CHOICES | HANDLERS | set("return new else throw sizeof typeof await yield in of case super this assert synchronized using lock fixed".split())
LOOSE = {"any", "Any", "object", "Object", "dynamic", "mixed", "AnyObject", "interface"}
TRUE = {"true", "false"}

_TOKEN = re.compile(
    r"""(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<n>0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?\w*)|(?P<i>[$@#]?[A-Za-z_]\w*)"""
    r"""|(?P<p>=>|->|&&|\|\||\?\?|\?\.|::|\.\.\.|==|!=|<=|>=|:=|[-+*/%&|^]=|[^\s\w])""",
    re.S,
)
_LIFETIME = re.compile(r"'[a-z_]\w*(?!')")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Unit:
    name: str
    scope: str
    at: int
    params: tuple[int, int]
    body: tuple[int, int]
    line: int
    end: int
    returns: str = ""
    mods: set[str] = field(default_factory=set)


class Source:
    """A file's tokens, the partner of each bracket, its containers and its units."""

    def __init__(self, lang: str, text: str):
        self.lang, self.text = lang, text
        text = _LIFETIME.sub(lambda m: "_" * len(m[0]), text) if lang == "rs" else text
        text = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: " " * len(m[0]), text) if lang in ("c", "cpp", "cu") else text
        self.tok: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        line, seen = 1, 0
        for m in _TOKEN.finditer(text):
            line += text.count("\n", seen, m.start())
            seen = m.start()
            if m.lastgroup != "c":
                self.tok.append(m[0])
                self.kind.append(m.lastgroup)
                self.line.append(line)
        self.mate, self.errors = self._paired()
        self.boxes = self._containers()
        self.units = sorted(self._units(), key=lambda u: u.body)
        self.starts = {u.at: u for u in self.units}

    def _paired(self) -> tuple[dict[int, int], int]:
        mate, stack, errors = {}, [], 0
        for i, t in enumerate(self.tok):
            if self.kind[i] != "p":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                if stack and _OPEN[self.tok[stack[-1]]] == t:
                    mate[stack[-1]] = i
                    mate[i] = stack.pop()
                else:
                    errors += 1
        return mate, errors + len(stack)

    def get(self, i: int) -> str:
        return self.tok[i] if 0 <= i < len(self.tok) else ""

    def block_after(self, i: int, stop: set[str]) -> int | None:
        """The next brace from token i that no bracket encloses; None if ``stop`` comes first."""
        while i < len(self.tok):
            t = self.tok[i]
            if t == "{" and self.kind[i] == "p":
                return i if i in self.mate else None
            if t in stop or t in _CLOSE:
                return None
            i = self.mate.get(i, i) + 1 if t in ("(", "[") else i + 1
        return None

    def _containers(self) -> list[tuple[int, int, str]]:
        out = []
        for i, t in enumerate(self.tok):
            if t in CONTAINERS and self.kind[i] == "i":
                at = self.block_after(i + 1, {";", "=", ")"})
                if at is not None:
                    names = [x for x, k in zip(self.tok[i + 1 : at], self.kind[i + 1 : at], strict=True) if k == "i"]
                    name = names[names.index("for") + 1] if t == "impl" and "for" in names[:-1] else (names or [""])[0]
                    out.append((at, self.mate[at], name if t != "namespace" else ""))
        return out

    def scope(self, i: int) -> str:
        return ".".join(n for a, b, n in self.boxes if a < i < b and n)

    def _units(self) -> list[Unit]:
        out, word = [], KEYWORD.get(self.lang)
        for i, t in enumerate(self.tok):
            if self.kind[i] != "i":
                continue
            u = None
            if word and t == word:
                u = self._declared(i)
            elif self.lang in TYPED_FIRST and self.get(i + 1) == "(" and t not in NOT_NAMES:
                before = self.get(i - 1)
                if i and (self.kind[i - 1] == "i" or before in ("*", "&", ">", "]")) and before not in NOT_NAMES | {"."}:
                    u = self._made(i, i, i + 1)
                elif self.scope(i).split(".")[-1] == t:  # a constructor
                    u = self._made(i, i, i + 1)
            elif self.lang in SCRIPT and self.get(i + 1) == "(" and t not in NOT_NAMES and self.scope(i):
                if self.get(i - 1) in ("{", "}", ";") or self.get(i - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly"):
                    u = self._made(i, i, i + 1)
            elif self.lang in SCRIPT and self.get(i + 1) in ("=", ":") and self.get(i - 1) not in (".", ","):
                u = self._arrow(i)
            if u:
                out.append(u)
        return out

    def _declared(self, i: int) -> Unit | None:
        j = i + 1
        if self.lang == "go" and self.get(j) == "(" and j in self.mate:
            j = self.mate[j] + 1
        j += self.get(j) == "*"
        if j >= len(self.tok) or self.kind[j] != "i":
            return None
        name = j
        j += 1
        if self.get(j) in ("<", "["):  # type parameters
            depth = 0
            while j < len(self.tok):
                depth += (self.tok[j] in ("<", "[")) - (self.tok[j] in (">", "]"))
                j += 1
                if not depth:
                    break
        return self._made(i, name, j) if self.get(j) == "(" else None

    def _made(self, first: int, name: int, opening: int) -> Unit | None:
        """A unit from its name and parameter list, if a block follows."""
        if opening not in self.mate:
            return None
        close = self.mate[opening]
        stop = {";"} | ({"=", ","} if self.lang in TYPED_FIRST | SCRIPT else set()) | ({"."} if self.lang in TYPED_FIRST else set())
        body = self.block_after(close + 1, stop - ({"="} if self.lang == "scala" else set()))
        if self.lang in TYPED_FIRST and body is not None and any(x in NOT_NAMES or x == "->" for x in self.tok[close + 1 : body]):
            return None
        if body is None:
            return None
        head = first
        while head and self.tok[head - 1] not in (";", "{", "}", ",", "php") and not (self.lang in ("go", "swift", "scala") and self.line[head - 1] != self.line[head]):
            head -= 1
        after, before = self.tok[close + 1 : body], self.tok[head:name]
        mods = {x for x in (before + after if self.lang == "sol" else before) if x.isalpha()}
        if self.lang in TYPED_FIRST:
            given = [x for x in before if x not in ("public", "private", "protected", "static", "final", "virtual", "override", "async", "inline", "abstract", "extern")]
            returns = "".join(given)
        else:
            returns = "".join(after).lstrip(":").removeprefix("->").removesuffix("=").strip()
        return Unit(self.tok[name], self.scope(name), first, (opening, close), (body, self.mate[body]), self.line[head], self.line[self.mate[body]], returns, mods)

    def _arrow(self, i: int) -> Unit | None:
        """name = (params) => { ... }, or name = x => { ... }."""
        j = i + 1
        if self.get(j) == ":":
            while j < len(self.tok) and self.tok[j] not in ("=", ";", "{", "}", ")"):
                j = self.mate.get(j, j) + 1 if self.tok[j] in ("(", "[") else j + 1
            if self.get(j) != "=":
                return None
        j += 1
        j += self.get(j) == "async"
        opening = j
        if self.get(j) == "(" and j in self.mate:
            close = self.mate[j]
        elif j < len(self.tok) and self.kind[j] == "i" and self.get(j + 1) == "=>":
            opening, close = j - 1, j + 1
        else:
            return None
        k = close + 1 if close > opening + 2 or self.get(close) == ")" else close
        while k < len(self.tok) and self.tok[k] not in ("=>", ";", "{", "}"):
            k += 1
        if self.get(k) != "=>" or self.get(k + 1) != "{" or k + 1 not in self.mate:
            return None
        mods = {self.tok[x] for x in range(max(0, i - 3), i) if self.tok[x] in ("export", "default")}
        end = self.mate[k + 1]
        return Unit(self.tok[i], self.scope(i), i, (opening, close), (k + 1, end), self.line[i], self.line[end], "".join(self.tok[close + 1 : k]).lstrip(":"), mods)

    # -- parameters -----------------------------------------------------------------------

    def pieces(self, a: int, b: int) -> list[list[int]]:
        """Token places between a and b, split at commas that no bracket encloses."""
        out, now, depth, i = [], [], 0, a + 1
        while i < b:
            t = self.tok[i]
            depth += (t == "<") - (t == ">")
            if t == "," and depth <= 0:
                out.append(now)
                now = []
            elif t in _OPEN and i in self.mate:
                now += range(i, self.mate[i] + 1)
                i = self.mate[i]
            else:
                now.append(i)
            i += 1
        return [x for x in [*out, now] if x]

    def params(self, u: Unit) -> list[dict]:
        out = []
        for piece in self.pieces(*u.params):
            words = [self.tok[i] for i in piece]
            default = words[words.index("=") + 1 :] if "=" in words else []
            head = words[: words.index("=")] if "=" in words else words
            splat = "..." in head
            head = [w for w in head if w != "..." and not w.startswith(("@", "#"))]
            if self.lang == "rs" and "self" in head:
                continue
            name, kind = self._named(head)
            if not name:
                continue
            out.append({"name": name, "type_name": kind, "boolish": kind in ("bool", "boolean", "Bool", "Boolean") or default[:1] in (["true"], ["false"]), "kw_splat": False, "splat": splat,
                        "optional": bool(default) or "?" in head, "typed": bool(kind), "loose": bool(LOOSE & set(re.findall(r"\w+", kind)))})
        if self.lang == "go":  # names that share the next type
            kind = ""
            for p in reversed(out):
                kind = p["type_name"] or kind
                p.update(type_name=kind, typed=bool(kind), boolish=kind == "bool", loose=bool(LOOSE & set(re.findall(r"\w+", kind))))
        return out

    def _named(self, head: list[str]) -> tuple[str, str]:
        ids = [w for w in head if re.match(r"[$A-Za-z_]", w)]
        if not ids or head == ["void"]:
            return "", ""
        if self.lang in SCRIPT or self.lang in ("rs", "swift", "scala", "zig"):
            if ":" in head:
                at = head.index(":")
                left = [w for w in head[:at] if re.match(r"[$A-Za-z_]", w)]
                return (left or [""])[-1], "".join(head[at + 1 :])
            return ids[-1], ""
        if self.lang == "go":
            return head[0], "".join(head[1:])
        depth, names = 0, []
        for i, w in enumerate(head):
            depth += (w in _OPEN) - (w in _CLOSE)
            if not depth and re.match(r"[$A-Za-z_]", w):
                names.append(i)
        if not names:
            return "", ""
        if self.lang == "php":
            at = next((i for i in names if head[i].startswith("$")), names[-1])
            return head[at].lstrip("$"), "".join(head[:at])
        at = names[-1]
        return head[at], " ".join([*head[:at], *head[at + 1 :]])

    # -- scores ---------------------------------------------------------------------------

    def counts(self, a: int, b: int) -> Counter:
        """Scores of the tokens between a and b, without the units inside."""
        c = Counter(cyclomatic=1)
        self._walk(a, b, 0, 0, 0, c)
        return c

    def _body(self, i: int, end: int) -> tuple[int, int, int]:
        """(first, last, next) of the body that starts at i: a block or one statement."""
        if self.get(i) == "{" and i in self.mate:
            return i + 1, self.mate[i], self.mate[i] + 1
        j = i
        while j < end and self.tok[j] != ";":
            if self.tok[j] in _CLOSE:
                return i, j, j
            j = self.mate.get(j, j) + 1 if self.tok[j] in _OPEN else j + 1
            if j <= end and self.get(j - 1) == "}":
                more = self.get(j) in ("else", "catch", "finally") or (self.get(i) == "do" and self.get(j) == "while")
                if not more:
                    return i, j, j
        return i, min(j + 1, end), min(j + 1, end)

    def _head(self, i: int, end: int) -> int:
        """Where the body of the keyword at i - 1 starts."""
        if self.lang not in BARE or (self.lang in ("zig", "scala") and self.get(i) == "("):
            i += self.get(i) in ("await", "constexpr", "const")
            j = self.mate.get(i, i) + 1 if self.get(i) == "(" else i
            if self.get(j) == "|":  # a captured value
                j += 1
                while j < end and self.tok[j] != "|":
                    j += 1
                j += 1
            return j
        at = self.block_after(i, {";"})
        return end if at is None or at > end else at

    def _walk(self, i: int, end: int, cog: int, vis: int, loops: int, c: Counter) -> None:
        last = ""
        c["max_vis_depth"], c["max_loop_depth"] = max(c["max_vis_depth"], vis), max(c["max_loop_depth"], loops)
        while i < end:
            t, kind = self.tok[i], self.kind[i]
            if i in self.starts:
                i = self.starts[i].body[1] + 1
                continue
            if kind == "i" and self.get(i - 1) not in (".", "?.", "::"):
                if t in BRANCH:
                    i = self._branch(i, end, cog, vis, loops, c, False)
                    continue
                if t in LOOPS and not (t in ("loop", "repeat", "do", "for") and self.get(i + 1) in (":", "=", ",", ")", ".", ";", "<")):
                    i = self._loop(i, end, cog, vis, loops, c)
                    continue
                if t in CHOICES and self.get(i + 1) not in (":", "=", ",", ")", ".", ";"):
                    at = self.block_after(i + 1, {";"})
                    if at is not None and at < end:
                        c["cognitive"] += 1 + cog
                        self._walk(i + 1, at, cog + 1, vis, loops, c)
                        self._arms(at, c)
                        self._walk(at + 1, self.mate[at], cog + 1, vis + 1, loops, c)
                        i = self.mate[at] + 1
                        continue
                if t == "try" and self.get(i + 1) == "{" and i + 1 in self.mate:
                    self._walk(i + 2, self.mate[i + 1], cog, vis + 1, loops, c)
                    i = self.mate[i + 1] + 1
                    continue
                if t in HANDLERS:
                    i = self._handler(i, end, cog, vis, loops, c)
                    continue
                self._word(i, c)
            elif kind == "i" and self.lang == "rs" and t in ("unwrap", "expect") and self.get(i + 1) == "(":
                c["unwraps"] += 1
            elif kind == "n":
                value = re.match(r"\d[\d_]*(?:\.\d+)?$", t)
                c["magic_numbers"] += not (value and float(t.replace("_", "")) in TRIVIAL)
            if t in ("&&", "||") or (t in ("and", "or") and self.lang in ("zig", "php")):
                c["cyclomatic"] += 1
                c["cognitive"] += t != last
                last = t
            elif t == "?" and self.lang in SCRIPT | TYPED_FIRST | {"php", "sol"} and self.get(i + 1) not in (":", ")", ",", "=", ">", "[") and self.get(i - 1) not in ("<",):
                c["cognitive"] += 1 + cog
                c["cyclomatic"] += 1
            elif t == "!" and self.get(i + 1) == "(" and i + 1 in self.mate and "!=" in self.tok[i + 1 : self.mate[i + 1]]:
                c["negations"] += 1
            elif t in (";", ","):
                last = ""
            if t in _OPEN and kind == "p" and i in self.mate:
                close = self.mate[i]
                inner = cog + (t == "{" and self.get(i - 1) == "=>")
                self._walk(i + 1, min(close, end), inner, vis, loops, c)
                i = close + 1
                continue
            i += 1

    def _word(self, i: int, c: Counter) -> None:
        t, after = self.tok[i], self.get(i + 1)
        if t == "as" and self.lang in ("ts", "tsx", "rs") and self.get(i - 1) not in ("import", "{", ",") and after != "const":
            c["casts"] += 1
        elif t == "panic" and after == "(" and self.lang == "go" or t == "unreachable" and self.lang == "zig":
            c["unwraps"] += 1
        elif t in ("try", "as") and after == "!" and self.lang == "swift":
            c["unwraps"] += 1
        if after == "(" and i + 1 in self.mate:
            flags = [p for p in self.pieces(i + 1, self.mate[i + 1]) if len(p) == 1 and self.tok[p[0]] in TRUE]
            c["bool_traps"] += len(flags) >= 2

    def _branch(self, i: int, end: int, cog: int, vis: int, loops: int, c: Counter, other: bool) -> int:
        c["cognitive"] += 1 if other else 1 + cog
        c["cyclomatic"] += 1
        deep, tall = (cog, vis) if other else (cog + 1, vis + 1)
        at = self._head(i + 1, end)
        self._walk(i + 1, min(at, end), deep, vis, loops, c)
        first, last, i = self._body(at, end)
        self._walk(first, last, deep, tall, loops, c)
        if i < end and self.tok[i] == "else":
            if self.get(i + 1) == "if":
                return self._branch(i + 1, end, deep, tall, loops, c, True)
            c["cognitive"] += 1
            first, last, i = self._body(i + 1, end)
            self._walk(first, last, deep, tall, loops, c)
        elif i < end and self.tok[i] == "elseif":
            return self._branch(i, end, deep, tall, loops, c, True)
        return i

    def _loop(self, i: int, end: int, cog: int, vis: int, loops: int, c: Counter) -> int:
        c["cognitive"] += 1 + cog
        c["cyclomatic"] += 1
        do = self.tok[i] in ("do", "loop", "repeat") and self.get(i + 1) == "{"
        at = i + 1 if do else self._head(i + 1, end)
        self._walk(i + 1, min(at, end), cog + 1, vis, loops, c)
        first, last, nxt = self._body(at, end)
        self._walk(first, last, cog + 1, vis + 1, loops + 1, c)
        if self.tok[i] == "do" and self.get(nxt) == "while":
            at = self._head(nxt + 1, end)
            self._walk(nxt + 1, min(at, end), cog + 1, vis, loops, c)
            nxt = at
        return nxt

    def _arms(self, at: int, c: Counter) -> None:
        """Arms of a choice; the one that takes anything is a wildcard and decides like the others."""
        i, end = at + 1, self.mate[at]
        while i < end:
            t = self.tok[i]
            arm = t in ("case", "default") or (t == "=>" and self.lang in ("rs", "php", "zig"))
            if arm:
                c["cyclomatic"] += t != "default"
                c["wildcard_matches"] += t == "default" or (self.lang in ("rs", "scala", "swift") and "_" in (self.get(i - 1), self.get(i + 1)))
            i = self.mate.get(i, i) + 1 if t in _OPEN else i + 1

    def _handler(self, i: int, end: int, cog: int, vis: int, loops: int, c: Counter) -> int:
        c["cognitive"] += 1 + cog
        c["cyclomatic"] += 1
        at = self.block_after(i + 1, {";"})
        if at is None or at >= end:
            return i + 1
        named = set(self.tok[i + 1 : at])
        c["broad_catch"] += bool(named & {"Exception", "Throwable", "Error"}) or (self.lang in ("cs", "cpp") and (not named or "..." in named))
        c["swallowed"] += self.mate[at] == at + 1
        self._walk(at + 1, self.mate[at], cog + 1, vis, loops, c)
        return self.mate[at] + 1


def _public(lang: str, u: Unit) -> bool:
    if lang == "go":
        return u.name[:1].isupper()
    if lang in ("rs", "zig"):
        return "pub" in u.mods
    if lang in ("java", "cs", "sol"):
        return "public" in u.mods or "external" in u.mods
    if lang in ("c", "cpp", "cu"):
        return "static" not in u.mods
    if lang in SCRIPT and not u.scope:
        return "export" in u.mods
    return not u.mods & {"private", "fileprivate", "protected"} and not u.name.startswith(("_", "#"))


def extract(facts: dict, lang: str, text: str, is_test: bool) -> dict:
    """``facts`` of the lexer with units, classes, interfaces and exports."""
    try:
        src = Source(lang, text)
        pairs = [(u, src.counts(u.body[0] + 1, u.body[1])) for u in src.units]
        whole = src.counts(0, len(src.tok))
    except RecursionError:
        facts["too_deep"] = True
        return facts
    facts["mass"], facts["parse_errors"] = len(src.tok), src.errors
    rows = text.split("\n")
    base = {"is_async": False, "is_test": is_test, "live_var": "", "pass_through": False, "literal_body": False, "documented": []}
    module = {"unit_idx": 0, "name": "<module>", "qualname": "<module>", "line": 1, "lines": facts["lines"], "is_module": True, "is_method": False, "is_public": False,
              "named_test": False, "returns": "", "params": [], "calls": [], "counts": {k: int(whole[k]) for k in COUNTERS}}
    facts["units"].append(base | module)
    for n, (u, c) in enumerate(pairs, 1):
        above, doc = u.line - 2, 0
        while 0 <= above < len(rows) and rows[above].strip().startswith(("//", "/*", "*", "#[", "@")):
            doc += rows[above].strip().startswith(("//", "/*", "*"))
            above -= 1
        arity = 0
        if u.returns.startswith("(") and lang in ("go", "rs", "swift"):
            arity = 1 + u.returns.count(",")
        c.update(doc_lines=doc, return_arity=arity)
        inside = src.tok[u.body[0] : u.body[1]]
        calls = [a for a, b in zip(inside, inside[1:], strict=False) if b == "(" and a[:1].isalpha() and a not in NOT_NAMES]
        c["assert_calls"] = sum(x.lower().startswith(("assert", "expect", "require")) for x in calls)
        c["sleep_calls"] = sum(x.lower() == "sleep" for x in calls)
        facts["units"].append(base | {
            "unit_idx": n, "name": u.name, "qualname": f"{u.scope}.{u.name}" if u.scope else u.name, "line": u.line, "lines": u.end - u.line + 1, "is_module": False,
            "is_method": bool(u.scope), "is_public": _public(lang, u), "is_async": "async" in u.mods, "named_test": is_test and u.name.lower().startswith("test"),
            "returns": u.returns, "params": src.params(u), "calls": calls, "counts": {k: int(c[k]) for k in COUNTERS},
        })
        if facts["units"][-1]["is_public"]:
            facts["exports"].append(u.name)
    for a, b, name in src.boxes:
        head = a
        while head and src.tok[head - 1] not in (";", "}", "{"):
            head -= 1
        if {"interface", "protocol", "trait"} & set(src.tok[head:a]):
            wide = sum(src.get(i + 1) == "(" and src.kind[i] == "i" and src.scope(i).split(".")[-1] == name for i in range(a + 1, b) if not any(x.body[0] < i < x.body[1] for x in src.units))
            facts["interfaces"].append({"name": name, "line": src.line[head], "methods": wide})
    return facts
