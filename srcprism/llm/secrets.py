"""Secret scans through trigram queries.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain: a
conjunction of the trigrams of its literal runs, a disjunction over its alternatives. Texts are
indexed block by block: an inverted index holds, for every trigram that some rule asks for,
the texts of the block that contain it. Postings are intersected and united as the query says,
and only the candidates are verified by the regex. A rule without mandatory trigrams scans
every text. The index ignores the case of ASCII letters, so it never misses a match.

Edge cases: null and empty texts have no spans; repeated rows come out repeated; matches of a
kind do not overlap, and one that fails its rule's check is dropped without another try;
offsets are code points, ends exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text indexed at a time (a longer text is a block of its own).
BLOCK_BYTES = 1 << 22
#: Alternatives of a class or a branch that are followed; beyond, the rule asks for less.
WIDTH = 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    base: bool = False
    #: Whether a match is kept.
    check: Callable[[re.Match], bool] | None = None


def _varied(m: re.Match) -> bool:
    return len(set(m[0])) >= 10


#: The base kinds come first; the others add spans.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", True, lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", True, lambda m: len(m[0]) >= 18),
    Rule("hex", r"[0-9a-f]{16,}", True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", check=_varied),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", check=_varied),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}", check=_varied),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", check=_varied),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^/\s:@]{1,64}:[^/\s:@]{8,64}@"),
)

#: A query: a trigram, ("and", queries) or ("or", queries); ("and", ()) holds for every text.
Query = bytes | tuple
EVERY: Query = ("and", ())


def _all(parts: list[Query]) -> Query:
    flat = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list[Query]) -> Query:
    if any(p == EVERY for p in parts):
        return EVERY
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> Query:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """What trigrams (of ASCII-lower-cased UTF-8) a match of ``pattern`` must contain."""

    def walk(tokens) -> tuple[Query, set[bytes] | None]:
        """A query that holds, and the exact strings matched if they are few."""
        queries, run = [], {b""}

        def close() -> None:
            nonlocal run
            if run != {b""}:
                queries.append(_of_strings(run))
            run = {b""}

        exact = True
        for op, arg in tokens:
            strings: set[bytes] | None = None
            query: Query = EVERY
            if op is C.LITERAL:
                strings = {chr(arg).encode("utf-8", "surrogatepass").lower()}
            elif op is C.IN:
                strings = _class(arg)
            elif op is C.SUBPATTERN:
                query, strings = walk(arg[3])
            elif op is C.BRANCH:
                each = [walk(b) for b in arg[1]]
                query = _any([q for q, _ in each])
                if all(s is not None for _, s in each):
                    strings = set().union(*(s for _, s in each))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = arg
                inner_query, inner_strings = walk(inner)
                if low:
                    query = inner_query
                if inner_strings is not None and low == high == 1:
                    strings = inner_strings
                elif inner_strings is not None and (low, high) == (0, 1):
                    strings = inner_strings | {b""}
                elif inner_strings is not None and low == high and low <= 8 and len(inner_strings) == 1:
                    strings = {next(iter(inner_strings)) * low}
            elif op is C.AT:
                continue
            if strings is not None and len(run) * len(strings) <= WIDTH * 2:
                run = {a + b for a in run for b in strings}
                if query != EVERY and strings is not None and all(len(s) >= 3 for s in strings):
                    queries.append(query)
            else:
                exact = False
                close()
                queries.append(query)
                if strings is not None and len(strings) <= WIDTH:
                    run = set(strings)
        whole = set(run) if exact else None
        close()
        return _all([q for q in queries if q != EVERY] or [EVERY]), whole

    return walk(_parser.parse(pattern))[0]


def _class(items) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, arg in items:
        codes = [arg] if op is C.LITERAL else range(arg[0], arg[1] + 1) if op is C.RANGE else None
        if codes is None or len(codes) > WIDTH:
            return None
        found |= {chr(c).encode("utf-8", "surrogatepass").lower() for c in codes}
    return found if len(found) <= WIDTH else None


def trigrams_of(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of the asked trigrams over one block of texts."""

    def __init__(self, texts: list[bytes], asked: list[bytes], place: np.ndarray):
        joined = b"\0".join(t.lower() for t in texts) + b"\0\0"
        data = np.frombuffer(joined, np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        number = data[:-2].astype(np.uint32) << 16
        number |= data[1:-1].astype(np.uint32) << 8
        number |= data[2:]
        slot = place[number]
        at = np.flatnonzero(slot)
        pairs = np.unique(slot[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, side="right") - 1)
        cuts = np.searchsorted(pairs, np.arange(1, len(asked) + 2) * len(texts))
        self.n = len(texts)
        self.postings = {t: pairs[cuts[i] : cuts[i + 1]] % max(1, self.n) for i, t in enumerate(asked)}

    def find(self, query: Query) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[query]
        if query == EVERY:
            return np.arange(self.n)
        found = [self.find(q) for q in query[1]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    """Compiled rules, their queries and the table from trigram to posting list."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.asked = sorted(set().union(*map(trigrams_of, self.queries)))
        self.place = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(self.asked):
            self.place[int.from_bytes(t, "big")] = i + 1

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(rule, start, end) of each text, by rule, then start."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        block, size = [], 0
        for i, t in enumerate(texts):
            if t:
                block.append(i)
                size += len(t)
            if block and (size >= BLOCK_BYTES or i == len(texts) - 1):
                self._block(texts, block, out)
                block, size = [], 0
        if block:
            self._block(texts, block, out)
        return out

    def _block(self, texts: list[str | None], block: list[int], out: list) -> None:
        index = Index([texts[i].encode() for i in block], self.asked, self.place)
        for r, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries, strict=True)):
            for k in index.find(query):
                i = block[k]
                out[i] += [(r, m.start(), m.end()) for m in regex.finditer(texts[i]) if rule.check is None or rule.check(m)]


def scanner() -> Scanner:
    return common.worker_state("secrets", None, Scanner)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of (kind, start, end)) for each row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [r.kind for r in RULES]
        found = [[{"kind": kinds[r], "start": s, "end": e} for r, s, e in x] for x in scanner().scan(batch.column(1).to_pylist())]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_batches(rows, each, "doc_id long, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by ``[SECRET]``."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, e in sorted((s, e) for _, s, e in spans):
        if s >= end:
            out += [text[at:s], "[SECRET]"]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, with its secrets redacted and n_chars corrected.

    Null texts and null counts of texts that do not change stay as they are; rows that repeat are
    redacted alike.
    """
    names = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        new = [redact(t, x) for t, x in zip(texts, scanner().scan(texts), strict=True)]
        columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        if "n_chars" in names:
            k = names.index("n_chars")
            sizes = [n if a is b else len(a) for n, a, b in zip(batch.column(k).to_pylist(), new, texts, strict=True)]
            columns[k] = pa.array(sizes, pa.int64())
        return pa.record_batch(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_batches(docs, each, schema)
