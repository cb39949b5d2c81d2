"""The extraction step: (path, lang, text) to nested facts, by Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import brace_front, containers, python_front

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _array(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(_struct(**fields))


PARAM = _array(name=_S, type_name=_S, boolish=_B, kw_splat=_B, splat=_B, optional=_B, typed=_B, loose=_B)
UNIT = _array(
    unit_idx=_I, name=_S, qualname=_S, line=_I, lines=_I, is_module=_B, is_method=_B, is_public=_B, is_async=_B, is_test=_B, named_test=_B, returns=_S, live_var=_S,
    pass_through=_B, literal_body=_B, params=PARAM, documented=T.ArrayType(_S), calls=T.ArrayType(_S), counts=_struct(**{k: _I for k in python_front.COUNTERS}),
)
FACTS = _struct(
    path=_S, lang=_S, lines=_I, blank_lines=_I, comment_lines=_I, parse_errors=_I, too_deep=_B, mass=_I, is_test_file=_B, is_script_file=_B,
    units=UNIT, findings=_array(kind=_S, line=_I), comments=_array(line=_I, role=_S, words=_I, sentences=_I), classes=_array(name=_S, line=_I, groups=_I),
    interfaces=_array(name=_S, line=_I, methods=_I), imports=_array(target=_S, names=T.ArrayType(_S)), exports=T.ArrayType(_S), mentions=T.ArrayType(_S),
    sites=_array(hash=_S, mass=_I, line=_I, end_line=_I), literals=_array(name=_S, value=_S, line=_I),
)

#: What a lexer needs to know of a language: its line comment, block comment and import forms.
_SLASH = ("//", "/*", "*/", r"^\s*(?:import|using|use|#include)\s+[\"<(]?([\w./:-]+)")
_HASH = ("#", None, None, r"^\s*(?:require|require_relative|use|source|import)\s+[\"']?([\w./:-]+)")
LEXERS = dict.fromkeys("rs ts tsx go js java cs swift scala sol c cpp cu zig php".split(), _SLASH)
LEXERS |= dict.fromkeys("rb pl sh ex".split(), _HASH)
LEXERS |= {"lua": ("--", "--[[", "]]", r"require\s*\(?[\"']([\w./-]+)"), "ml": (None, "(*", "*)", r"^\s*open\s+([\w.]+)")}


def lex(path: str, lang: str, text: str, is_test: bool, is_script: bool) -> dict:
    """Facts that need no structure. What a lexer cannot tell is absent, never 0: without units no
    unit metric is measured."""
    line_mark, opening, closing, imports = LEXERS[lang]
    rows = text.split("\n")
    rows = rows[:-1] if rows and rows[-1] == "" else rows
    facts = {
        "path": path, "lang": lang, "lines": len(rows), "blank_lines": 0, "comment_lines": 0, "parse_errors": 0, "too_deep": False, "mass": 0,
        "is_test_file": is_test, "is_script_file": is_script,
    } | {k: [] for k in ("units", "findings", "comments", "classes", "interfaces", "imports", "exports", "mentions", "sites", "literals")}
    inside, names = False, set()
    for n, row in enumerate(rows, 1):
        body = row.strip()
        note = None
        if not body:
            facts["blank_lines"] += 1
        elif inside or (opening and body.startswith(opening)):
            note, inside = body.strip("/*-(){}[] "), closing not in body
        elif line_mark and body.startswith(line_mark):
            note = body.lstrip("/#-! ")
        if note is not None:
            facts["comment_lines"] += 1
            facts["comments"].append(python_front.prose(n, "ModuleHeader" if n == 1 else "Inline", note))
            if re.match(r"(TODO|FIXME|HACK|XXX)(?:$|[:( \t!-])", note):
                facts["findings"].append({"kind": "debt", "line": n})
            if re.search(r"eslint-disable|nolint|@ts-ignore|noinspection|rubocop:disable|shellcheck disable|SuppressWarnings", note):
                facts["findings"].append({"kind": "suppressions", "line": n})
            continue
        if m := re.search(imports, row):
            facts["imports"].append({"target": m[1], "names": []})
        for m in re.finditer(r"([A-Za-z_]\w*)\s*[:=]+\s*[\"']([^\"']{8,})[\"']", row):
            facts["literals"].append({"name": m[1], "value": m[2], "line": n})
        names.update(re.findall(r"[A-Za-z_]\w*", row))
    facts["mentions"] = sorted(names)
    return facts


def facts_of(path: str, lang: str | None, text: str, is_test: bool, is_script: bool) -> dict | None:
    inner = containers.unwrap(path, text)
    if inner:
        lang, text = inner
    if lang == "py":
        return python_front.extract(path, text, is_test, is_script)
    if lang not in LEXERS:
        return None
    facts = lex(path, lang, text, is_test, is_script)
    return brace_front.extract(facts, lang, text, is_test) if lang in brace_front.LANGS else facts


def extract(sources: DataFrame) -> DataFrame:
    """Nested facts of (path, lang, text, is_test_file, is_script_file); unknown languages go."""
    kind = pa.schema(_arrow(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [facts_of(*r.values()) for r in batch.slice(at, 256).to_pylist() if r["text"] is not None]
                rows = [r for r in rows if r]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return sources.select("path", "lang", "text", "is_test_file", "is_script_file").mapInArrow(run, FACTS)


def _arrow(kind: T.DataType):
    if isinstance(kind, T.StructType):
        return [pa.field(f.name, pa.struct(_arrow(f.dataType)) if isinstance(f.dataType, T.StructType) else _arrow(f.dataType)) for f in kind]
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        return pa.list_(pa.struct(_arrow(inner)) if isinstance(inner, T.StructType) else _arrow(inner))
    return {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}[type(kind)]
