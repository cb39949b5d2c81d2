"""Code inside other files, at its true lines: notebooks, components, workflows, Dockerfiles."""

from __future__ import annotations

import json
import re


def notebook(text: str) -> str | None:
    """The code cells of a notebook, each at the line its source has in the file.

    A cell whose source cannot be found line by line makes the whole notebook unreadable.
    """
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return None
    rows = text.split("\n")
    out, at = [""] * len(rows), 0
    for cell in cells:
        if cell.get("cell_type") != "code":
            continue
        source = cell.get("source", [])
        for part in source if isinstance(source, list) else source.splitlines(keepends=True):
            want = json.dumps(part, ensure_ascii=False)
            plain = json.dumps(part)
            while at < len(rows) and want not in rows[at] and plain not in rows[at]:
                at += 1
            if at == len(rows):
                return None
            code = part.rstrip("\n")
            out[at] = "" if code.startswith(("%", "!")) else code
            at += 1
    return "\n".join(out)


_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)


def component(text: str) -> tuple[str, str] | None:
    """(language, code) of a single-file component: its scripts, all else blank."""
    found = list(_SCRIPT.finditer(text))
    if not found:
        return None
    lang = "ts" if any(re.search(r"lang\s*=\s*[\"']?tsx?", m[1]) for m in found) else "js"
    out, at = [], 0
    blank = lambda s: "\n" * s.count("\n")
    for m in found:
        out += [blank(text[at : m.start(2)]), m[2]]
        at = m.end(2)
    return lang, "".join(out) + blank(text[at:])


_EXPRESSION = re.compile(r"\$\{\{.*?\}\}")


def workflow(text: str) -> str | None:
    """The shell of a workflow's ``run`` keys; expressions become underscores."""
    out, block, any_run = [], None, False
    for line in text.split("\n"):
        depth = len(line) - len(line.lstrip(" "))
        m = re.match(r"\s*(?:-\s+)?run:\s*(.*)$", line)
        if block is not None and (not line.strip() or depth > block):
            out.append(_EXPRESSION.sub(lambda x: "_" * len(x[0]), line))
            any_run |= bool(line.strip())
            continue
        block = None
        if m and re.match(r"[|>][+-]?\d?\s*(#.*)?$", m[1]):
            block = depth
            out.append("")
        elif m and m[1]:
            any_run = True
            out.append(_EXPRESSION.sub(lambda x: "_" * len(x[0]), m[1].strip("\"'")))
        else:
            out.append("")
    return "\n".join(out) if any_run else None


def dockerfile(text: str) -> str | None:
    """The shell of RUN lines, and ENV or ARG settings, with continued lines."""
    out, keep, more = [], False, False
    for line in text.split("\n"):
        if not more:
            m = re.match(r"\s*(RUN|ENV|ARG)\s+(.*)$", line, re.I)
            keep = bool(m) and not (m[1].upper() == "RUN" and m[2].lstrip().startswith("[")) and (m[1].upper() == "RUN" or "=" in m[2])
            out.append(m[2] if keep else "")
        else:
            out.append(line if keep else "")
        more = line.rstrip().endswith("\\")
    return "\n".join(out) if any(x.strip() for x in out) else None


def unwrap(path: str, text: str) -> tuple[str, str] | None:
    """(language, code) if the path names a container, with line numbers kept."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".ipynb"):
        code = notebook(text)
        return ("py", code) if code is not None else None
    if name.endswith((".vue", ".svelte")):
        return component(text)
    if re.search(r"(^|/)\.github/workflows/[^/]+\.ya?ml$", path):
        code = workflow(text)
        return ("sh", code) if code else None
    if name == "Dockerfile" or name.startswith("Dockerfile."):
        code = dockerfile(text)
        return ("sh", code) if code else None
    return None
