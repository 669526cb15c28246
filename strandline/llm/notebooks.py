"""The text of notebooks in their layouts: flattened cells as they are, or the strings inside a notebook's JSON."""

from __future__ import annotations

import json
import re

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)


def _cell_strings(cell: dict) -> list[tuple[dict, str]]:
    """(holder, field) of each string of a cell: its source, then what its outputs show."""
    found = [(cell, "source")]
    for out in cell.get("outputs") or []:
        if isinstance(out, dict):
            found += [(out, f) for f in ("ename", "evalue", "text", "traceback") if f in out]
            if isinstance(out.get("data"), dict):
                found += [(out["data"], f) for f in out["data"]]
    return [(h, f) for h, f in found if f in h]


def _joined(value, field: str) -> str:
    """Lists hold the lines of one string; a traceback's lines carry no line ends of their own."""
    if isinstance(value, list):
        return ("\n" if field == "traceback" else "").join(x for x in value if isinstance(x, str))
    return value if isinstance(value, str) else ""


def _parsed(text: str) -> dict | None:
    try:
        j = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return j if isinstance(j, dict) and isinstance(j.get("cells"), list) else None


def plain_text(text: str | None, layout: str | None) -> str:
    """The decoded strings of a ``json`` notebook's cells, one after another; any other text as it is.

    JSON that does not parse is read as text with its escapes resolved.
    """
    if not text:
        return ""
    if layout != "json":
        return text
    j = _parsed(text)
    if j is None:
        return _ESCAPE.sub(_resolved, text)
    return "\n".join(_joined(h[f], f) for h, f in _strings(j))


def _strings(notebook: dict) -> list[tuple[dict, str]]:
    return [x for c in notebook["cells"] if isinstance(c, dict) for x in _cell_strings(c)]


def _resolved(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else ("\n" if m[2] in "nrt" else m[2])


def without(text: str, layout: str | None, cuts: list[tuple[int, int]]) -> str:
    """``text`` without the stretches ``cuts`` (from, to; in order, apart) of its :func:`plain_text`.

    A stretch may run over several strings of a notebook; each loses its part, and the notebook is written again. In JSON
    that does not parse an escape goes with the letter it stands for.
    """
    if layout != "json":
        return _without(text, 0, cuts)
    j = _parsed(text)
    if j is None:
        at: list[int] = []  # where each letter of the plain text begins
        end = 0
        for m in _ESCAPE.finditer(text):
            at += range(end, m.start() + 1)
            end = m.end()
        at += range(end, len(text) + 1)
        return _without(text, 0, [(at[a], at[b]) for a, b in cuts])
    start = 0
    for h, f in _strings(j):
        old = _joined(h[f], f)
        new = _without(old, start, cuts)
        start += len(old) + 1
        if new != old:
            h[f] = new.splitlines(keepends=f != "traceback") if isinstance(h[f], list) else new
    return json.dumps(j, indent=1)


def _without(s: str, start: int, cuts: list[tuple[int, int]]) -> str:
    """A string that begins at ``start`` of the plain text."""
    out, end = [], 0
    for a, b in cuts:
        a, b = max(a - start, 0), min(b - start, len(s))
        if a < b:
            out.append(s[end:a])
            end = b
    return "".join(out) + s[end:]
