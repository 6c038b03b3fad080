"""The first JSON object or list inside a text, in time that grows with the text alone."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"[ \t\n\r]*+")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_SCALAR = re.compile(r"true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][-+]?[0-9]++)?+")


def _end(text: str, start: int, ends: dict[int, int | None]) -> int | None:
    """Where the object or list that starts here ends, None if it is broken. `ends` remembers this for all that were met:
    one inside another is the same on its own, so none is read twice, and what is open at a fault is broken as a whole."""
    open_at, at, ask = [], start, "value"
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if ask in ("value", "first") and c and c in "[{" and ends.get(at, 0) is not None:
            if at in ends:
                at, ask = ends[at], "more"
            else:
                open_at.append(at)
                at, ask = at + 1, "first" if c == "[" else "first key"
            continue
        if ask in ("first", "first key", "more") and c and c in "]}" and c == ("]" if text[open_at[-1]] == "[" else "}"):
            at += 1
            done = open_at.pop()
            ends[done] = at
            if not open_at:
                return at
            ask = "more"
            continue
        if ask == "more" and c == ",":
            at, ask = at + 1, "value" if text[open_at[-1]] == "[" else "key"
            continue
        if ask in ("key", "first key"):
            key = _STRING.match(text, at)
            colon = _SPACE.match(text, key.end()).end() if key else 0
            if key and text[colon : colon + 1] == ":":
                at, ask = colon + 1, "value"
                continue
        elif ask in ("value", "first"):
            scalar = _STRING.match(text, at) if c == '"' else _SCALAR.match(text, at)
            if scalar:
                at, ask = scalar.end(), "more"
                continue
        ends.update(dict.fromkeys(open_at))
        return None


def first_json(text: str | None) -> str | None:
    """The first object or list of a text in json.dumps' form, None if there is none. One that Python can't hold (nested
    too deep, numbers too long) stays as it is written; lone surrogates stay escaped."""
    ends: dict[int, int | None] = {}
    for m in re.finditer(r"[\[{]", text or ""):
        start = m.start()
        end = ends[start] if start in ends else _end(text, start, ends)
        if end is None:
            continue
        raw = text[start:end]
        try:
            value = json.loads(raw)
            out = json.dumps(value, ensure_ascii=False)
            return out if out.isprintable() or not re.search("[\ud800-\udfff]", out) else json.dumps(value)
        except (RecursionError, ValueError):
            return raw
    return None
