"""JSON objects inside what a model answers, mended where that can't change what they say.

One expression cuts the answer into strings, brackets, commas and the rest. A stack of brackets tells where an object ends, so
text around it doesn't matter; a comma before a closing bracket goes; control characters inside a string are escaped. What a
string says is never touched.
"""

from __future__ import annotations

import json
import re

#: The largest object that is read, in characters, and its deepest nesting.
SIZE, DEPTH = 512 << 10, 20

PART = re.compile(r'(?P<string>"(?:[^"\\]|\\.)*")|(?P<open>[{\[])|(?P<close>[}\]])|(?P<comma>,)|(?P<blank>\s+)|[^"{}\[\],\s]+|"', re.DOTALL)
CONTROL = re.compile(r"[\x00-\x1f]")
PAIRS = {"}": "{", "]": "["}


def _object(text: str, start: int) -> tuple[str | None, int]:
    """The object that begins at ``start``, mended, or None if it doesn't close, is crossed or too deep; and where the reading stopped."""
    stack, made, comma = [], [], False
    for m in PART.finditer(text, start, start + SIZE + 1):
        kind, part = m.lastgroup, m[0]
        if kind == "blank":
            continue
        if comma and kind != "close":
            made.append(",")
        comma = kind == "comma"
        if comma:
            continue
        if kind == "open":
            stack.append(part)
            if len(stack) > DEPTH:
                return None, m.end()
        elif kind == "close":
            if stack.pop() != PAIRS[part]:
                return None, m.end()
        made.append(CONTROL.sub(lambda c: f"\\u{ord(c[0]):04x}", part) if kind == "string" else part + " " * (kind is None))
        if not stack:
            return "".join(made), m.end()
    return None, len(text)


def repair_json(text: str) -> str | None:
    """The first object inside an answer, as JSON with sorted keys; null if there is none, or none of allowed size and depth."""
    at = text.find("{")
    while at >= 0:
        made, end = _object(text, at)
        try:
            found = json.loads(made) if made else None
        except ValueError:
            found = None
        if isinstance(found, dict):
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
        at = text.find("{", end)
    return None
