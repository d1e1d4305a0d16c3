"""User patterns are written for Python's ``re``; Spark runs Java's. This bridges the two."""

from __future__ import annotations

import re

from tidyveil.errors import StepError


def java_pattern(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as exc:
        raise StepError(f"pattern {pattern!r} is not valid: {exc}") from exc
    named = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)


def java_replacement(replacement: str) -> str:
    r"""``\1`` and ``\g<name>`` become ``$1`` and ``${name}``; a literal ``$`` is escaped."""
    out, i = [], 0
    while i < len(replacement):
        rest = replacement[i:]
        back = re.match(r"\\g<(\w+)>|\\(\d{1,2})", rest)
        if back:
            name = back.group(1) or back.group(2)
            out.append("$" + name if name.isdigit() else "${" + name + "}")
            i += back.end()
            continue
        if rest[:2] == "\\n":
            out.append("\n")
            i += 2
        elif rest[:2] == "\\t":
            out.append("\t")
            i += 2
        elif rest[0] == "\\":
            out.append("\\\\")
            i += 2 if rest[1:2] == "\\" else 1
        else:
            out.append("\\$" if rest[0] == "$" else rest[0])
            i += 1
    return "".join(out)
