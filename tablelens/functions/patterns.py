"""Wildcard patterns as Spark column predicates.

A pattern may hold ``%`` (any run of characters), ``_`` (one character),
``[a-f]`` and ``[^a-f]`` (one character in or out of a set). Everything else
stands for itself. The pattern is translated once, on the driver, to a single
Java regular expression, so the predicate stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = "(?!)"


def quote(text: str) -> str:
    """``text`` as a regular expression that matches only itself."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def is_literal(pattern: str) -> bool:
    return not any(c in "%_[" for c in pattern)


def _set_regex(body: str) -> str:
    """The regular expression for what stands between ``[`` and ``]``."""
    negated, body = body.startswith("^"), body.removeprefix("^")
    members, i = [], 0
    while i < len(body):
        if body[i + 1 : i + 2] == "-" and i + 2 < len(body):
            low, high = body[i], body[i + 2]
            if low <= high:
                members.append(f"{quote(low)}-{quote(high)}")
            i += 3
        else:
            members.append(quote(body[i]))
            i += 1
    if not members:
        return "." if negated else NEVER
    return f"[{'^' if negated else ''}{''.join(members)}]"


def wildcard_regex(pattern: str) -> str:
    """A regular expression found wherever the wildcard pattern is contained.

    A ``[`` that is never closed makes the whole pattern match nothing.
    """
    inner, out, i = pattern.strip("%"), [], 0
    while i < len(inner):
        c = inner[i]
        if c == "[":
            close = inner.find("]", i + 1)
            if close < 0:
                return NEVER
            out.append(_set_regex(inner[i + 1 : close]))
            i = close
        elif c == "%":
            if out[-1] != ".*":
                out.append(".*")
        else:
            out.append("." if c == "_" else quote(c))
        i += 1
    return "".join(out)


def as_patterns(pattern: str | Iterable[str]) -> list[str]:
    return [pattern] if isinstance(pattern, str) else list(pattern)


def contains_pattern(
    pattern: str | Iterable[str], case_sensitive: bool = False
) -> Callable[[Column], Column]:
    """A predicate: does a text contain the pattern, or any of several?

    It is NULL for a NULL text, which a filter drops. One literal, case-sensitive pattern becomes
    ``contains``, which parquet scans accept as a pushed filter.
    """
    patterns = as_patterns(pattern)
    if not patterns:  # any of none: no text
        return lambda text: text.rlike(NEVER)
    if case_sensitive and len(patterns) == 1 and is_literal(patterns[0]):
        return lambda text: F.contains(text, F.lit(patterns[0]))
    flags = "(?s)" if case_sensitive else "(?siu)"
    regex = flags + "|".join(f"(?:{wildcard_regex(p)})" for p in patterns)
    return lambda text: text.rlike(regex)
