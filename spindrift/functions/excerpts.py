"""Excerpts, diffs and patches: what works on bytes or on whole small texts."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOUNDARIES = (b"\n\n", b"\n")


def truncated(text: str, most: int) -> str:
    """At most ``most`` bytes, cut after a paragraph, line or statement.

    A text that fits is kept as it is. A cut piece loses white space at its end.
    """
    raw = text.encode()
    if len(raw) <= most:
        return text
    cut = max(0, most)
    while cut and raw[cut] & 0xC0 == 0x80:
        cut -= 1
    head = raw[:cut]
    for mark in _BOUNDARIES:
        at = head.rfind(mark)
        if at >= 0:
            return head[: at + len(mark)].decode().rstrip()
    at = max(head.rfind(x) for x in (b";", b"}", b"{", b"."))
    return (head[: at + 1] if at >= 0 else head).decode().rstrip()


@F.pandas_udf(T.StringType())
def truncate(text: pd.Series, most: pd.Series) -> pd.Series:
    """Column form of :func:`truncated`; null stays null."""
    return pd.Series([None if t is None or pd.isna(m) else truncated(t, int(m)) for t, m in zip(text, most)])


def unified_diff(old: str | None, new: str, name: str) -> str:
    """One hunk over all lines; where there is a choice, removals come first."""
    b = new.split("\n")
    if old is None:
        a, ops = [], [("+", x) for x in b]
    elif old == new:
        return ""
    else:
        a = old.split("\n")
        ops = _edits(a, b)
    source = "/dev/null" if old is None else f"a/{name}"
    lines = [f"--- {source}", f"+++ b/{name}", f"@@ -1,{len(a)} +1,{len(b)} @@", *(s + x for s, x in ops)]
    return "\n".join(lines) + "\n"


def _edits(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    known: dict[str, int] = {}
    x = np.array([known.setdefault(t, len(known)) for t in a], np.int64)
    y = np.array([known.setdefault(t, len(known)) for t in b], np.int64)
    longest = np.zeros((len(a) + 1, len(b) + 1), np.int32)  # common subsequence of the rests
    for i in range(len(a) - 1, -1, -1):
        best = np.where(y == x[i], longest[i + 1, 1:] + 1, longest[i + 1, :-1])
        longest[i, :-1] = np.maximum.accumulate(best[::-1])[::-1] if len(b) else best
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and longest[i + 1, j] >= longest[i, j + 1]):
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out


def patched(raw: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Byte ranges replaced; all other bytes stay. Overlaps are refused."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start < at or end < start or end > len(raw):
            raise ValueError("edits overlap or lie outside the text")
        out += [raw[at:start], new]
        at = end
    return b"".join([*out, raw[at:]])


def unquoted(value: str) -> str:
    """A front matter scalar without its quotes."""
    v = value.strip()
    if len(v) >= 2 and v[0] == v[-1] == '"':
        return re.sub(r"\\(.)", r"\1", v[1:-1])
    return v[1:-1] if len(v) >= 2 and v[0] == v[-1] == "'" else v
