"""Character classes for Python's re, built from the Unicode database."""

from __future__ import annotations

import functools
import sys
import unicodedata

#: The Unicode White_Space property, below each end.
WHITE_SPACE = {
    0x80: "\\t-\\r ",
    0x100: "\\t-\\r \\x85\\xa0",
    sys.maxunicode + 1: "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000",
}


@functools.lru_cache
def category_class(major: str, end: int = sys.maxunicode + 1) -> str:
    """The inside of a [...] with all characters below ``end`` whose general category starts with ``major``."""
    spans: list[list[int]] = []
    for c in range(end):
        if unicodedata.category(chr(c))[0] == major:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in spans)
