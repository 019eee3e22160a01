"""Text rules shared by operators: white space, words, token estimate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters for which str.isspace holds.
WS_CHARS = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"

#: The same as a class of RE2 (DuckDB).
WS_RE2 = "[" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", WS_CHARS) + "]"

#: Words are maximal runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


def strip(c: Column) -> Column:
    """Cut white space (as str.strip does) from both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    """No character but white space; null for null."""
    return ~c.rlike(NOT_WS)


def estimated_tokens(c: Column) -> Column:
    """Characters // 4."""
    return F.floor(F.char_length(c) / 4).cast("int")
