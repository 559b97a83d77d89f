"""Text kernels as native Spark column expressions.

All helpers return ``Column`` objects, so they stay inside Catalyst and
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` / ``str.isspace()``
# treat as whitespace, written as one regex class valid in Java and RE2:
# tab, LF, VT, FF, CR, the separators 0x1C-0x1F, NEL (0x85) and every
# Unicode space / line / paragraph separator (\p{Z}).
WS_CLASS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
STRIP_RE = rf"^{WS_CLASS}+|{WS_CLASS}+$"

# Line boundaries of Python's ``str.splitlines()``:
# CRLF, LF, CR, VT, FF, 0x1C, 0x1D, 0x1E, NEL, LINE SEPARATOR, PARAGRAPH SEPARATOR.
LINE_BREAK_RE = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# Tokens for keyword extraction and hashing: word runs, punctuation runs, and
# the newline itself (so a phrase never spans two lines).
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\n"
WORD_RE = r"[\p{L}\p{N}_]+"

# The reference's post-OCR repair rules, applied in this order.
DEFAULT_REPAIRS: tuple[tuple[str, str], ...] = (("I1em", "Item"), ("$ ", "$"), (" - ", "-"))


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(col_of(c), STRIP_RE, "")


def is_blank(c: str | Column) -> Column:
    return py_strip(c) == ""


def split_lines(c: str | Column) -> Column:
    """``str.splitlines()`` as an array (a trailing empty piece may remain)."""
    return F.split(col_of(c), LINE_BREAK_RE)


def clean_lines(c: str | Column) -> Column:
    """Stripped, non-blank lines in order (array)."""
    stripped = F.transform(split_lines(c), lambda x: F.regexp_replace(x, STRIP_RE, ""))
    return F.filter(stripped, lambda x: x != "")


def join_lines(arr: Column, sep: str = "\n") -> Column:
    return F.array_join(arr, sep)


def dedup_lines(c: str | Column) -> Column:
    """First-occurrence dedup of stripped non-blank lines, order kept (L4)."""
    return join_lines(F.array_distinct(clean_lines(c)))


def cleanup_lines(c: str | Column) -> Column:
    """Strip every line, drop blanks, rejoin."""
    return join_lines(clean_lines(c))


def apply_replacements(c: str | Column, rules: Sequence[tuple[str, str]] = DEFAULT_REPAIRS) -> Column:
    out = col_of(c)
    for search, repl in rules:
        out = F.replace(out, F.lit(search), F.lit(repl))
    return out


def repair_lines(c: str | Column, rules: Sequence[tuple[str, str]] = DEFAULT_REPAIRS) -> Column:
    """Literal repairs on every line, strip, drop empties, rejoin (L3)."""
    fixed = F.transform(
        split_lines(c), lambda x: F.regexp_replace(apply_replacements(x, rules), STRIP_RE, "")
    )
    return join_lines(F.filter(fixed, lambda x: x != ""))


def tokens(c: str | Column) -> Column:
    """Lower-cased token stream: words, punctuation runs and newlines."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(TOKEN_RE), 0)


def words(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(WORD_RE), 0)


def ordered_concat(value: str, order: str, sep: str) -> Column:
    """Ordered string aggregate (``listagg ... WITHIN GROUP (ORDER BY ...)``)."""
    sep_sql = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg({value}, '{sep_sql}') WITHIN GROUP (ORDER BY {order})")
