"""Scalar text functions as native Spark column expressions.

All of them compile to JVM expressions inside whole-stage codegen; none is a
Python UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values ---------------------------------------------------------
# Characters removed by Python's ``str.strip()`` (``str.isspace``); Spark's
# trim/btrim only remove U+0020, so the set is spelled out explicitly.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
    (0x3000, 0x3000),
]
# Binary label synonyms accepted wherever predictions are read.
WORKAROUND_SYNONYMS = ["workaround", "yes", "true", "1", "positive"]
NO_WORKAROUND_SYNONYMS = ["no_workaround", "no workaround", "no", "false", "0", "negative"]
# ---------------------------------------------------------------------------


def _class(fmt: str) -> str:
    parts = []
    for lo, hi in WHITESPACE_RANGES:
        parts.append(fmt.format(lo) if lo == hi else fmt.format(lo) + "-" + fmt.format(hi))
    return "[" + "".join(parts) + "]"


# Java regex form (Spark) and RE2 form (DuckDB oracle) of the same class.
WS_CLASS_JAVA = _class("\\x{{{:X}}}")
WS_CLASS_RE2 = WS_CLASS_JAVA  # RE2 accepts the same \x{..} escapes
STRIP_PATTERN = f"^{WS_CLASS_JAVA}+|{WS_CLASS_JAVA}+$"


def col_(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def made_once(c: Column) -> Column:
    """``c`` as a generator's output, the one of its select: later filters and expressions use
    the value, where a plain column would be inlined, and so made again, in each of them."""
    return F.explode(F.array(c))


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()`` semantics; null becomes ``""``."""
    return F.regexp_replace(F.coalesce(col_(c).cast("string"), F.lit("")), STRIP_PATTERN, "")


def clean_text(c: ColumnOrName) -> Column:
    """Null -> "", surrounding whitespace removed (case kept)."""
    return strip_ws(c)


def normalize_text(c: ColumnOrName) -> Column:
    """CRLF -> LF, runs of space/tab -> one space, 3+ newlines -> 2, strip."""
    t = F.coalesce(col_(c).cast("string"), F.lit(""))
    t = F.regexp_replace(t, "\r\n", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip_ws(t)


def is_blank(c: ColumnOrName) -> Column:
    return strip_ws(c) == F.lit("")


def lower_clean(c: ColumnOrName) -> Column:
    return F.lower(strip_ws(c))


def _synonym_map() -> Column:
    pairs = [(s, "workaround") for s in WORKAROUND_SYNONYMS] + [(s, "no_workaround") for s in NO_WORKAROUND_SYNONYMS]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def normalize_binary_label(c: ColumnOrName) -> Column:
    """Map the accepted synonyms to workaround / no_workaround, else the cleaned text.

    One literal-map lookup keeps the expression small: predicates on the
    result are pushed down by inlining it, and a CASE chain would repeat the
    cleaned value in every branch (and blow past the 64 KB codegen limit).
    """
    v = lower_clean(c)
    return F.coalesce(F.try_element_at(_synonym_map(), v), v)


def primary_label_target(c: ColumnOrName) -> Column:
    """T4: multiclass research label -> 1 for workaround, else 0."""
    return (lower_clean(c) == F.lit("workaround")).cast("int")


def yes_no_target(c: ColumnOrName) -> Column:
    """T4 (baseline form): has_workaround yes/no -> 1/0, anything else null."""
    v = lower_clean(c)
    return F.when(v == "yes", F.lit(1)).when(v == "no", F.lit(0))


def text_length(c: ColumnOrName) -> Column:
    """Length in code points, null counts as empty."""
    return F.length(F.coalesce(col_(c).cast("string"), F.lit("")))


def try_number(c: ColumnOrName) -> Column:
    """Lenient numeric parse (``errors='coerce'``); NaN becomes null."""
    parsed = col_(c).cast("string").try_cast("double")
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Accent folding table built from the Unicode database (NFKD minus marks).

    All characters beyond ASCII whose folded form is a single character, so
    the mapping can run as one native ``translate``.
    """
    src, dst = [], []
    for cp in range(0x80, 0x30000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(folded) == 1 and folded != ch:
            src.append(ch)
            dst.append(folded)
    return "".join(src), "".join(dst)


def strip_accents(c: ColumnOrName) -> Column:
    """Unicode accent stripping as ``translate`` + removal of combining marks; ASCII stays as it is."""
    src, dst = _accent_map()
    text = col_(c)
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(text, src, dst), "\\p{Mn}+", "")).otherwise(text)
