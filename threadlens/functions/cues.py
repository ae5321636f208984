"""Regex cue dictionaries as native Spark expressions.

A dictionary is an ordered list of ``(name, pattern)``. Detection builds one
``array(when(rlike, name), ...)`` per row, so every regex runs once in the JVM
and count / names / tokens are all derived from that single array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import ColumnOrName, col_

# --- fixed values: cue dictionaries (order matters: it is the output order) ---
# Workaround language used to score discussions before sampling.
WORKAROUND_8 = [
    ("manual_process", r"\b(manually|manual process|by hand|copy[- ]?paste|copying and pasting)\b"),
    ("forced_action", r"\b(have to|had to|need to|forced to|must first)\b"),
    ("alternative_method", r"\b(instead|alternative|another tool|different tool|external tool)\b"),
    ("explicit_workaround", r"\b(workaround|work around|temporary fix|hacky solution|hack)\b"),
    ("repetition", r"\b(every time|again and again|repeatedly|repeat this|redo|re-enter)\b"),
    ("data_transfer", r"\b(export|import|spreadsheet|csv|download and upload|move the data)\b"),
    ("custom_code", r"\b(custom script|write a script|small script|custom code|unofficial script)\b"),
    ("only_method", r"\b(the only way|only way I can|currently I have to|the best I can do)\b"),
]

# Behavioural cues used by the false-negative analysis.
BEHAVIOUR_6 = [
    ("constraint_language", r"\b(have to|had to|cannot|can't|unable|not supported|only way|doesn't allow)\b"),
    ("manual_intervention", r"\b(manually|by hand|copy|paste|edit|modify|export|import|download|upload)\b"),
    ("alternative_method", r"\b(instead|alternative|another tool|different tool|workaround|custom script|custom code|hack)\b"),
    ("repetition_or_retry", r"\b(every time|repeatedly|again|retry|reconnect|restart|refresh|redo)\b"),
    ("multi_step_sequence", r"\b(first|then|before|after|next|until|followed by)\b"),
    ("successful_compensation", r"\b(this works|worked for me|fixes it|solved it|able to continue|temporary fix)\b"),
]

# Behavioural cues used by the improved detector (text augmentation).
BEHAVIOUR_8 = [
    ("constraint_language", r"\b(have to|had to|cannot|can't|unable|not supported|only way|doesn't allow|won't let me|fails unless)\b"),
    ("manual_intervention", r"\b(manually|by hand|copy|paste|edit|modify|export|import|download|upload|re-enter)\b"),
    ("alternative_method", r"\b(instead|alternative|another tool|different tool|workaround|custom script|custom code|hack)\b"),
    ("repetition_or_retry", r"\b(every time|repeatedly|again|retry|reconnect|restart|refresh|redo|rerun)\b"),
    ("multi_step_sequence", r"\b(first|then|before|after|next|until|followed by)\b"),
    ("successful_compensation", r"\b(this works|worked for me|fixes it|solved it|able to continue|temporary fix|for now)\b"),
    ("avoidance_behavior", r"\b(avoid|stopped using|don't use|disable|turn off|skip)\b"),
    ("external_storage", r"\b(spreadsheet|csv|excel|external database|google sheets|local file)\b"),
]
CUE_TOKEN_PREFIX = "behavioral_cue_"
LIST_SEPARATOR = " | "
# ---------------------------------------------------------------------------

# Case-insensitive with Unicode case folding and Unicode \b / \w (Python
# ``re.IGNORECASE`` on str patterns); (?U) keeps \b Unicode on every JDK.
SPARK_FLAGS = "(?iU)"

# RE2 (DuckDB) has an ASCII-only \b; the oracle spells the Unicode boundary out.
_RE2_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_RE2_NONWORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


@dataclass(frozen=True)
class CueDictionary:
    name: str
    entries: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, name: str, entries) -> "CueDictionary":
        pairs = tuple((str(n), str(p)) for n, p in entries)
        if not pairs:
            raise ValueError("a cue dictionary needs at least one entry")
        for _, p in pairs:
            re.compile(p)
        return cls(name, pairs)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.entries]

    def spark_pattern(self, pattern: str) -> str:
        return SPARK_FLAGS + pattern

    def any_pattern(self) -> str:
        """One alternation that matches when any cue matches (cheap prefilter)."""
        return SPARK_FLAGS + "(?:" + "|".join(f"(?:{p})" for _, p in self.entries) + ")"

    # -- Spark expressions -------------------------------------------------
    def cue_array(self, text: ColumnOrName) -> Column:
        """Names of matching cues, dictionary order; empty array when none."""
        t = F.coalesce(col_(text), F.lit(""))
        return F.array_compact(
            F.array(*[F.when(t.rlike(self.spark_pattern(p)), F.lit(n)) for n, p in self.entries])
        )

    def re2_pattern(self, pattern: str) -> str:
        """Oracle form: leading/trailing \\b replaced by explicit Unicode boundaries."""
        p = pattern
        if p.startswith(r"\b"):
            p = f"(?:^|{_RE2_NONWORD})" + p[2:]
        if p.endswith(r"\b"):
            p = p[:-2] + f"(?:$|{_RE2_NONWORD})"
        return "(?i)" + p


WORKAROUND = CueDictionary.of("workaround_8", WORKAROUND_8)
BEHAVIOUR6 = CueDictionary.of("behaviour_6", BEHAVIOUR_6)
BEHAVIOUR8 = CueDictionary.of("behaviour_8", BEHAVIOUR_8)


def cue_count(cues: ColumnOrName) -> Column:
    return F.size(col_(cues))


def cue_names(cues: ColumnOrName, sep: str = LIST_SEPARATOR) -> Column:
    """Rendered list, ``""`` when no cue matched."""
    return F.array_join(col_(cues), sep)


def with_cue_array(df, text: str, dictionary: CueDictionary, out: str):
    """Add the cue array as a generator's output, so that the regexes run once per row.

    A filter or a second use of a plain column would inline the whole cue
    expression again; what a generator makes stays a value.
    """
    return df.select("*", F.explode(F.array(dictionary.cue_array(text))).alias(out))


def with_cues(df, text: str, dictionary: CueDictionary, prefix: str):
    """Add ``<prefix>_cues`` (array), ``<prefix>_score`` and ``<prefix>_names``."""
    arr = f"{prefix}_cues"
    return (
        df.withColumn(arr, dictionary.cue_array(text))
        .withColumn(f"{prefix}_score", F.size(arr))
        .withColumn(f"{prefix}_names", F.array_join(arr, LIST_SEPARATOR))
    )


def heuristic_score(df, text: str = "thread_text", dictionary: CueDictionary = WORKAROUND):
    """``heuristic_score`` (int) and ``matched_patterns`` (`` | ``-joined)."""
    return (
        df.withColumn("_cues", dictionary.cue_array(text))
        .withColumn("heuristic_score", F.size("_cues"))
        .withColumn("matched_patterns", F.array_join("_cues", LIST_SEPARATOR))
        .drop("_cues")
    )


def cue_tokens(cues: ColumnOrName, repeat: int = 2) -> Column:
    """T10 tokens: each cue becomes ``behavioral_cue_<name>`` repeated ``repeat`` times."""
    return F.flatten(
        F.transform(col_(cues), lambda n: F.array_repeat(F.concat(F.lit(CUE_TOKEN_PREFIX), n), repeat))
    )


def augment_text(text: ColumnOrName, cues: ColumnOrName, repeat: int = 2) -> Column:
    """Append the cue tokens after a blank line; unchanged when no cue matched."""
    t = col_(text)
    c = col_(cues)
    return F.when(
        F.size(c) > 0,
        F.concat(t, F.lit("\n\n"), F.array_join(cue_tokens(c, repeat), " ")),
    ).otherwise(t)
