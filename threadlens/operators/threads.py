"""Discussion assembly: ordered comment concat, thread documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.cues import WORKAROUND, CueDictionary, heuristic_score
from threadlens.functions.text import normalize_text, strip_ws
from threadlens.sources.schemas import require_columns

# --- fixed values -------------------------------------------------------------
COMMENT_SEPARATOR = "\n\n--- COMMENT ---\n\n"
TITLE_HEADER = "TITLE:\n"
BODY_HEADER = "ISSUE DESCRIPTION:\n"
DISCUSSION_HEADER = "DISCUSSION:\n"
MODEL_TITLE_PREFIX = "TITLE: "
ANALYSIS_FIELDS = [
    "title", "thread_text", "user_goal", "obstacle", "workaround", "human_cost",
    "underlying_need", "evidence_quote",
]
# ------------------------------------------------------------------------------

THREAD_KEY = ["repository", "issue_number"]


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    sep: str,
    out: str,
    chunk_by: str | None = None,
    chunk_size: int = 512,
) -> DataFrame:
    """Ordered group concat of non-empty ``value`` strings per ``keys``.

    Two levels so a hot group is never sorted/collected row-by-row in one task:
    rows are first concatenated inside chunks of ``chunk_size`` consecutive
    ``chunk_by`` values (map-side partial work spread over many tasks), then the
    per-group step only orders the chunk strings. Empty values are dropped before
    either level, so separators never double up.
    """
    keys = list(keys)
    # Structs sort nulls first; a missing position comes last.
    order = [x for c in order for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    nonempty = df.filter(F.col(value) != "")
    if chunk_by is not None:
        nonempty = nonempty.withColumn("_chunk", F.floor(F.col(chunk_by) / F.lit(chunk_size)))
        level1 = nonempty.groupBy(*keys, "_chunk").agg(
            F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_items")
        )
        level1 = level1.select(*keys, "_chunk", F.array_join(F.transform("_items", lambda s: s["_v"]), sep).alias("_v"))
        return level1.groupBy(*keys).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col("_chunk").isNull().alias("_last"), "_chunk", "_v"))), lambda s: s["_v"]), sep
            ).alias(out)
        )
    return nonempty.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))),
                lambda s: s["_v"],
            ),
            sep,
        ).alias(out)
    )


def comment_threads(comments: DataFrame, keys: Sequence[str] = THREAD_KEY) -> DataFrame:
    """A1: one row per discussion with its normalised comments in thread order.

    Order is ``position_in_thread`` (when present, null last) then
    ``comment_id`` (null last); blank comments are skipped; joined by the comment separator.
    """
    require_columns(comments, ["issue_number", "comment_body"], "Comments table")
    keys = [k for k in keys if k in comments.columns]
    has_pos = "position_in_thread" in comments.columns
    has_id = "comment_id" in comments.columns
    order = (["position_in_thread"] if has_pos else []) + (["comment_id"] if has_id else [])
    cols = [*keys, *order, normalize_text("comment_body").alias("_body")]
    prepared = comments.select(*cols)
    return ordered_concat(
        prepared,
        keys,
        order or ["_body"],
        "_body",
        COMMENT_SEPARATOR,
        "comments_text",
        chunk_by="position_in_thread" if has_pos else None,
    )


def thread_text(title: Column | str = "title", body: Column | str = "body", comments_text: Column | str = "comments_text") -> Column:
    """T5: TITLE / ISSUE DESCRIPTION always, DISCUSSION only when there are comments."""
    ct = comments_text if isinstance(comments_text, Column) else F.col(comments_text)
    ct = F.coalesce(ct, F.lit(""))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit(TITLE_HEADER), normalize_text(title)),
        F.concat(F.lit(BODY_HEADER), normalize_text(body)),
        F.when(ct != "", F.concat(F.lit(DISCUSSION_HEADER), ct)),
    )


def build_threads(
    issues: DataFrame,
    comments: DataFrame,
    dictionary: CueDictionary | None = WORKAROUND,
    keys: Sequence[str] = THREAD_KEY,
) -> DataFrame:
    """A1 + J1 + T5 (+ T8): issues left-joined with their comment text.

    The join key includes the repository so equal issue numbers from two
    repositories never mix.
    """
    require_columns(issues, ["repository", "issue_number", "title", "body", "issue_url"], "Issues table")
    keys = [k for k in keys if k in issues.columns and k in comments.columns]
    ct = comment_threads(comments, keys)
    threads = issues.join(ct, list(keys), "left").withColumn(
        "comments_text", F.coalesce(F.col("comments_text"), F.lit(""))
    )
    threads = threads.withColumn("thread_text", thread_text())
    if dictionary is not None:
        threads = heuristic_score(threads, "thread_text", dictionary)
    return threads


def model_text(title: Column | str = "title", thread: Column | str = "thread_text") -> Column:
    """``TITLE: t`` then the thread, each part only when non-blank."""
    t = normalize_text(title)
    th = normalize_text(thread)
    return F.concat_ws(
        "\n\n",
        F.when(t != "", F.concat(F.lit(MODEL_TITLE_PREFIX), t)),
        F.when(th != "", th),
    )


def analysis_text(df: DataFrame, fields: Sequence[str] = ANALYSIS_FIELDS) -> Column:
    """The non-blank stripped fields that exist, joined by newline."""
    parts = []
    for f in fields:
        if f in df.columns:
            v = strip_ws(f)
            parts.append(F.when(v != "", v))
    if not parts:
        return F.lit("")
    return F.concat_ws("\n", *parts)
