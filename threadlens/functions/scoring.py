"""Label, error-class, score and template expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import ColumnOrName, clean_text, col_, is_blank, lower_clean, try_number

# --- fixed values -----------------------------------------------------------
VALID_LABELS = [
    "workaround", "feature_request", "bug_report", "user_confusion",
    "general_complaint", "not_actionable",
]
VALID_CONFIDENCE = ["high", "medium", "low"]
WORKAROUND_FIELDS = [
    "user_goal", "obstacle", "workaround", "human_cost", "underlying_need", "evidence_quote",
]
POSITIVE = "workaround"
NEGATIVE = "no_workaround"
DEFAULT_THRESHOLD = 0.50

# Opportunity score weights.
CONFIDENCE_WEIGHTS = [("high", 3.0), ("medium", 2.0), ("low", 1.0)]
HUMAN_COST_WEIGHT = 2.0
OBSTACLE_WEIGHT = 1.5
UNDERLYING_NEED_WEIGHT = 1.5
EVIDENCE_QUOTE_WEIGHT = 1.0
COMMENTS_CAP, COMMENTS_WEIGHT = 10.0, 0.1
HEURISTIC_CAP, HEURISTIC_WEIGHT = 5.0, 0.2

# Human-cost classes: substring keywords on the lower-cased cost text.
COST_KEYWORDS = [
    ("time", ["time", "slow", "delay", "waiting"]),
    ("effort", ["manual", "repeat", "effort", "extra step"]),
    ("risk", ["error", "risk", "lose", "failure", "break"]),
    ("friction", ["confusing", "frustrating", "difficult", "annoying"]),
]
COST_UNSPECIFIED = "unspecified"

# Opportunity sentence.
STATEMENT_TEMPLATE = "Users need a better way to %s without having to %s."

# Audit decision codes.
AUDIT_CODES = [
    ("e", "explicit", "model_failure"),
    ("i", "implicit_but_supported", "contextual_inference_failure"),
    ("n", "not_present", "annotation_error"),
]

# Annotation ids.
ANNOTATION_ID_PREFIX = "NS"
ANNOTATION_ID_FORMAT = "%s-%04d"
# -----------------------------------------------------------------------------


def label_name(flag: ColumnOrName) -> Column:
    """1/0 (or true/false) -> workaround / no_workaround."""
    c = col_(flag).cast("int")
    return F.when(c == 1, F.lit(POSITIVE)).when(c == 0, F.lit(NEGATIVE))


def threshold_label(prob: ColumnOrName, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Probability >= threshold -> workaround."""
    return F.when(col_(prob) >= F.lit(threshold), F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def keyword_rule(score: ColumnOrName) -> Column:
    """The keyword heuristic as a classifier (score > 0; unparsable -> 0)."""
    s = F.coalesce(try_number(score), F.lit(0.0))
    return F.when(s > 0, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def error_type(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    """T11 (trainer form): false_negative / false_positive / ``""``."""
    a, p = col_(actual), col_(predicted)
    return (
        F.when((a == POSITIVE) & (p == NEGATIVE), F.lit("false_negative"))
        .when((a == NEGATIVE) & (p == POSITIVE), F.lit("false_positive"))
        .otherwise(F.lit(""))
    )


def outcome_type(actual: ColumnOrName, predicted: ColumnOrName) -> Column:
    """T11 (dashboard form): adds correct / not_evaluated / other_error."""
    a = F.coalesce(col_(actual), F.lit(""))
    p = F.coalesce(col_(predicted), F.lit(""))
    return (
        F.when((a == "") | (p == ""), F.lit("not_evaluated"))
        .when(a == p, F.lit("correct"))
        .when((a == POSITIVE) & (p == NEGATIVE), F.lit("false_negative"))
        .when((a == NEGATIVE) & (p == POSITIVE), F.lit("false_positive"))
        .otherwise(F.lit("other_error"))
    )


def _present(c: ColumnOrName) -> Column:
    return ~is_blank(c)


def opportunity_score(
    confidence: ColumnOrName = "confidence",
    human_cost: ColumnOrName = "human_cost",
    obstacle: ColumnOrName = "obstacle",
    underlying_need: ColumnOrName = "underlying_need",
    evidence_quote: ColumnOrName = "evidence_quote",
    comments_count: ColumnOrName | None = "comments_count",
    heuristic_score: ColumnOrName | None = "heuristic_score",
) -> Column:
    """Additive evidence score, rounded half-even to 2 digits.

    Non-numeric counts contribute nothing; counts above the caps are capped;
    there is no lower clamp. Terms are added in a fixed order so the double
    result is reproducible.
    """
    conf = lower_clean(confidence)
    weight = F.lit(0.0)
    for name, w in CONFIDENCE_WEIGHTS:
        weight = F.when(conf == name, F.lit(w)).otherwise(weight)
    score = F.lit(0.0) + weight
    score = score + F.when(_present(human_cost), F.lit(HUMAN_COST_WEIGHT)).otherwise(F.lit(0.0))
    score = score + F.when(_present(obstacle), F.lit(OBSTACLE_WEIGHT)).otherwise(F.lit(0.0))
    score = score + F.when(_present(underlying_need), F.lit(UNDERLYING_NEED_WEIGHT)).otherwise(F.lit(0.0))
    score = score + F.when(_present(evidence_quote), F.lit(EVIDENCE_QUOTE_WEIGHT)).otherwise(F.lit(0.0))
    if comments_count is not None:
        cc = try_number(comments_count)
        score = score + F.when(cc.isNotNull(), F.least(cc, F.lit(COMMENTS_CAP)) * F.lit(COMMENTS_WEIGHT)).otherwise(F.lit(0.0))
    if heuristic_score is not None:
        hs = try_number(heuristic_score)
        score = score + F.when(hs.isNotNull(), F.least(hs, F.lit(HEURISTIC_CAP)) * F.lit(HEURISTIC_WEIGHT)).otherwise(F.lit(0.0))
    return F.bround(score, 2)


def cost_type(human_cost: ColumnOrName = "human_cost") -> Column:
    """Substring keyword classes joined by `` | ``, else ``unspecified``."""
    text = lower_clean(human_cost)
    classes = []
    for name, words in COST_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        classes.append(F.when(hit, F.lit(name)))
    joined = F.array_join(F.array_compact(F.array(*classes)), " | ")
    return F.when(joined == "", F.lit(COST_UNSPECIFIED)).otherwise(joined)


def opportunity_statement(user_goal: ColumnOrName = "user_goal", workaround: ColumnOrName = "workaround") -> Column:
    """T17."""
    return F.format_string(STATEMENT_TEMPLATE, clean_text(user_goal), clean_text(workaround))


def annotation_id(seq: ColumnOrName, prefix: str = ANNOTATION_ID_PREFIX) -> Column:
    """``NS-0001`` ... (widens past 9999 instead of truncating)."""
    return F.format_string(ANNOTATION_ID_FORMAT, F.lit(prefix), col_(seq).cast("long"))


def has_workaround_from_label(label: ColumnOrName) -> Column:
    """T19."""
    return F.when(lower_clean(label) == POSITIVE, F.lit("yes")).otherwise(F.lit("no"))


def audit_status(code: ColumnOrName) -> Column:
    """Audit code -> evidence_status (null for unknown codes)."""
    c = lower_clean(code)
    out = F.lit(None).cast("string")
    for k, status, _ in reversed(AUDIT_CODES):
        out = F.when(c == k, F.lit(status)).otherwise(out)
    return out


def audit_outcome(code: ColumnOrName) -> Column:
    """Audit code -> audit_outcome."""
    c = lower_clean(code)
    out = F.lit(None).cast("string")
    for k, _, outcome in reversed(AUDIT_CODES):
        out = F.when(c == k, F.lit(outcome)).otherwise(out)
    return out
