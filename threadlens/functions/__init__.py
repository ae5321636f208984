"""Column-expression building blocks (no UDFs)."""

from threadlens.functions.cues import (
    BEHAVIOUR6,
    BEHAVIOUR8,
    WORKAROUND,
    CueDictionary,
    augment_text,
    cue_count,
    cue_names,
    cue_tokens,
    heuristic_score,
    with_cues,
)
from threadlens.functions.scoring import (
    annotation_id,
    audit_outcome,
    audit_status,
    cost_type,
    error_type,
    has_workaround_from_label,
    keyword_rule,
    label_name,
    opportunity_score,
    opportunity_statement,
    outcome_type,
    threshold_label,
)
from threadlens.functions.text import (
    clean_text,
    is_blank,
    lower_clean,
    normalize_binary_label,
    normalize_text,
    primary_label_target,
    strip_accents,
    strip_ws,
    text_length,
    try_number,
    yes_no_target,
)

__all__ = [name for name in dir() if not name.startswith("_")]
