"""Opportunity build: score, cost type, statement, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.scoring import POSITIVE, cost_type, opportunity_score, opportunity_statement
from threadlens.functions.text import lower_clean
from threadlens.sources.schemas import OPPORTUNITY_COLUMNS, existing, require_columns


def confirmed_workarounds(annotations: DataFrame) -> DataFrame:
    """rows whose primary label is workaround."""
    require_columns(annotations, ["primary_label"], "The annotation file")
    return annotations.filter(lower_clean("primary_label") == POSITIVE)


def build_opportunities(annotations: DataFrame, require_any: bool = False) -> DataFrame:
    """Confirmed workarounds scored, classified and ranked by score.

    ``require_any`` runs a cheap existence probe and fails when there are no
    confirmed workarounds (the batch CLI behaviour).
    """
    opp = confirmed_workarounds(annotations)
    if require_any and opp.isEmpty():
        raise ValueError("no annotation is labelled workaround, so there is nothing to score")
    cols = set(annotations.columns)
    opp = opp.withColumns(
        {
            "opportunity_score": opportunity_score(
                comments_count="comments_count" if "comments_count" in cols else None,
                heuristic_score="heuristic_score" if "heuristic_score" in cols else None,
                **{k: (k if k in cols else F.lit("")) for k in ["confidence", "human_cost", "obstacle", "underlying_need", "evidence_quote"]},
            ),
            "cost_type": cost_type("human_cost" if "human_cost" in cols else F.lit("")),
            "opportunity_statement": opportunity_statement(
                "user_goal" if "user_goal" in cols else F.lit(""),
                "workaround" if "workaround" in cols else F.lit(""),
            ),
        }
    )
    tiebreak = [F.col("annotation_id")] if "annotation_id" in cols else []
    return existing(opp.orderBy(F.desc_nulls_last("opportunity_score"), *tiebreak), OPPORTUNITY_COLUMNS)


def top_opportunities(opportunities: DataFrame, n: int = 10) -> DataFrame:
    """O2: top-n preview (TakeOrderedAndProject — per-task top-n, then merge)."""
    return opportunities.orderBy(F.desc_nulls_last("opportunity_score"), F.asc("annotation_id")).limit(n)
