"""False-negative analysis and cue counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.cues import BEHAVIOUR6, LIST_SEPARATOR, CueDictionary
from threadlens.functions.scoring import NEGATIVE, POSITIVE
from threadlens.functions.text import normalize_binary_label, strip_ws, try_number
from threadlens.operators.threads import ANALYSIS_FIELDS, analysis_text
from threadlens.sources.schemas import FN_ANALYSIS_COLUMNS, apply_aliases, existing, require_columns

ANNOTATION_MERGE_FIELDS = [
    "annotation_id", "thread_text", "user_goal", "obstacle", "workaround", "human_cost",
    "underlying_need", "evidence_quote", "confidence",
]


def normalize_predictions(predictions: DataFrame) -> DataFrame:
    """Q3 + T3 + T14: standard names, normalised labels, numeric probability."""
    p = apply_aliases(predictions)
    require_columns(p, ["annotation_id", "actual", "predicted", "probability"], "Predictions file")
    return p.withColumns(
        {
            "actual": normalize_binary_label("actual"),
            "predicted": normalize_binary_label("predicted"),
            "probability": try_number("probability"),
        }
    )


def merge_annotations(predictions: DataFrame, annotations: DataFrame, fields: Sequence[str] = ANNOTATION_MERGE_FIELDS) -> DataFrame:
    """Left join, taking from annotations only the columns the left lacks."""
    take = [c for c in fields if c in annotations.columns and (c == "annotation_id" or c not in predictions.columns)]
    return predictions.join(annotations.select(*take), "annotation_id", "left")


def with_behavioural_cues(df: DataFrame, dictionary: CueDictionary = BEHAVIOUR6, fields: Sequence[str] = ANALYSIS_FIELDS) -> DataFrame:
    """T7 + T9: analysis text, cue names, cue count (one regex pass per cue)."""
    return (
        df.withColumn("analysis_text", analysis_text(df, fields))
        .withColumn("_cues", dictionary.cue_array("analysis_text"))
        .withColumn("behavioral_cue_count", F.size("_cues"))
        .withColumn("behavioral_cues", F.array_join("_cues", LIST_SEPARATOR))
        .drop("_cues")
    )


def false_negatives(combined: DataFrame) -> DataFrame:
    """actual workaround predicted as none."""
    return combined.filter((F.col("actual") == POSITIVE) & (F.col("predicted") == NEGATIVE))


def false_positives(combined: DataFrame) -> DataFrame:
    return combined.filter((F.col("actual") == NEGATIVE) & (F.col("predicted") == POSITIVE))


def fn_analysis(
    predictions: DataFrame,
    annotations: DataFrame,
    dictionary: CueDictionary = BEHAVIOUR6,
    fields: Sequence[str] = ANALYSIS_FIELDS,
) -> DataFrame:
    """False negatives with their behavioural cues, most cues first.

    ``fields`` defaults to the human annotation fields plus the thread (the
    reference's choice); pass ``("title", "thread_text")`` for a thread-only,
    leak-free analysis.
    """
    combined = with_behavioural_cues(merge_annotations(normalize_predictions(predictions), annotations), dictionary, fields)
    fn = false_negatives(combined).orderBy(
        F.desc("behavioral_cue_count"), F.col("probability").asc_nulls_last(), F.col("annotation_id")
    )
    return existing(fn, FN_ANALYSIS_COLUMNS)


def cue_counts(df: DataFrame, cues: str = "behavioral_cues", name: str = "behavioral_pattern", count_name: str = "false_negative_count") -> DataFrame:
    """Split the rendered list, drop blanks, count, most frequent first."""
    exploded = df.select(F.explode(F.split(F.col(cues), r" \| ")).alias(name)).filter(strip_ws(name) != "")
    return exploded.groupBy(name).agg(F.count("*").alias(count_name)).orderBy(F.desc(count_name), F.asc(name))


def error_overview(predictions: DataFrame) -> DataFrame:
    """A14 + F5 counts: evaluated, correct, false negatives, false positives."""
    p = normalize_predictions(predictions)
    a, q = F.col("actual"), F.col("predicted")
    return p.agg(
        F.count("*").alias("evaluated_records"),
        F.count_if(a == q).alias("correct_predictions"),
        F.count_if((a == POSITIVE) & (q == NEGATIVE)).alias("false_negatives"),
        F.count_if((a == NEGATIVE) & (q == POSITIVE)).alias("false_positives"),
    )
