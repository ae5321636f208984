"""End-to-end stages as single calls.

Each function composes the operators the way one stage of the reference ran
them, returns DataFrames (nothing is collected beyond class counts) and, when
given an output folder, writes the stage's tables: Parquet or CSV tables, a
one-row JSON metrics record, and the saved detector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.cues import BEHAVIOUR6, WORKAROUND, CueDictionary
from threadlens.functions.scoring import keyword_rule, label_name
from threadlens.operators import analysis, evaluate, model, opportunity, sampling, threads
from threadlens.sources import io
from threadlens.sources.schemas import (
    BASELINE_PREDICTION_COLUMNS,
    IMPROVED_PREDICTION_COLUMNS,
    existing,
    require_columns,
)

INTERPRETATION_NOTE = "Few rows carry human labels so far, so read these figures as a first estimate."


def prepare_annotation_dataset(
    issues: DataFrame,
    comments: DataFrame,
    sample_size: int = 60,
    dictionary: CueDictionary = WORKAROUND,
    seed: int = sampling.DEFAULT_SEED,
) -> DataFrame:
    """Threads -> cue score -> stratified sample -> ids + blank label columns."""
    return sampling.annotation_batch(threads.build_threads(issues, comments, dictionary), sample_size, seed)


@dataclass
class TrainResult:
    detector: model.Detector
    predictions: DataFrame
    metrics: DataFrame
    errors: DataFrame | None = None
    top_terms: DataFrame | None = None


def _flags(preds: DataFrame, predicted: str) -> DataFrame:
    return evaluate.with_flags(preds, "actual_label", predicted)


def _confusion_aggs(prefix: str, predicted: str) -> list:
    a = F.col("actual_label") == "workaround"
    p = F.col(predicted) == "workaround"
    return [
        F.count_if(~a & ~p).alias(f"{prefix}_tn"),
        F.count_if(~a & p).alias(f"{prefix}_fp"),
        F.count_if(a & ~p).alias(f"{prefix}_fn"),
        F.count_if(a & p).alias(f"{prefix}_tp"),
    ]


def _metric_struct(prefix: str, digits: int = 4) -> F.Column:
    tn, fp, fn, tp = (F.col(f"{prefix}_{x}") for x in ["tn", "fp", "fn", "tp"])

    def div(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a / b)

    return F.struct(
        F.round(div(tp + tn, tn + fp + fn + tp), digits).alias("accuracy"),
        F.round(div(tp, tp + fp), digits).alias("precision"),
        F.round(div(tp, tp + fn), digits).alias("recall"),
        F.round(div(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
    )


def train_baseline(labelled: DataFrame, spec: model.DetectorSpec = model.BASELINE) -> TrainResult:
    """M11 (baseline): out-of-fold word TF-IDF + LR next to the keyword rule.

    One aggregation pass over the predictions yields the metrics row: the
    nested sections (dataset, model, keyword heuristic) and the flat counters
    later stages read (accuracy, false_negatives, false_positives,
    correct/incorrect predictions).
    """
    require_columns(labelled, ["annotation_id", "thread_text", "has_workaround", "heuristic_score"], "Dataset")
    oof = model.out_of_fold(labelled, spec)
    meta_cols = [c for c in ["annotation_id", "repository", "issue_number", "title", "primary_label", "heuristic_score", "matched_patterns"] if c in labelled.columns]
    preds = oof.join(labelled.select(*meta_cols).withColumnRenamed("annotation_id", "doc"), "doc", "left")
    preds = preds.withColumnRenamed("doc", "annotation_id").withColumns(
        {
            "actual_label": label_name("target"),
            "heuristic_prediction": keyword_rule("heuristic_score"),
            "model_prediction": F.when(F.col("probability") >= spec.threshold, F.lit("workaround")).otherwise(F.lit("no_workaround")),
            "workaround_probability": F.round("probability", 4),
        }
    )
    preds = preds.withColumns(
        {
            "model_correct": F.col("model_prediction") == F.col("actual_label"),
            "heuristic_correct": F.col("heuristic_prediction") == F.col("actual_label"),
        }
    )
    agg = preds.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("actual_label") == "workaround").alias("pos"),
        F.count_if(F.col("actual_label") == "no_workaround").alias("neg"),
        (F.max("fold") + 1).alias("folds"),
        *_confusion_aggs("m", "model_prediction"),
        *_confusion_aggs("k", "heuristic_prediction"),
    )
    model_metrics = _metric_struct("m")
    metrics = agg.select(
        F.struct(
            F.col("n").alias("labeled_records"), F.col("pos").alias("workaround_records"),
            F.col("neg").alias("non_workaround_records"), F.col("folds").alias("cross_validation_folds"),
        ).alias("dataset"),
        model_metrics.alias("tfidf_logistic_regression"),
        _metric_struct("k").alias("keyword_heuristic"),
        F.lit(INTERPRETATION_NOTE).alias("interpretation_note"),
        model_metrics["accuracy"].alias("accuracy"),
        F.col("m_fn").alias("false_negatives"),
        F.col("m_fp").alias("false_positives"),
        (F.col("m_tp") + F.col("m_tn")).alias("correct_predictions"),
        (F.col("m_fp") + F.col("m_fn")).alias("incorrect_predictions"),
    )
    det = model.fit_detector(labelled, spec)
    return TrainResult(det, existing(preds, BASELINE_PREDICTION_COLUMNS), metrics, None, model.top_terms(det))


def train_improved(
    labelled: DataFrame,
    baseline_metrics: DataFrame | None = None,
    spec: model.DetectorSpec = model.IMPROVED,
) -> TrainResult:
    """M11 (improved): word + char TF-IDF + cue tokens, OOF, errors, report, comparison.

    The baseline comparison reads the baseline's one-row metrics record (its
    five headline numbers become literals of the new record).
    """
    require_columns(labelled, ["annotation_id", "primary_label"], "Dataset")
    preds = model.oof_predictions(labelled, spec)
    preds = preds.select(*[c for c in IMPROVED_PREDICTION_COLUMNS if c in preds.columns], "fold")
    cm = evaluate.confusion(_flags(preds, "model_prediction"))
    k = preds.agg((F.max("fold") + 1).alias("k")).first()["k"]
    metrics = evaluate.metrics_record(cm, spec.name, f"{k}-fold stratified cross-validation", spec.threshold)
    if baseline_metrics is not None:
        cols = [c for c in ["accuracy", "false_negatives", "false_positives", "correct_predictions", "incorrect_predictions"] if c in baseline_metrics.columns]
        base = baseline_metrics.select(*cols).first()  # one row, five numbers
        metrics = metrics.withColumn(
            "baseline_comparison", F.struct(*[F.lit(base[c]).alias(c) for c in cols]) if base else F.lit(None)
        )
    errors = evaluate.error_table(preds)
    det = model.fit_detector(labelled, spec)
    return TrainResult(det, preds.drop("fold"), metrics, errors)


def write_training(result: TrainResult, out_dir: str) -> None:
    """Predictions and errors as CSV, metrics as JSON, the detector."""
    io.write_csv(result.predictions, f"{out_dir}/predictions")
    if result.errors is not None:
        io.write_csv(result.errors, f"{out_dir}/errors")
    io.write_json(result.metrics.coalesce(1), f"{out_dir}/metrics")
    if result.top_terms is not None:
        io.write_csv(result.top_terms, f"{out_dir}/top_terms")
    model.save_detector(result.detector, f"{out_dir}/detector")


@dataclass
class ErrorAnalysis:
    false_negatives: DataFrame
    pattern_counts: DataFrame
    overview: DataFrame


def analyze_errors(predictions: DataFrame, annotations: DataFrame, dictionary: CueDictionary = BEHAVIOUR6) -> ErrorAnalysis:
    """Missed workarounds with their cues, cue counts, and the evaluated/correct/FN/FP counts."""
    fn = analysis.fn_analysis(predictions, annotations, dictionary)
    return ErrorAnalysis(fn, analysis.cue_counts(fn), analysis.error_overview(predictions))


def build_opportunity_report(annotations: DataFrame) -> DataFrame:
    """Confirmed workarounds scored and ranked (fails when there are none)."""
    return opportunity.build_opportunities(annotations, require_any=True)
