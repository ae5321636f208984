"""Binary evaluation: confusion matrix, metrics, report, errors.

Every metric table is one aggregation pass; results are one-row (or
one-row-per-class) DataFrames, never driver-side loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.scoring import NEGATIVE, POSITIVE, error_type, keyword_rule, label_name
from threadlens.functions.text import try_number

CLASS_NAMES = [(0, NEGATIVE), (1, POSITIVE)]


def _div(num: Column, den: Column) -> Column:
    """Zero-division -> 0 (not null, not an error)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion(df: DataFrame, actual: str = "actual_flag", predicted: str = "predicted_flag") -> DataFrame:
    """A2: tn / fp / fn / tp with labels fixed to [0, 1] — one row, one pass."""
    a, p = F.col(actual), F.col(predicted)
    return df.agg(
        F.count_if((a == 0) & (p == 0)).alias("true_negatives"),
        F.count_if((a == 0) & (p == 1)).alias("false_positives"),
        F.count_if((a == 1) & (p == 0)).alias("false_negatives"),
        F.count_if((a == 1) & (p == 1)).alias("true_positives"),
    )


def metrics_from_confusion(cm: DataFrame, digits: int | None = 4) -> DataFrame:
    """A3: accuracy / precision / recall / f1 (positive class), zero-division -> 0."""
    tn, fp, fn, tp = (F.col(c) for c in ["true_negatives", "false_positives", "false_negatives", "true_positives"])
    total = tn + fp + fn + tp
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    accuracy = _div(tp + tn, total)

    def r(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c

    return cm.select(
        "*",
        r(accuracy).alias("accuracy"),
        r(precision).alias("precision"),
        r(recall).alias("recall"),
        r(f1).alias("f1"),
    )


def binary_metrics(df: DataFrame, actual: str = "actual_flag", predicted: str = "predicted_flag", digits: int | None = 4) -> DataFrame:
    return metrics_from_confusion(confusion(df, actual, predicted), digits)


def _report_array(digits: int = 4) -> Column:
    """Per-class rows as an array<struct>, computed from the confusion columns."""
    tn, fp, fn, tp = (F.col(c) for c in ["true_negatives", "false_positives", "false_negatives", "true_positives"])
    n = tn + fp + fn + tp
    # class 0 ("no_workaround"): its true positives are tn
    p0, r0, f0, s0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fn + fp), tn + fp
    p1, r1, f1, s1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn), tp + fn
    acc = _div(tp + tn, n)

    def macro(a: Column, b: Column) -> Column:
        return (a + b) / 2

    def weighted(a: Column, b: Column) -> Column:
        return _div(a * s0 + b * s1, n)

    none = F.lit(None).cast("double")
    rows = [
        (NEGATIVE, p0, r0, f0, s0),
        (POSITIVE, p1, r1, f1, s1),
        ("accuracy", none, none, acc, n),
        ("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), n),
        ("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
        ("balanced_accuracy", none, macro(r0, r1), none, n),
    ]
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("class_name"),
                F.round(p, digits).alias("precision"),
                F.round(r, digits).alias("recall"),
                F.round(f, digits).alias("f1_score"),
                s.cast("long").alias("support"),
            )
            for name, p, r, f, s in rows
        ]
    )


def classification_report(
    df: DataFrame, actual: str = "actual_flag", predicted: str = "predicted_flag", digits: int = 4
) -> DataFrame:
    """A4: per-class precision / recall / f1 / support, accuracy, macro and weighted avg.

    Also emits ``balanced_accuracy`` (mean recall). Built from the one-row
    confusion matrix — no second pass over the data.
    """
    return confusion(df, actual, predicted).select(F.inline(_report_array(digits)))


def keyword_predictions(labelled: DataFrame, target: str = "target") -> DataFrame:
    """M9 for the keyword rule: actual / heuristic labels and correctness flags."""
    pred = keyword_rule("heuristic_score")
    return labelled.withColumns(
        {
            "actual_label": label_name(target),
            "heuristic_prediction": pred,
        }
    ).withColumn("heuristic_correct", F.col("heuristic_prediction") == F.col("actual_label"))


def with_flags(df: DataFrame, actual_label: str = "actual_label", predicted_label: str = "model_prediction") -> DataFrame:
    """0/1 flags from label names for the metric aggregates."""
    return df.withColumns(
        {
            "actual_flag": (F.col(actual_label) == POSITIVE).cast("int"),
            "predicted_flag": (F.col(predicted_label) == POSITIVE).cast("int"),
        }
    )


def error_table(predictions: DataFrame, actual: str = "actual_label", predicted: str = "model_prediction", probability: str = "workaround_probability") -> DataFrame:
    """Incorrect rows with their error type, sorted by type then probability."""
    errs = predictions.filter(F.col(actual) != F.col(predicted)).withColumn("error_type", error_type(actual, predicted))
    order = [F.col("error_type").asc_nulls_last()]
    if probability in errs.columns:
        order.append(try_number(probability).asc_nulls_last())
    if "annotation_id" in errs.columns:
        order.append(F.col("annotation_id"))
    return errs.orderBy(*order)


def comparison_row(name: str, cm: DataFrame) -> DataFrame:
    """One model's headline counters (input of J6)."""
    m = metrics_from_confusion(cm)
    return m.select(
        F.lit(name).alias("model_name"),
        F.col("accuracy"),
        F.col("false_negatives").cast("long").alias("false_negatives"),
        F.col("false_positives").cast("long").alias("false_positives"),
        (F.col("true_positives") + F.col("true_negatives")).cast("long").alias("correct_predictions"),
        (F.col("false_positives") + F.col("false_negatives")).cast("long").alias("incorrect_predictions"),
    )


def model_comparison(baseline: DataFrame, improved: DataFrame) -> DataFrame:
    """The baseline's selected counters beside the new model's (one row each)."""
    return baseline.unionByName(improved)


def metrics_record(
    cm: DataFrame,
    model_name: str,
    evaluation_method: str,
    threshold: float,
) -> DataFrame:
    """One-row metrics record: flat counters *and* the nested confusion/report."""
    m = metrics_from_confusion(cm)
    rec = m.select(
        F.lit(model_name).alias("model_name"),
        F.lit(evaluation_method).alias("evaluation_method"),
        F.lit(float(threshold)).alias("threshold"),
        (F.col("true_negatives") + F.col("false_positives") + F.col("false_negatives") + F.col("true_positives")).alias("evaluated_records"),
        (F.col("true_positives") + F.col("false_negatives")).alias("workaround_records"),
        (F.col("true_negatives") + F.col("false_positives")).alias("no_workaround_records"),
        "accuracy",
        (F.col("true_positives") + F.col("true_negatives")).alias("correct_predictions"),
        (F.col("false_positives") + F.col("false_negatives")).alias("incorrect_predictions"),
        F.col("false_negatives"),
        F.col("false_positives"),
        F.struct("true_negatives", "false_positives", "false_negatives", "true_positives").alias("confusion_matrix"),
        F.col("precision").alias("workaround_precision"),
        F.col("recall").alias("workaround_recall"),
        F.col("f1").alias("workaround_f1"),
        F.round(
            (
                _div(F.col("true_negatives"), F.col("true_negatives") + F.col("false_positives"))
                + _div(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives"))
            ) / 2,
            4,
        ).alias("balanced_accuracy"),
        _report_array().alias("classification_report"),
    )
    return rec
