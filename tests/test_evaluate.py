from threadlens.operators import evaluate as EV


def flags(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "actual_flag int, predicted_flag int")


def test_published_baseline_counts(spark):
    # baseline: TN 39 / FP 6 / FN 12 / TP 3 -> accuracy 0.70, recall 0.20
    m = EV.binary_metrics(flags(spark, 39, 6, 12, 3)).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.7, 0.3333, 0.2, 0.25)
    # keyword rule: TN 19 / FP 26 / FN 2 / TP 13 -> 0.533 / 0.333 / 0.867
    k = EV.binary_metrics(flags(spark, 19, 26, 2, 13)).first()
    assert (k["accuracy"], k["precision"], k["recall"]) == (0.5333, 0.3333, 0.8667)


def test_published_improved_report(spark):
    rep = {r["class_name"]: r for r in EV.classification_report(flags(spark, 38, 7, 14, 1)).collect()}
    w = rep["workaround"]
    assert (w["precision"], w["recall"], w["f1_score"], w["support"]) == (0.125, 0.0667, 0.087, 15)
    n = rep["no_workaround"]
    assert (n["precision"], n["recall"], n["f1_score"], n["support"]) == (0.7308, 0.8444, 0.7835, 45)
    assert rep["accuracy"]["f1_score"] == 0.65
    assert (rep["macro avg"]["precision"], rep["macro avg"]["recall"], rep["macro avg"]["f1_score"]) == (0.4279, 0.4556, 0.4352)
    assert (rep["weighted avg"]["precision"], rep["weighted avg"]["recall"], rep["weighted avg"]["f1_score"]) == (0.5793, 0.65, 0.6094)
    assert rep["balanced_accuracy"]["recall"] == 0.4556


def test_zero_denominators(spark):
    m = EV.binary_metrics(flags(spark, 10, 0, 0, 0)).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (1.0, 0.0, 0.0, 0.0)
    rep = {r["class_name"]: r for r in EV.classification_report(flags(spark, 0, 0, 5, 0)).collect()}
    assert rep["workaround"]["precision"] == 0.0 and rep["no_workaround"]["recall"] == 0.0


def test_error_table_and_metrics_record(spark):
    rows = [("a", "workaround", "no_workaround", 0.2), ("b", "no_workaround", "workaround", 0.9), ("c", "workaround", "workaround", 0.8), ("d", "workaround", "no_workaround", 0.1)]
    p = spark.createDataFrame(rows, "annotation_id string, actual_label string, model_prediction string, workaround_probability double")
    e = [(r["annotation_id"], r["error_type"]) for r in EV.error_table(p).collect()]
    assert e == [("d", "false_negative"), ("a", "false_negative"), ("b", "false_positive")]
    rec = EV.metrics_record(EV.confusion(EV.with_flags(p)), "m", "3-fold", 0.5).first()
    assert rec["false_negatives"] == 2 and rec["confusion_matrix"]["true_positives"] == 1
    assert len(rec["classification_report"]) == 6
