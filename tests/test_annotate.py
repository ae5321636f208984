from datetime import datetime

from threadlens.operators import annotate as AN

COLS = "annotation_id string, primary_label string, has_workaround string, user_goal string, obstacle string, workaround string, human_cost string, underlying_need string, evidence_quote string, confidence string, annotator_notes string"
FULL = ("goal", "obst", "wa", "cost", "need", "quote")


def test_validation_rules(spark):
    rows = [
        ("NS-1", "workaround", "yes", *FULL, "high", ""),            # clean
        ("NS-2", "workaround", "no", "", *FULL[1:], "medium", ""),    # yes/no mismatch + missing goal
        ("NS-3", "Bug_Report", "no", *[""] * 6, "sure", ""),           # bad confidence
        ("NS-4", "feature_request", "yes", *[""] * 6, "", ""),        # blank confidence + mismatch
        ("NS-5", "mystery", "no", *[""] * 6, "", ""),                  # invalid label stops checks
        ("NS-6", "  ", "", *[""] * 6, "", ""),                         # unlabelled: skipped
        ("NS-1", "bug_report", "no", *[""] * 6, "low", ""),           # duplicate id
    ]
    df = spark.createDataFrame(rows, COLS)
    found = sorted((r["annotation_id"], r["problem"]) for r in AN.validation_findings(df).collect())
    assert found == sorted([
        ("NS-1", "Duplicate annotation_id"),
        ("NS-1", "Duplicate annotation_id"),
        ("NS-2", "Workaround label must have has_workaround=yes"),
        ("NS-2", "Workaround record is missing user_goal"),
        ("NS-3", "Confidence must be high, medium, or low. Found: sure"),
        ("NS-4", "Confidence must be high, medium, or low. Found: blank"),
        ("NS-4", "Non-workaround label must have has_workaround=no"),
        ("NS-5", "Invalid primary label: mystery"),
    ])


def test_validate_or_fail(spark, tmp_dir):
    import pytest

    good = spark.createDataFrame([("NS-1", "workaround", "yes", *FULL, "high", "")], COLS)
    assert AN.validate_or_fail(good).count() == 0
    bad = spark.createDataFrame([("NS-1", "oops", "yes", *FULL, "high", "")], COLS)
    with pytest.raises(ValueError):
        AN.validate_or_fail(bad, f"{tmp_dir}/errors")


def test_label_upsert_last_write_wins(spark):
    base = spark.createDataFrame(
        [("NS-1", "", "", *[""] * 6, "", ""), ("NS-2", "", "", *[""] * 6, "", ""), ("NS-3", "bug_report", "no", *[""] * 6, "high", "kept")],
        COLS,
    )
    dec_cols = "annotation_id string, decided_at timestamp, primary_label string, user_goal string, obstacle string, workaround string, human_cost string, underlying_need string, evidence_quote string, confidence string, annotator_notes string"
    decisions = spark.createDataFrame(
        [
            ("NS-1", datetime(2024, 1, 1), "bug_report", *["old"] * 6, "low", "first"),
            ("NS-1", datetime(2024, 1, 2), "Workaround", *FULL, "HIGH", "second"),
            ("NS-2", datetime(2024, 1, 1), "user_confusion", *["ignored"] * 6, "q", "n"),
            ("NS-2", datetime(2024, 1, 3), "nonsense", *["x"] * 6, "low", "invalid label ignored"),
            ("NS-3", datetime(2024, 1, 5), "workaround", *FULL, "low", "already labelled"),
        ],
        dec_cols,
    )
    out = {r["annotation_id"]: r for r in AN.apply_label_decisions(base, decisions).collect()}
    assert (out["NS-1"]["primary_label"], out["NS-1"]["has_workaround"], out["NS-1"]["user_goal"], out["NS-1"]["confidence"]) == ("workaround", "yes", "goal", "high")
    assert (out["NS-2"]["primary_label"], out["NS-2"]["has_workaround"], out["NS-2"]["user_goal"], out["NS-2"]["confidence"]) == ("user_confusion", "no", "", "")
    assert out["NS-3"]["annotator_notes"] == "kept"


def test_audit_upsert_and_summary(spark):
    audit = spark.createDataFrame([("A",), ("B",), ("C",)], "annotation_id string")
    decisions = spark.createDataFrame(
        [("A", datetime(2024, 1, 1), "e", "clear"), ("B", datetime(2024, 1, 1), "n", ""), ("B", datetime(2024, 1, 2), "x", "bad code")],
        "annotation_id string, decided_at timestamp, code string, audit_notes string",
    )
    out = AN.apply_audit_decisions(audit, decisions)
    got = {r["annotation_id"]: (r["evidence_status"], r["audit_outcome"]) for r in out.collect()}
    assert got == {"A": ("explicit", "model_failure"), "B": ("not_present", "annotation_error"), "C": ("", "")}
    summary = {(r["section"], r["value"]): r["records"] for r in AN.audit_summary(out).collect()}
    assert summary[("total", "")] == 3 and summary[("reviewed", "")] == 2 and summary[("remaining", "")] == 1
    assert summary[("evidence_status", "explicit")] == 1 and summary[("audit_outcome", "annotation_error")] == 1
    assert summary[("warning", "relabel annotation_error records before retraining")] == 1
    empty = AN.audit_summary(AN.audit_table(spark.createDataFrame([], "annotation_id string")))
    assert {(r["section"], r["records"]) for r in empty.collect()} >= {("total", 0), ("reviewed", 0), ("remaining", 0)}


def test_duplicate_rows_and_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert sorted([r[0] for r in AN.duplicate_rows(df, "k").collect()], key=str) == [None, None, "a", "a"]
    lab = spark.createDataFrame([("x", "workaround"), ("y", "bug_report"), ("z", " "), ("w", "bug_report")], "annotation_id string, primary_label string")
    vc = AN.value_counts(AN.labelled_rows(lab), "primary_label").collect()
    assert [(r[0], r[1]) for r in vc] == [("bug_report", 2), ("workaround", 1)]


def test_class_guard(spark):
    import pytest

    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "target int")
    assert AN.class_guard(df) == (9, 3, 3)
    with pytest.raises(ValueError):
        AN.class_guard(spark.createDataFrame([(1,)] * 1 + [(0,)] * 11, "target int"))
    with pytest.raises(ValueError):
        AN.class_guard(spark.createDataFrame([(0,)] * 12, "target int"))


def test_unreviewed_queue(spark):
    df = spark.createDataFrame([("c", ""), ("a", " "), ("b", "explicit"), ("d", "")], "annotation_id string, evidence_status string")
    assert [r[0] for r in AN.unreviewed_queue(df, 2).orderBy("annotation_id").collect()] == ["a", "c"]
    assert AN.unreviewed_queue(df).count() == 3
    assert AN.unreviewed_queue(df.select("annotation_id"), 10).count() == 4
