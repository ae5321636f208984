from threadlens.functions import scoring as S
from threadlens.operators import opportunity as OP

COLS = "annotation_id string, repository string, issue_number long, title string, primary_label string, user_goal string, obstacle string, workaround string, human_cost string, underlying_need string, evidence_quote string, confidence string, comments_count string, heuristic_score string, issue_url string"


def test_scores_and_costs(spark):
    rows = [
        ("A", "r", 1, "t", "Workaround", "export data", "no bulk API", "copy rows by hand", "Slow and manual, risk of error", "bulk export", "quote", "High", "3", "5", "u"),
        ("B", "r", 2, "t", "workaround", "", "", "", "", "", "", "unknown", "abc", "9", "u"),
        ("C", "s", 3, "t", "workaround", "g", "o", "w", "confusing", "n", "", "low", "25", "", "u"),
        ("D", "s", 4, "t", "bug_report", "g", "o", "w", "time", "n", "q", "high", "1", "1", "u"),
    ]
    df = spark.createDataFrame(rows, COLS)
    out = {r["annotation_id"]: r for r in OP.build_opportunities(df).collect()}
    assert set(out) == {"A", "B", "C"}
    # 3 + 2 + 1.5 + 1.5 + 1 + 0.3 + 1.0
    assert out["A"]["opportunity_score"] == 10.3
    assert out["A"]["cost_type"] == "time | effort | risk"
    # unknown confidence, non-numeric comments, heuristic capped at 5
    assert out["B"]["opportunity_score"] == 1.0
    assert out["B"]["cost_type"] == "unspecified"
    # comments capped at 10, blank heuristic skipped
    assert out["C"]["opportunity_score"] == 1.0 + 2.0 + 1.5 + 1.5 + 1.0
    assert out["C"]["cost_type"] == "friction"
    assert out["A"]["opportunity_statement"] == "Users need a better way to export data without having to copy rows by hand."
    ranked = [r["annotation_id"] for r in OP.build_opportunities(df).collect()]
    assert ranked == ["A", "C", "B"]


def test_max_score_is_eleven(spark):
    df = spark.createDataFrame([("high", "c", "o", "n", "q", "50", "50")], "confidence string, human_cost string, obstacle string, underlying_need string, evidence_quote string, comments_count string, heuristic_score string")
    assert df.select(S.opportunity_score().alias("s")).first()["s"] == 11.0


def test_audit_code_and_ids(spark):
    df = spark.createDataFrame([("e",), ("I",), ("n",), ("q",)], "c string")
    got = [(r[0], r[1]) for r in df.select(S.audit_status("c"), S.audit_outcome("c")).collect()]
    assert got == [("explicit", "model_failure"), ("implicit_but_supported", "contextual_inference_failure"), ("not_present", "annotation_error"), (None, None)]
    ids = spark.createDataFrame([(1,), (12345,)], "n long").select(S.annotation_id("n")).collect()
    assert [r[0] for r in ids] == ["NS-0001", "NS-12345"]
