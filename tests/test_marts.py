from threadlens.operators import analysis as AZ
from threadlens.operators import marts as MT


def test_dashboard_base_kpis_and_filters(spark):
    ann = spark.createDataFrame(
        [("a", "workaround", "t1"), ("b", "bug_report", "t2"), ("c", "workaround", "t3"), ("d", "feature_request", "t4"), ("e", "", "t5")],
        "annotation_id string, primary_label string, title string",
    )
    pred = spark.createDataFrame(
        [("a", "yes", "1", "0.9"), ("b", "no", "workaround", "0.7"), ("c", "TRUE", "negative", "x"), ("d", "0", "No Workaround", "0.1")],
        "annotation_id string, actual_label string, model_prediction string, workaround_probability string",
    )
    base = MT.dashboard_base(ann, pred)
    got = {r["annotation_id"]: (r["actual"], r["predicted"], r["error_type"], r["probability"]) for r in base.collect()}
    assert got["a"] == ("workaround", "workaround", "correct", 0.9)
    assert got["b"] == ("no_workaround", "workaround", "false_positive", 0.7)
    assert got["c"] == ("workaround", "no_workaround", "false_negative", None)
    assert got["e"] == ("", "", "not_evaluated", None)
    k = MT.kpis(MT.evaluated(base)).first()
    assert (k["evaluated"], k["correct"], k["accuracy"], k["workaround_recall"], k["missed_workarounds"]) == (4, 2, 0.5, 0.5, 1)
    summary = {r["metric"]: r["records"] for r in MT.evaluation_summary(MT.kpis(MT.evaluated(base))).collect()}
    assert summary == {"Evaluated records": 4, "Correct predictions": 2, "False negatives": 1, "False positives": 1}
    empty = MT.kpis(MT.evaluated(base).filter("false")).first()
    assert (empty["accuracy"], empty["workaround_recall"]) == (0.0, 0.0)
    fn = MT.filter_records(base, actual=["workaround"], error_types=["false_negative"])
    assert [r["annotation_id"] for r in fn.collect()] == ["c"]
    assert MT.filter_records(base).count() == 5


def test_opportunity_filters_facets(spark):
    opp = spark.createDataFrame(
        [("a", "r1", "Export (CSV)", "High", "time | effort", 9.5), ("b", "r2", "import", "low", "unspecified", 5.0), ("c", "r1", "sync", "high", "risk", 7.0)],
        "annotation_id string, repository string, title string, confidence string, cost_type string, opportunity_score double",
    )
    assert [r[0] for r in MT.filter_opportunities(opp, confidence_filter="High").select("annotation_id").collect()] == ["a", "c"]
    assert [r[0] for r in MT.filter_opportunities(opp, cost_filter="EFFORT").select("annotation_id").collect()] == ["a"]
    assert [r[0] for r in MT.filter_opportunities(opp, search_query="csv|sync").select("annotation_id").collect()] == ["a", "c"]
    assert MT.filter_opportunities(opp, search_query="(csv)", regex=False).count() == 1
    assert MT.filter_opportunities(opp, search_query="  ").count() == 3
    k = MT.opportunity_kpis(opp).first()
    assert (k["confirmed_signals"], k["high_confidence_signals"], k["repositories"]) == (3, 2, 2)
    assert abs(k["average_score"] - 7.1666667) < 1e-6
    f = [(r["facet"], r["value"]) for r in MT.facets(opp).collect()]
    assert f == [("confidence", "High"), ("confidence", "Low"), ("cost_type", "effort"), ("cost_type", "risk"), ("cost_type", "time"), ("cost_type", "unspecified")]


def test_merged_sketches_are_within_the_stated_bound(spark):
    rows = spark.range(60_000).selectExpr("id % 7 AS day", "id % 3 AS repository", "id % 20000 AS thread")
    stored = MT.distinct_sketches(rows, ["repository", "day"], "thread")
    assert stored.count() == 21
    for r in MT.merged_distinct(stored, ["repository"]).collect():
        assert abs(r["distinct_estimate"] - 20_000) <= MT.SKETCH_BOUND * 20_000
    nulls = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "k int, v string")
    got = {r["k"]: r["distinct_estimate"] for r in MT.merged_distinct(MT.distinct_sketches(nulls, ["k"], "v"), ["k"]).collect()}
    assert got == {1: 1, 2: 0}


def test_fn_analysis_and_counts(spark):
    pred = spark.createDataFrame(
        [("a", "workaround", "no_workaround", 0.3, "Retry then restart"), ("b", "workaround", "no_workaround", 0.1, "nothing"), ("c", "no_workaround", "workaround", 0.8, "x")],
        "annotation_id string, actual_label string, model_prediction string, workaround_probability double, title string",
    )
    ann = spark.createDataFrame(
        [("a", "thread a", "I copy it by hand", "q"), ("b", "thread b", "", ""), ("c", "thread c", "", "")],
        "annotation_id string, thread_text string, workaround string, evidence_quote string",
    )
    fn = AZ.fn_analysis(pred, ann).collect()
    assert [r["annotation_id"] for r in fn] == ["a", "b"]
    assert fn[0]["behavioral_cues"] == "manual_intervention | repetition_or_retry | multi_step_sequence"
    counts = {r[0]: r[1] for r in AZ.cue_counts(AZ.fn_analysis(pred, ann)).collect()}
    assert counts == {"manual_intervention": 1, "repetition_or_retry": 1, "multi_step_sequence": 1}
    thread_only = AZ.fn_analysis(pred, ann, fields=("title", "thread_text")).collect()
    assert thread_only[0]["behavioral_cues"] == "repetition_or_retry | multi_step_sequence"
    ov = AZ.error_overview(pred).first()
    assert (ov["evaluated_records"], ov["correct_predictions"], ov["false_negatives"], ov["false_positives"]) == (3, 0, 2, 1)


def test_kpis_fall_back_to_the_metrics_record(spark):
    bare = spark.createDataFrame([("a",), ("b",)], "annotation_id string")
    record = spark.createDataFrame([(60, 42, 0.7)], "evaluated_records long, correct_predictions long, accuracy double")
    k = MT.kpis(bare, record).first()
    assert (k["evaluated"], k["correct"], k["accuracy"], k["workaround_recall"]) == (60, 42, 0.7, 0.0)
    assert MT.kpis(bare).first()["evaluated"] == 2
    full = spark.createDataFrame([("workaround", "workaround")], "actual string, predicted string")
    k = MT.kpis(full, record).first()
    assert (k["evaluated"], k["correct"], k["accuracy"]) == (60, 1, 1.0)
