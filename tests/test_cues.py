from pyspark.sql import functions as F

from threadlens.functions import cues as C


def cues_of(spark, texts, d):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(d.cue_array("t")).collect()]


def test_zero_one_several_cues(spark):
    texts = [
        "nothing relevant here",
        "I had to MANUALLY copy the rows",
        "We export to a spreadsheet every time, it is a hack; the only way I can do it",
    ]
    got = cues_of(spark, texts, C.WORKAROUND)
    assert got[0] == []
    assert got[1] == ["manual_process", "forced_action"]
    assert got[2] == ["explicit_workaround", "repetition", "data_transfer", "only_method"]


def test_word_boundaries(spark):
    got = cues_of(spark, ["hacking away", "unmanually", "éworkaround", "workaround_x", "x-workaround-y"], C.WORKAROUND)
    assert got == [[], [], [], [], ["explicit_workaround"]]


def test_heuristic_score_columns(spark):
    df = spark.createDataFrame([("t1", "Use a custom script instead"), ("t2", None)], "id string, thread_text string")
    out = C.heuristic_score(df).orderBy("id").collect()
    assert (out[0]["heuristic_score"], out[0]["matched_patterns"]) == (2, "alternative_method | custom_code")
    assert (out[1]["heuristic_score"], out[1]["matched_patterns"]) == (0, "")


def test_behaviour_dictionaries_differ(spark):
    t = ["I restart it then it fails unless I skip the check"]
    assert cues_of(spark, t, C.BEHAVIOUR6) == [["repetition_or_retry", "multi_step_sequence"]]
    assert cues_of(spark, t, C.BEHAVIOUR8) == [["constraint_language", "repetition_or_retry", "multi_step_sequence", "avoidance_behavior"]]


def test_augment_text(spark):
    df = spark.createDataFrame([("please retry",), ("plain",)], "t string").withColumn("c", C.BEHAVIOUR8.cue_array("t"))
    got = [r[0] for r in df.select(C.augment_text("t", "c")).collect()]
    assert got == ["please retry\n\nbehavioral_cue_repetition_or_retry behavioral_cue_repetition_or_retry", "plain"]


def test_re2_pattern_shape():
    p = C.WORKAROUND.re2_pattern(C.WORKAROUND_8[0][1])
    assert p.startswith("(?i)(?:^|") and "\\b" not in p
