from threadlens.operators import threads as TH

ISSUES = "repository string, issue_number long, title string, body string, issue_url string, comments_count int"
COMMENTS = "repository string, issue_number long, comment_id long, position_in_thread int, comment_body string"


def test_thread_assembly_edge_cases(spark):
    issues = spark.createDataFrame(
        [
            ("acme/a", 1, " Crash  on\tsave ", "Body\r\n\r\n\r\n\r\ntext", "u1", 3),
            ("acme/a", 2, "No comments", None, "u2", 0),
            ("acme/a", 3, "Blank comments", "b", "u3", 2),
            ("acme/b", 1, "Same number other repo", "x", "u4", 1),
        ],
        ISSUES,
    )
    comments = spark.createDataFrame(
        [
            ("acme/a", 1, 12, 2, "second  one"),
            ("acme/a", 1, 11, 1, " first\r\n"),
            ("acme/a", 1, 13, 3, "   "),
            ("acme/a", 3, 31, 1, ""),
            ("acme/a", 3, 32, 2, " \t "),
            ("acme/b", 1, 41, 1, "other repo comment"),
        ],
        COMMENTS,
    )
    out = {(r["repository"], r["issue_number"]): r for r in TH.build_threads(issues, comments).collect()}
    t1 = out[("acme/a", 1)]
    assert t1["comments_text"] == "first\n\n--- COMMENT ---\n\nsecond one"
    assert t1["thread_text"] == (
        "TITLE:\nCrash on save\n\nISSUE DESCRIPTION:\nBody\n\ntext\n\nDISCUSSION:\nfirst\n\n--- COMMENT ---\n\nsecond one"
    )
    assert out[("acme/a", 2)]["thread_text"] == "TITLE:\nNo comments\n\nISSUE DESCRIPTION:\n"
    assert out[("acme/a", 3)]["comments_text"] == ""
    assert "DISCUSSION" not in out[("acme/a", 3)]["thread_text"]
    # same issue number in another repository keeps its own comments
    assert out[("acme/b", 1)]["comments_text"] == "other repo comment"
    assert out[("acme/a", 1)]["heuristic_score"] == 0


def test_hot_thread_chunks_keep_order(spark):
    rows = [("r", 7, i, i, f"c{i}") for i in range(1, 1300)]
    comments = spark.createDataFrame(rows, COMMENTS)
    got = TH.comment_threads(comments).first()["comments_text"].split("\n\n--- COMMENT ---\n\n")
    assert got == [f"c{i}" for i in range(1, 1300)]


def test_model_and_analysis_text(spark):
    df = spark.createDataFrame([("  Title ", "thread", " goal ", "")], "title string, thread_text string, user_goal string, obstacle string")
    r = df.select(TH.model_text().alias("m"), TH.analysis_text(df).alias("a")).first()
    assert r["m"] == "TITLE: Title\n\nthread"
    assert r["a"] == "Title\nthread\ngoal"
    blank = spark.createDataFrame([("", "")], "title string, thread_text string")
    assert blank.select(TH.model_text().alias("m")).first()["m"] == ""
