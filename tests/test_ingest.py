import json

from pyspark.sql import functions as F

from threadlens.sources import ingest as IG

PAGES = "repository string, url string, status int, link_header string, body_json string"


def issue(n, created, comments=0, **extra):
    d = {"number": n, "title": f"Issue {n}", "body": None if n == 2 else f"body {n}", "state": "open",
         "labels": [{"name": "bug"}, "not-an-object", {"name": "ui"}], "comments": comments,
         "created_at": created, "updated_at": created, "closed_at": None, "html_url": f"https://tracker.test/{n}",
         "user": {"login": "someone"}, "reactions": {"total_count": n}}
    d.update(extra)
    return d


def test_flatten_drop_prs_quarantine(spark):
    page1 = [issue(1, "2024-01-03T00:00:00Z", 2), issue(2, "2024-01-02T00:00:00Z"), issue(3, "2024-01-01T00:00:00Z", pull_request={"url": "x"})]
    rows = [
        ("o/r", "p1", 200, '<p2>; rel="next"', json.dumps(page1)),
        ("o/r", "p2", 200, None, json.dumps({"message": "rate limited"})),
        ("o/s", "q1", 500, None, "[]"),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    flat = {r["issue_number"]: r for r in IG.flatten_issues(pages).collect()}
    assert set(flat) == {1, 2}
    assert flat[1]["labels"] == "bug | ui" and flat[1]["comments_count"] == 2 and flat[1]["body_length"] == 6
    assert flat[2]["body"] == "" and flat[2]["body_length"] == 0
    q = {r["url"]: r["reason"] for r in IG.quarantine(pages).collect()}
    assert q == {"p2": "unexpected response format", "q1": "status 500"}
    newest = [r["issue_number"] for r in IG.newest_per_repository(IG.flatten_issues(pages), 1).collect()]
    assert newest == [1]
    rich = [r["issue_number"] for r in IG.richest_issues(IG.flatten_issues(pages)).collect()]
    assert rich == [1]


def test_comment_positions_caps_and_nested(spark):
    c = spark.createDataFrame(
        [("o/r", 1, 30, "2024-01-02", " later "), ("o/r", 1, 10, "2024-01-01", "first"), ("o/r", 1, 20, "2024-01-01", "   ")],
        "repository string, issue_number long, comment_id long, created_at string, comment_body string",
    ).withColumns({"comment_url": F.lit("u"), "author_association": F.lit("NONE"), "updated_at": F.col("created_at")})
    pos = IG.comment_positions(c)
    assert [(r["comment_id"], r["position_in_thread"]) for r in pos.orderBy("position_in_thread").collect()] == [(10, 1), (20, 2), (30, 3)]
    assert IG.cap_comments(pos, 2).count() == 2
    page = json.dumps([issue(1, "2024-01-01T00:00:00Z", 3), issue(2, "2024-01-01T00:00:00Z", 0)])
    pages = spark.createDataFrame([("o/r", "p1", 200, None, page)], PAGES)
    nested = {r["issue_number"]: r for r in IG.nested_issues(pages, pos).collect()}
    assert nested[1]["comments_text"] == "first\n\nlater" and len(nested[1]["comments"]) == 3
    assert nested[1]["labels"] == ["bug", "ui"] and nested[1]["reaction_count"] == 1
    assert nested[2]["comments"] == [] and nested[2]["comments_text"] == ""


def test_frontier(spark):
    rows = [("o/r", "u1", 200, '<u2>; rel="next", <u3>; rel="last"', "[]"), ("o/r", "u2", 200, '<u3>; rel="next"', "[]")]
    pages = spark.createDataFrame(rows, PAGES)
    assert [r["next_url"] for r in IG.crawl_frontier(pages).collect()] == ["u3"]


def test_no_comment_is_lost_and_bad_pages_are_named(spark):
    import json

    body = json.dumps([{"number": 1, "title": "t", "comments": 60, "user": {"login": "me"}}])
    pages = spark.createDataFrame(
        [("r", "u1", 200, None, body), ("r", "u2", 403, None, body), ("r", "u3", 200, None, '{"message": "x"}'), ("r", "u4", None, None, body)],
        "repository string, url string, status int, link_header string, body_json string",
    )
    assert IG.flatten_issues(pages).count() == 1
    assert {r["url"]: r["reason"] for r in IG.quarantine(pages).collect()} == {
        "u2": "status 403", "u3": "unexpected response format", "u4": "status unknown",
    }
    items = json.dumps([{"id": i, "body": f"b{i}", "user": {"login": f"w{i}", "type": "User"}, "created_at": "2024"} for i in range(60)])
    cpages = spark.createDataFrame(
        [("r", 1, 1, 100, 200, items), ("r", 1, 2, 100, 500, items), ("r", 1, 3, 100, 200, "oops")],
        "repository string, issue_number long, page_number int, page_size int, status int, body_json string",
    )
    comments = IG.flatten_comments(cpages)
    assert comments.count() == 60 and IG.quarantine(cpages).count() == 2
    nested = IG.nested_issues(pages, comments).first()
    assert len(nested["comments"]) == 60 and nested["comments"][59]["author"] == "w59"
    assert len(IG.nested_issues(pages, comments, cap=5).first()["comments"]) == 5


def test_positions_of_one_long_discussion(spark):
    from pyspark.sql import functions as F

    c = spark.range(3000).select(
        F.lit("r").alias("repository"), F.lit(1).cast("long").alias("issue_number"), F.col("id").alias("comment_id"),
        F.when(F.col("id") % 10 == 0, None).otherwise(F.format_string("2024-%05d", 5000 - F.col("id"))).alias("created_at"),
    )
    got = IG.comment_positions(c.repartition(5)).collect()
    order = sorted(got, key=lambda r: (r["created_at"] is None, r["created_at"] or "", r["comment_id"]))
    assert [r["position_in_thread"] for r in order] == list(range(1, 3001))
