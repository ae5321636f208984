import json
import os

from threadlens.sources.schemas import ISSUES
from threadlens.streaming import cue_stream, issue_stream


def test_issue_and_cue_streams(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    items = [
        {"number": 1, "title": "Export by hand", "body": "I had to copy it manually", "labels": [{"name": "bug"}], "comments": 1},
        {"number": 2, "title": "PR", "body": "x", "pull_request": {"url": "u"}},
    ]
    with open(os.path.join(landing, "page-1.json"), "w") as fh:
        fh.write(json.dumps({"repository": "o/r", "url": "p1", "status": 200, "link_header": None, "body_json": json.dumps(items)}) + "\n")
    q = issue_stream(spark, landing, os.path.join(tmp_dir, "issues"), name=f"issues-{os.path.basename(tmp_dir)}")
    q.awaitTermination(120)
    issues = spark.read.parquet(os.path.join(tmp_dir, "issues"))
    rows = issues.collect()
    assert [(r["repository"], r["issue_number"]) for r in rows] == [("o/r", 1)]

    threads_dir = os.path.join(tmp_dir, "threads")
    issues.withColumnRenamed("body", "thread_text").write.parquet(threads_dir)
    schema = spark.read.parquet(threads_dir).schema
    q2 = cue_stream(spark, threads_dir, os.path.join(tmp_dir, "cues"), schema, name=f"cues-{os.path.basename(tmp_dir)}")
    q2.awaitTermination(120)
    cues = spark.read.parquet(os.path.join(tmp_dir, "cues")).first()
    assert cues["heuristic_score"] == 2 and cues["matched_patterns"] == "manual_process | forced_action"
    assert ISSUES.fieldNames()[0] == "repository"


def test_score_stream(spark, tmp_dir):
    from tests.test_model import corpus
    from threadlens.operators import model as M
    from threadlens.streaming import score_stream

    det = M.fit_detector(corpus(spark), M.BASELINE)
    M.save_detector(det, os.path.join(tmp_dir, "det"))
    threads_dir = os.path.join(tmp_dir, "new_threads")
    spark.createDataFrame(
        [("x1", "t", "we copy paste into a spreadsheet manually"), ("x2", "t", "segfault null pointer crash")],
        "annotation_id string, title string, thread_text string",
    ).write.parquet(threads_dir)
    schema = spark.read.parquet(threads_dir).schema
    q = score_stream(spark, os.path.join(tmp_dir, "det"), threads_dir, os.path.join(tmp_dir, "scores"), schema, name=f"scores-{os.path.basename(tmp_dir)}")
    q.awaitTermination(180)
    got = {r["annotation_id"]: r["prediction"] for r in spark.read.parquet(os.path.join(tmp_dir, "scores")).collect()}
    assert got == {"x1": "workaround", "x2": "no_workaround"}


def test_collect_stream_repeats_updates_and_restarts(spark, tmp_dir):
    """Repeated pages add nothing, a changed issue adds a version, a file within the delay counts though it is old."""
    import time

    from threadlens.streaming import collect_stream, latest_issues

    landing, sink = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "sink")
    os.makedirs(landing)

    def land(name, items, age=0):
        path = os.path.join(landing, f"{name}.json")
        with open(path, "w") as fh:
            fh.write(json.dumps({"repository": "o/r", "url": name, "status": 200, "link_header": None, "body_json": json.dumps(items)}) + "\n")
        os.utime(path, (time.time() - age,) * 2)

    def run():
        collect_stream(spark, landing, sink, name=f"collect-{os.path.basename(tmp_dir)}").awaitTermination(180)
        return sorted((r["issue_number"], r["title"]) for r in spark.read.parquet(sink).collect())

    issue = lambda n, title, day: {"number": n, "title": title, "body": "b", "updated_at": f"2024-01-{day:02d}T00:00:00Z"}
    land("p1", [issue(1, "one", 1), issue(2, "two", 1)])
    assert run() == [(1, "one"), (2, "two")]
    land("p1-again", [issue(1, "one", 1), issue(2, "two", 1)])
    land("p2", [issue(2, "two, edited", 3), issue(3, "three", 2), {"number": 9, "title": "pr", "pull_request": {}}])
    assert run() == run() == [(1, "one"), (2, "two"), (2, "two, edited"), (3, "three")]
    land("p0", [issue(4, "late", 1), issue(1, "one", 1)], age=3600)
    rows = run()
    assert len(rows) == 5 and (4, "late") in rows
    land("bad", [])
    latest = latest_issues(spark.read.parquet(sink))
    assert sorted((r["issue_number"], r["title"]) for r in latest.collect()) == [(1, "one"), (2, "two, edited"), (3, "three"), (4, "late")]
