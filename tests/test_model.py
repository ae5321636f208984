import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import features as FT
from threadlens.operators import model as M
from threadlens.session import cut_lineage, staged

POS_WORDS = ["manually", "copy", "paste", "spreadsheet", "export", "script", "again", "instead"]
NEG_WORDS = ["crash", "error", "stack", "trace", "segfault", "null", "pointer", "exception"]
COMMON = ["the", "app", "when", "we", "open", "file", "please", "help", "version"]


def corpus(spark, n=60):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        pos = i % 3 == 0
        words = [rng.choice(COMMON) for _ in range(20)] + [rng.choice(POS_WORDS if pos else NEG_WORDS) for _ in range(6)]
        rng.shuffle(words)
        rows.append((f"NS-{i:04d}", f"Title {i}", " ".join(words), "workaround" if pos else "bug_report", "yes" if pos else "no"))
    return spark.createDataFrame(rows, "annotation_id string, title string, thread_text string, primary_label string, has_workaround string")


def test_word_and_char_features(spark):
    df = spark.createDataFrame([("d1", "Hello hello World"), ("d2", "world peace")], "doc string, text string")
    counts = FT.word_term_counts(df, "doc", "text")
    got = {(r["doc"], r["term"]): r["tf"] for r in counts.collect()}
    assert got[("d1", "hello")] == 2 and got[("d1", "hello hello")] == 1 and got[("d2", "world peace")] == 1
    v = FT.fit_vocabulary(counts, 2, max_features=3)
    assert v.size == 3 and [r["term"] for r in v.table.orderBy("idx").collect()] == ["hello", "hello hello", "world"]
    chars = {r["term"] for r in FT.char_wb_term_counts(spark.createDataFrame([("d", "ab abcdef")], "doc string, text string"), "doc", "text").collect()}
    assert " ab " in chars and " abcd" in chars and "def " in chars and " ab" in chars


def test_out_of_fold_scores_every_row_once(spark):
    lab = corpus(spark)
    oof = M.oof_predictions(lab, M.IMPROVED)
    rows = oof.collect()
    assert len(rows) == 60 and len({r["annotation_id"] for r in rows}) == 60
    assert {r["fold"] for r in rows} == set(range(5))
    acc = sum(r["model_correct"] for r in rows) / 60
    assert acc > 0.8
    base = M.oof_predictions(lab, M.BASELINE).collect()
    assert len(base) == 60 and all(0.0 <= r["workaround_probability"] <= 1.0 for r in base)


def test_coded_documents_give_each_models_vectors(spark):
    docs = spark.createDataFrame([("a", "copy paste copy error"), ("b", "crash é"), ("c", "paste the file"), ("d", ""), ("e", "zz")], "doc string, text string")
    counts = M.count_terms(docs, M.IMPROVED)
    parts = [["a", "b"], ["b", "c"], ["a", "c"]]
    models = []
    for own in parts:
        stats = [FT.term_statistics(c.filter(F.col("doc").isin(own))) for c in (counts.word, counts.char)]
        models.append(M.fit_features(*stats, len(own), dataclasses.replace(M.IMPROVED, word_max_features=4, char_max_features=9)))
    vocab = FT.union_vocabulary([m.blocks for m in models])
    assert vocab.sizes == [m.size for m in models]
    coded = FT.coded_documents([counts.word, counts.char], vocab, docs)
    for i, m in enumerate(models):
        want = {r["doc"]: r["features"] for r in M.featurize(counts, docs, m).collect()}
        scored = FT.vectors_of(coded, vocab, i)
        assert scored.columns == ["doc", "text", "features"] and "terms" not in scored.columns
        got = {r["doc"]: r["features"] for r in scored.collect()}
        assert got.keys() == want.keys() == set("abcde")
        for k, v in want.items():
            assert got[k].size == v.size and list(got[k].indices) == list(v.indices)
            assert max((abs(x - y) for x, y in zip(got[k].values, v.values)), default=0) < 1e-12
    empty = FT.coded_documents([counts.word, counts.char], vocab, docs.limit(0))
    assert FT.vectors_of(empty, vocab, 0).count() == 0


def test_out_of_fold_without_a_vocabulary_cap_agrees(spark):
    lab = corpus(spark)
    capped = dataclasses.replace(M.BASELINE, word_max_features=100_000)
    got = {r["doc"]: r["probability"] for r in M.out_of_fold(lab, capped).collect()}
    want = {r["doc"]: r["probability"] for r in M.out_of_fold(lab, dataclasses.replace(capped, word_max_features=None)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_final_fit_terms_save_score(spark, tmp_dir):
    lab = corpus(spark)
    det = M.fit_detector(lab, M.BASELINE)
    terms = M.top_terms(det, 5).collect()
    pos_terms = {r["term"] for r in terms if r["direction"] == "workaround_associated_terms"}
    assert pos_terms & set(POS_WORDS)
    M.save_detector(det, f"{tmp_dir}/det")
    loaded = M.load_detector(spark, f"{tmp_dir}/det")
    new = spark.createDataFrame([("x1", "t", "we copy paste into a spreadsheet manually"), ("x2", "t", "segfault null pointer crash")], "annotation_id string, title string, thread_text string")
    scored = {r["annotation_id"]: r for r in M.score(loaded, new).collect()}
    assert scored["x1"]["probability"] > scored["x2"]["probability"]
    assert scored["x1"]["prediction"] == "workaround"


def test_row_scores_equal_joined_scores_without_a_shuffle(spark):
    lab = corpus(spark)
    rows = [(f"x{i}", "Größe", t) for i, t in enumerate(["", None, "a b", "we copy paste manually", "zzz qqq", "Error  NULL\tpointer é crash crash"])]
    new = spark.createDataFrame(rows, "annotation_id string, title string, thread_text string")
    for spec in (M.BASELINE, M.IMPROVED):
        det = M.fit_detector(lab, spec)
        scored = M.score(det, new)
        assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
        want = {r["annotation_id"]: r["probability"] for r in M.joined_scores(det, new).collect()}
        got = {r["annotation_id"]: r["probability"] for r in scored.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_jobs_end_to_end(spark, tmp_dir):
    from threadlens import jobs

    lab = corpus(spark).withColumn("heuristic_score", F.when(F.col("thread_text").contains("manually"), F.lit("1")).otherwise(F.lit("0")))
    base = jobs.train_baseline(lab)
    m = base.metrics.first()
    assert m["dataset"]["labeled_records"] == 60 and m["dataset"]["cross_validation_folds"] == 5
    assert m["correct_predictions"] + m["incorrect_predictions"] == 60
    assert base.predictions.count() == 60
    imp = jobs.train_improved(lab, base.metrics)
    r = imp.metrics.first()
    assert r["evaluated_records"] == 60 and r["baseline_comparison"]["accuracy"] == m["accuracy"]
    assert 0.0 <= r["balanced_accuracy"] <= 1.0
    jobs.write_training(imp, f"{tmp_dir}/improved")
    assert spark.read.json(f"{tmp_dir}/improved/metrics").count() == 1
    an = jobs.analyze_errors(imp.predictions, lab)
    assert an.overview.first()["evaluated_records"] == 60


def test_leave_one_group_out(spark):
    import pytest

    labelled = corpus(spark).withColumn("repository", F.concat(F.lit("r"), (F.substring("annotation_id", 4, 4).cast("int") % 4).cast("string")))
    labelled = labelled.withColumn("repository", F.when(F.col("repository") != "r3", F.col("repository")))
    for folds, expected in ((50, 4), (3, 3)):
        got = M.leave_one_group_out(labelled, M.BASELINE, max_folds=folds).collect()
        assert len(got) == len({r["doc"] for r in got}) == 60 and all(0 <= r["probability"] <= 1 for r in got)
        assert len({r["fold"] for r in got}) == expected and {r["group"] for r in got} == {"r0", "r1", "r2", ""}
        assert len({(r["group"], r["fold"]) for r in got}) == 4  # a repository is in one fold
    # What a repository says about itself doesn't reach the model that scores it.
    own = F.when(F.col("repository") == "r1", F.concat("thread_text", F.lit(" secretword secretword"))).otherwise(F.col("thread_text"))
    changed = {r["doc"]: r["probability"] for r in M.leave_one_group_out(labelled.withColumn("thread_text", own), M.BASELINE).collect() if r["group"] == "r1"}
    plain = {r["doc"]: r["probability"] for r in M.leave_one_group_out(labelled, M.BASELINE).collect() if r["group"] == "r1"}
    assert changed.keys() == plain.keys() and all(abs(changed[k] - plain[k]) < 1e-6 for k in plain)
    one_sided = labelled.withColumn("repository", F.col("primary_label"))
    with pytest.raises(ValueError):
        M.leave_one_group_out(one_sided, M.BASELINE)


def test_held_out_statistics(spark):
    counts = spark.createDataFrame([("a", "x", 2, "r1"), ("b", "x", 1, "r2"), ("c", "y", 5, "r1"), ("d", "x", 1, "r1")], "doc string, term string, tf int, fold string")
    got = sorted(map(tuple, FT.held_out_statistics(FT.grouped_statistics(counts)).collect()))
    assert got == [("x", "r1", 1, 1), ("x", "r2", 2, 3)]


def test_certificate_tells_a_fit_from_an_unfinished_one(spark):
    lab = corpus(spark)
    done = M.fit_certificate(M.fit_detector(lab, M.BASELINE), lab).first()
    cut = M.fit_certificate(M.fit_detector(lab, dataclasses.replace(M.BASELINE, max_iter=2)), lab).first()
    assert done["rows"] == 60 and done["zero_slope"] == cut["zero_slope"] > 0
    assert done["converged"] and not cut["converged"]


def test_texts_are_made_once_however_often_they_are_used(spark):
    """The cue regexes, the filter and the output read one value, not the text's own expression again."""
    from threadlens.operators import model as M
    from threadlens.plans import queries as Q

    rows = [("a", " T ", "do it\r\nmanually ", "workaround", "yes"), ("b", None, " ", "bug", "no"), ("c", "x", None, "bug", "no")]
    lab = spark.createDataFrame(rows, "annotation_id string, title string, thread_text string, primary_label string, has_workaround string")
    for spec, most in ((M.IMPROVED, 24), (M.BASELINE, 4)):
        plan = M.prepare_documents(lab, spec)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") <= most, plan
    got = {r["doc"]: (r["text"], r["target"], r["cues"]) for r in M.prepare_documents(lab, M.IMPROVED).collect()}
    assert got["a"][1:] == (1, "manual_intervention") and got["a"][0].startswith("TITLE: T\n\ndo it\nmanually") and set(got) == {"a", "c"}
    assert {r["doc"]: r["text"] for r in M.prepare_documents(lab, M.BASELINE).collect()} == {"a": "do it\r\nmanually"}
    plan = Q.QUERIES["model_comparison"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 24, plan.count("regexp_replace(")


def test_slopes_join_texts_with_their_counts_before_features_are_made(spark):
    texts = [(1, "copy paste by hand"), (2, "copy it again"), (2, "and paste"), (3, None), (4, "nobody asks for this"), (None, "lost")]
    texts = spark.createDataFrame(texts, "doc long, text string")
    docs = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (9, 0)], "doc long, target int")
    spec = dataclasses.replace(M.IMPROVED, word_max_features=6, char_max_features=9)
    fm = M.fit_text_features(texts, "doc", 4, spec)
    counted = M.counted_entries(fm, texts, docs)
    above, between, _ = counted._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 2)
    assert "Exchange" not in above + between  # the vectors, the codes: neither moves
    got = {r["doc"]: (r["times"], r["ones"], r["zeros"], len(r["entries"]) > 0) for r in counted.collect()}
    assert got == {1: (1, 1, 0, True), 2: (2, 0, 2, True), 3: (1, 1, 0, False), 9: (1, 0, 1, False)}
    weights = spark.createDataFrame([(i, (i % 3 - 1) / 2.0) for i in range(fm.size)], "idx int, weight double")
    one = M.objective_slopes(counted, docs, weights, 0.25, spec.C)
    other = M.objective_slopes(FT.entries_of(*M.coded_for(fm, texts)), docs, weights, 0.25, spec.C)
    one, other = ({r["idx"]: r["slope"] for r in x.collect()} for x in (one, other))
    assert len(one) == fm.size + 1 and one == pytest.approx(other, abs=1e-12)


@pytest.mark.parametrize("fit", [M.fit_detector, M.out_of_fold])
def test_training_keeps_texts_and_codes_compressed_and_deletes_them(spark, monkeypatch, fit):
    kept, tables = [], []

    def recorded(df):
        kept.append(set(df.columns))
        return cut_lineage(df)

    def table(df):
        tables.append(staged(df))
        return tables[-1]

    monkeypatch.setattr(M, "cut_lineage", recorded)
    monkeypatch.setattr(M, "staged", table)
    fit(corpus(spark), dataclasses.replace(M.IMPROVED, word_max_features=20, char_max_features=30))
    assert not any(columns & {"text", "terms"} for columns in kept)
    assert len(tables) >= 2
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.inputFiles()[0])
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
