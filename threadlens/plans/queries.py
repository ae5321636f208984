"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables (through the adapters) and runs the
library operators over the whole tables. Column names match the SQL in
``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions import cues as C
from threadlens.functions import scoring as S
from threadlens.functions import text as T
from threadlens.operators import agreement, analysis, annotate, clustering, evaluate, marts, opportunity, recurrence, sampling, threads
from threadlens.plans import adapters as A
from threadlens.session import cut_lineage
from threadlens.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_THREADS = 25
SAMPLE_SIZE = 60
QUEUE_LIMIT = 20
NEWEST_PER_REPO = 5
COMMENT_CAP = 3
OPPORTUNITY_PREVIEW = 10
SCORED_TERMS = 24_000
SCORE_INTERCEPT = 0.25


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- shared inputs -------------------------------------------------------------
def _conv(spark, d):
    return A.table(spark, d, "conversations")


def _issues(spark, d):
    return A.issues_from_conversations(_conv(spark, d))


def _comments(spark, d):
    return A.comments_from_conversations(_conv(spark, d))


def _threads(spark, d, dictionary=C.WORKAROUND):
    return threads.build_threads(_issues(spark, d), _comments(spark, d), dictionary)


def _labelled(spark, d):
    """The labelled annotation table without its cue score: queries that count
    labels or check fields read neither the text nor run a regex."""
    return A.labelled_from_documents(A.table(spark, d, "documents"), A.table(spark, d, "labels"))


def _scored(spark, d):
    """The same with the keyword detector's score and patterns."""
    return A.labelled_with_scores(_labelled(spark, d), A.SIGNAL)


def _keyword_preds(spark, d):
    lab = _scored(spark, d).withColumn("target", T.primary_label_target("primary_label"))
    return evaluate.keyword_predictions(lab)


def _baseline_predictions(spark, d):
    """Prediction table of the keyword detector in the trainer's column layout."""
    p = _keyword_preds(spark, d)
    score = T.try_number("heuristic_score")
    return p.withColumns(
        {
            "model_prediction": F.col("heuristic_prediction"),
            "workaround_probability": F.round(F.least(score / F.lit(5.0), F.lit(1.0)), 4),
            "model_correct": F.col("heuristic_correct"),
        }
    )


# -- T1-T4, T13, T14 ---------------------------------------------------------------
@query
def normalized_text(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        T.normalize_text("text").alias("normalized_text"),
        T.text_length(T.normalize_text("text")).cast("long").alias("normalized_chars"),
        T.clean_text("text").alias("clean_text"),
    )


@query
def text_lengths(spark, d):
    c = _comments(spark, d)
    return c.select("comment_id", T.text_length("comment_body").cast("long").alias("comment_length"))


@query
def label_synonyms(spark, d):
    lab = A.table(spark, d, "labels")
    return lab.select(
        "doc_id",
        T.normalize_binary_label(F.col("quality").cast("string")).alias("quality_label"),
        T.normalize_binary_label(F.col("toxic").cast("string")).alias("toxic_label"),
        T.primary_label_target(S.label_name(F.lit(1) - F.col("quality"))).cast("long").alias("workaround_target"),
    )


@query
def lenient_number(spark, d):
    ev = A.table(spark, d, "events")
    return ev.select(
        "event_id",
        T.try_number(F.get_json_object("props", "$.k")).alias("k_value"),
        T.try_number("event_type").alias("event_type_value"),
    )


# -- A1, J1, T5, T8, O2 ------------------------------------------------------------
@query
def thread_comments(spark, d):
    return threads.comment_threads(_comments(spark, d))


@query
def thread_documents(spark, d):
    t = threads.build_threads(_issues(spark, d), _comments(spark, d), None)
    return t.select("repository", "issue_number", "comments_text", "thread_text")


@query
def thread_cues(spark, d):
    t = _threads(spark, d)
    t = C.with_cues(t, "thread_text", A.CORPUS, "corpus")
    return t.select(
        "repository",
        "issue_number",
        F.col("heuristic_score").cast("long").alias("heuristic_score"),
        "matched_patterns",
        F.col("corpus_score").cast("long").alias("corpus_score"),
        F.col("corpus_names").alias("corpus_patterns"),
    )


def _top_threads(t: DataFrame) -> DataFrame:
    return (
        t.select(
            "repository",
            "issue_number",
            "title",
            F.col("comments_count").cast("long").alias("comments_count"),
            F.col("heuristic_score").cast("long").alias("heuristic_score"),
            "matched_patterns",
            F.length("thread_text").cast("long").alias("thread_chars"),
        )
        .orderBy(F.desc("heuristic_score"), F.desc("comments_count"), "repository", "issue_number")
        .limit(TOP_THREADS)
    )


@query
def top_cue_threads(spark, d):
    return _top_threads(_threads(spark, d))


@query
def top_corpus_cue_threads(spark, d):
    return _top_threads(_threads(spark, d, A.CORPUS))


# -- T9, T10, A6 -------------------------------------------------------------------
def _doc_cues(spark, d, dictionary):
    docs = A.table(spark, d, "documents")
    t = C.with_cues(docs, "text", dictionary, "b")
    return t.select(
        "doc_id",
        F.col("b_score").cast("long").alias("behavioral_cue_count"),
        F.col("b_names").alias("behavioral_cues"),
    )


@query
def behaviour_cues_6(spark, d):
    return _doc_cues(spark, d, C.BEHAVIOUR6)


@query
def behaviour_cues_8(spark, d):
    return _doc_cues(spark, d, C.BEHAVIOUR8)


@query
def augmented_text(spark, d):
    docs = A.table(spark, d, "documents")
    mt = threads.model_text(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), "text")
    t = docs.withColumn("model_text", mt).withColumn("_c", C.BEHAVIOUR8.cue_array("model_text"))
    return t.select(
        "doc_id",
        C.augment_text("model_text", "_c").alias("augmented_text"),
        F.array_join("_c", " | ").alias("behavioral_cues"),
    )


@query
def cue_token_counts(spark, d):
    docs = A.table(spark, d, "documents")
    t = docs.withColumn("_c", A.CORPUS.cue_array("text")).withColumn("behavioral_cues", F.array_join("_c", " | "))
    return analysis.cue_counts(t, "behavioral_cues", "behavioral_pattern", "documents")


# -- W2-W4, T18, P1, W3, F1 --------------------------------------------------------
def _annotation_batch(spark, d):
    return sampling.annotation_batch(_threads(spark, d, A.CORPUS), SAMPLE_SIZE)


@query
def annotation_sample(spark, d):
    b = _annotation_batch(spark, d)
    return b.select(
        "annotation_id", "repository", "issue_number", "issue_url", "title",
        F.col("comments_count").cast("long").alias("comments_count"),
        F.col("heuristic_score").cast("long").alias("heuristic_score"),
        "matched_patterns", "primary_label", "has_workaround", "confidence",
    )


@query
def annotation_batch(spark, d):
    b = _annotation_batch(spark, d)
    return b.select("annotation_id", "thread_text", "user_goal", "evidence_quote", "annotator_notes")


@query
def stratified_folds(spark, d):
    lab = _labelled(spark, d).withColumn("target", T.primary_label_target("primary_label"))
    neg, pos, k = annotate.class_guard(lab)
    f = sampling.stratified_folds(lab, "target", k)
    return f.select("annotation_id", F.col("target").cast("long").alias("target"), F.col("fold").cast("long").alias("fold"))


@query
def unlabelled_queue(spark, d):
    b = _annotation_batch(spark, d)
    q = sampling.unlabelled_queue(b, QUEUE_LIMIT)
    return q.select("annotation_id", "repository", "issue_number")


# -- J7, V1-V6, W1, U2, A5, A7, A11 ------------------------------------------------
def _decisions(spark, d):
    """Label decisions derived from the labelled adapter.

    Every labelled row gets a final decision; rows with a short title also get an
    earlier, superseded decision, so last-write-wins is exercised.
    """
    lab = _labelled(spark, d)
    final = lab.select(
        "annotation_id",
        F.timestamp_seconds(F.lit(1717200000) + F.col("issue_number")).alias("decided_at"),
        "primary_label", *S.WORKAROUND_FIELDS, "confidence",
        F.lit("final").alias("annotator_notes"),
    )
    early = lab.filter(F.length("title") < 40).select(
        "annotation_id",
        F.timestamp_seconds(F.lit(1714521600) + F.col("issue_number")).alias("decided_at"),
        F.lit("not_actionable").alias("primary_label"), *[F.lit("x").alias(f) for f in S.WORKAROUND_FIELDS],
        F.lit("low").alias("confidence"),
        F.lit("superseded").alias("annotator_notes"),
    )
    return final.unionByName(early)


def _blank_annotations(spark, d):
    lab = _labelled(spark, d)
    return lab.withColumns({c: F.lit("") for c in ["primary_label", "has_workaround", *S.WORKAROUND_FIELDS, "confidence", "annotator_notes"]})


@query
def label_upsert(spark, d):
    up = annotate.apply_label_decisions(_blank_annotations(spark, d), _decisions(spark, d))
    return up.select("annotation_id", "primary_label", "has_workaround", *S.WORKAROUND_FIELDS, "confidence", "annotator_notes")


@query
def validation_findings(spark, d):
    return annotate.validation_findings(A.flawed(_labelled(spark, d)))


@query
def duplicate_ids(spark, d):
    docs = A.table(spark, d, "documents").withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
    return annotate.duplicate_rows(docs, "text_md5").select("doc_id", "text_md5")


@query
def label_counts(spark, d):
    lab = annotate.labelled_rows(_labelled(spark, d))
    return annotate.value_counts(lab, "primary_label").withColumn("records", F.col("records").cast("long"))


@query
def dataset_summary(spark, d):
    s = annotate.dataset_summary(_scored(spark, d))
    return s.select(*[F.col(c).cast("long").alias(c) for c in s.columns])


@query
def class_guard(spark, d):
    lab = _labelled(spark, d).withColumn("target", T.primary_label_target("primary_label"))
    neg, pos, k = annotate.class_guard(lab)
    counts = lab.groupBy("target").agg(F.count("*").alias("records"))
    return counts.select(
        F.col("target").cast("long").alias("target"),
        F.col("records").cast("long").alias("records"),
        F.lit(k).cast("long").alias("folds"),
    )


# -- T22, T23, A2-A4, M9, M10, J6 --------------------------------------------------
@query
def keyword_predictions(spark, d):
    p = _keyword_preds(spark, d)
    return p.select(
        "annotation_id", "repository", "issue_number", "title", "primary_label", "actual_label",
        F.col("heuristic_score").cast("long").alias("heuristic_score"), "matched_patterns",
        "heuristic_prediction", "heuristic_correct",
    )


def _flags(spark, d):
    return evaluate.with_flags(_keyword_preds(spark, d), "actual_label", "heuristic_prediction")


@query
def confusion_matrix(spark, d):
    cm = evaluate.confusion(_flags(spark, d))
    return cm.select(*[F.col(c).cast("long").alias(c) for c in cm.columns])


@query
def keyword_metrics(spark, d):
    m = evaluate.binary_metrics(_flags(spark, d))
    return m.select("accuracy", "precision", "recall", "f1")


@query
def classification_report(spark, d):
    return evaluate.classification_report(_flags(spark, d))


@query
def error_table(spark, d):
    e = evaluate.error_table(_baseline_predictions(spark, d))
    return e.select("annotation_id", "actual_label", "model_prediction", "workaround_probability", "error_type")


@query
def model_comparison(spark, d):
    base = evaluate.comparison_row("keyword_heuristic", evaluate.confusion(_flags(spark, d)))
    lab = _labelled(spark, d).withColumn("target", T.primary_label_target("primary_label"))
    b8 = lab.select("target", T.made_once(threads.model_text("title", "thread_text")).alias("text"))
    b8 = C.with_cue_array(b8, "text", C.BEHAVIOUR8, "_c").select(
        F.col("target").alias("actual_flag"), (F.size("_c") > 0).cast("int").alias("predicted_flag")
    )
    improved = evaluate.comparison_row("behavioural_cue_rule", evaluate.confusion(b8))
    return evaluate.model_comparison(base, improved)


# -- P2, A6, J8, A12 ---------------------------------------------------------------
def _fn_analysis(spark, d):
    return analysis.fn_analysis(_baseline_predictions(spark, d), _labelled(spark, d), C.BEHAVIOUR6)


@query
def fn_analysis(spark, d):
    fn = _fn_analysis(spark, d)
    return fn.select(
        "annotation_id", "issue_number", "title", "probability",
        F.col("behavioral_cue_count").cast("long").alias("behavioral_cue_count"), "behavioral_cues",
        "user_goal", "human_cost",
    )


@query
def error_overview(spark, d):
    o = analysis.error_overview(_baseline_predictions(spark, d))
    return o.select(*[F.col(c).cast("long").alias(c) for c in o.columns])


@query
def fn_cue_counts(spark, d):
    c = analysis.cue_counts(_fn_analysis(spark, d))
    return c.withColumn("false_negative_count", F.col("false_negative_count").cast("long"))


def _audit_decisions(fn):
    code = F.when(F.length("user_goal") < 60, F.lit("e")).when(F.length("user_goal") < 120, F.lit("i")).otherwise(F.lit("n"))
    return fn.filter(F.col("title") < "M").select(
        "annotation_id",
        F.timestamp_seconds(F.lit(1719792000) + F.col("issue_number")).alias("decided_at"),
        code.alias("code"),
        F.concat(F.lit("audited "), F.col("annotation_id")).alias("audit_notes"),
    )


def _audit(spark, d):
    fn = _fn_analysis(spark, d)  # one DataFrame for both sides: identical exchanges are reused
    return annotate.apply_audit_decisions(fn, _audit_decisions(fn))


@query
def audit_upsert(spark, d):
    return _audit(spark, d).select("annotation_id", "evidence_status", "audit_outcome", "audit_notes")


@query
def audit_queue(spark, d):
    return annotate.unreviewed_queue(_audit(spark, d), QUEUE_LIMIT).select("annotation_id", "evidence_status")


@query
def audit_summary(spark, d):
    s = annotate.audit_summary(_audit(spark, d))
    return s.withColumn("records", F.col("records").cast("long"))


# -- P3, T15-T17 -------------------------------------------------------------------
def _opportunities(spark, d):
    return opportunity.build_opportunities(_scored(spark, d))


@query
def opportunity_scores(spark, d):
    o = _opportunities(spark, d)
    return o.select("annotation_id", "repository", "issue_number", "confidence", "cost_type", "opportunity_score")


@query
def cost_types(spark, d):
    lab = _labelled(spark, d)
    return lab.select("annotation_id", "human_cost", S.cost_type("human_cost").alias("cost_type"))


@query
def opportunity_ranking(spark, d):
    o = opportunity.top_opportunities(_opportunities(spark, d), OPPORTUNITY_PREVIEW)
    return o.select("annotation_id", "title", "cost_type", "opportunity_score")


@query
def opportunity_statements(spark, d):
    o = _opportunities(spark, d)
    return o.select("annotation_id", "opportunity_statement")


# -- P4, J3, A8-A10, A13, F6-F9 ----------------------------------------------------
def _base(spark, d):
    return marts.dashboard_base(_labelled(spark, d), _baseline_predictions(spark, d))


@query
def dashboard_base(spark, d):
    b = _base(spark, d)
    return b.select("annotation_id", "primary_label", "actual", "predicted", "probability", "error_type")


def _kpis(spark, d):
    return marts.kpis(marts.evaluated(_base(spark, d)))


@query
def kpis(spark, d):
    k = _kpis(spark, d)
    return k.select(
        F.col("evaluated").cast("long").alias("evaluated"),
        F.col("correct").cast("long").alias("correct"),
        F.round("accuracy", 6).alias("accuracy"),
        F.round("workaround_recall", 6).alias("workaround_recall"),
        F.col("missed_workarounds").cast("long").alias("missed_workarounds"),
    )


@query
def kpis_from_record(spark, d):
    """Predictions without labels: the metrics record of the keyword detector stands in."""
    record = evaluate.metrics_record(evaluate.confusion(_flags(spark, d)), "keyword_heuristic", "rule", S.DEFAULT_THRESHOLD)
    k = marts.kpis(_labelled(spark, d).select("annotation_id"), record)
    return k.select(
        F.col("evaluated").cast("long").alias("evaluated"), F.col("correct").cast("long").alias("correct"),
        F.round("accuracy", 4).alias("accuracy"), "workaround_recall",
    )


@query
def evaluation_summary(spark, d):
    return marts.evaluation_summary(_kpis(spark, d))


@query
def opportunity_kpis(spark, d):
    k = marts.opportunity_kpis(_opportunities(spark, d))
    return k.select(
        F.col("confirmed_signals").cast("long").alias("confirmed_signals"),
        F.round("average_score", 6).alias("average_score"),
        F.col("high_confidence_signals").cast("long").alias("high_confidence_signals"),
        F.col("repositories").cast("long").alias("repositories"),
    )


@query
def merged_thread_counts(spark, d):
    """Daily sketches of the commented threads are stored, then merged by repository and
    held against the exact count."""
    comments = _comments(spark, d).withColumn("day", F.substring(F.col("created_at").cast("string"), 1, 10))
    stored = cut_lineage(marts.distinct_sketches(comments, ["repository", "day"], "issue_number"))
    merged = marts.merged_distinct(stored, ["repository"]).join(stored.groupBy("repository").agg(F.count(F.lit(1)).alias("days")), "repository")
    exact = comments.groupBy("repository").agg(F.countDistinct("issue_number").alias("threads"))
    near = F.abs(F.col("distinct_estimate") - F.col("threads")) <= F.lit(marts.SKETCH_BOUND) * F.col("threads")
    return merged.join(exact, "repository").select("repository", "days", "threads", near.alias("within_bound"))


@query
def facets(spark, d):
    return marts.facets(_opportunities(spark, d))


@query
def opportunity_filter(spark, d):
    o = marts.filter_opportunities(_opportunities(spark, d), search_query="the", confidence_filter="Medium", cost_filter="time")
    return o.select("annotation_id", "opportunity_score")


@query
def record_filter(spark, d):
    b = _base(spark, d)
    r = marts.filter_records(b, actual=["workaround"], error_types=["false_negative", "correct"])
    return r.select("annotation_id", "actual", "predicted", "error_type")


# -- I1-I11 ------------------------------------------------------------------------
def _pages(spark, d):
    return A.api_pages_from_conversations(_conv(spark, d))


@query
def issues_flatten(spark, d):
    i = ingest.flatten_issues(_pages(spark, d))
    return i.select(
        "repository", "issue_number", "title", "state", "labels",
        F.col("comments_count").cast("long").alias("comments_count"), "created_at",
        F.col("body_length").cast("long").alias("body_length"), "issue_url",
    )


@query
def pull_request_filter(spark, d):
    items = ingest.payload_items(_pages(spark, d))
    prs = items.filter(ingest.is_pull_request("raw"))
    return prs.select("repository", F.get_json_object("raw", "$.number").cast("long").alias("issue_number"))


@query
def newest_per_repo(spark, d):
    i = ingest.newest_per_repository(ingest.flatten_issues(_pages(spark, d)), NEWEST_PER_REPO)
    return i.select("repository", "issue_number", "created_at")


@query
def comments_flatten(spark, d):
    pages = A.comment_pages_from_conversations(_conv(spark, d))
    c = ingest.flatten_comments(pages)
    return c.select(
        "repository", "issue_number", "comment_id",
        F.col("position_in_thread").cast("long").alias("position_in_thread"),
        F.col("comment_length").cast("long").alias("comment_length"),
        "author", "author_association", "user_type",
    )


@query
def comment_positions(spark, d):
    c = ingest.comment_positions(_comments(spark, d).drop("position_in_thread"))
    return c.select("comment_id", F.col("position_in_thread").cast("long").alias("position_in_thread"))


@query
def comments_capped(spark, d):
    c = ingest.cap_comments(_comments(spark, d), COMMENT_CAP)
    return c.select("repository", "issue_number", "comment_id")


@query
def richest_issues(spark, d):
    i = ingest.richest_issues(ingest.flatten_issues(_pages(spark, d)))
    return i.select("repository", "issue_number", F.col("comments_count").cast("long").alias("comments_count"))


@query
def issues_nested(spark, d):
    n = ingest.nested_issues(_pages(spark, d), _comments(spark, d), include_comments=True)
    return n.select(
        "repo", "issue_number", F.array_join("labels", ",").alias("labels"),
        F.col("comment_count").cast("long").alias("comment_count"),
        F.col("reaction_count").cast("long").alias("reaction_count"),
        F.size("comments").cast("long").alias("n_comments"),
        F.array_join(F.transform("comments", lambda c: F.coalesce(c["author"], F.lit("?"))), ",").alias("authors"),
        F.array_join(F.transform("comments", lambda c: c["comment_id"].cast("string")), ",").alias("comment_ids"),
        F.array_join(F.transform("comments", lambda c: c["position_in_thread"].cast("string")), ",").alias("positions"),
        F.array_join(F.transform("comments", lambda c: F.concat_ws("/", c["author_association"], c["created_at"], c["updated_at"], c["html_url"])), ",").alias("comment_meta"),
        "comments_text",
    )


@query
def payload_quarantine(spark, d):
    q = ingest.quarantine(_pages(spark, d))
    return q.select("repository", "url", "reason")


@query
def comment_quarantine(spark, d):
    q = ingest.quarantine(A.comment_pages_from_conversations(_conv(spark, d)))
    return q.select("repository", "issue_number", "page_number", "reason")


@query
def updated_per_repo(spark, d):
    i = ingest.newest_per_repository(ingest.flatten_issues(_pages(spark, d)), ingest.DEFAULT_ISSUES_PER_REPO, by="updated_at")
    return i.select("repository", "issue_number", "updated_at")


@query
def crawl_links(spark, d):
    return ingest.crawl_links(_pages(spark, d))


@query
def crawl_frontier(spark, d):
    pages = _pages(spark, d).filter("status = 200")
    # The last landed page of every repository is treated as not yet fetched.
    landed = pages.filter(F.col("link_header").isNotNull())
    return ingest.crawl_frontier(landed)


# -- M1-M4: features -------------------------------------------------------------------
def _documents(spark, d):
    return A.table(spark, d, "documents")


@query
def document_frequencies(spark, d):
    from threadlens.operators import features as FT

    docs = _documents(spark, d)
    return FT.block_of(FT.document_statistics(docs, "doc_id", "text", [FT.TC.WORD]), FT.TC.WORD)


@query
def word_ngram_tfidf(spark, d):
    from threadlens.operators import features as FT
    from threadlens.operators.model import BASELINE

    docs = _documents(spark, d)
    n = docs.count()
    stats = FT.block_of(FT.document_statistics(docs, "doc_id", "text", [FT.TC.WORD]), FT.TC.WORD)
    fitted = FT.vocabulary_of(stats, n, BASELINE.word_max_features, BASELINE.word_max_df)
    vocab = FT.union_vocabulary([[fitted]])
    entries = FT.entries_of(FT.coded_texts(docs, "doc_id", "text", vocab), vocab)
    entries = entries.select("doc", F.inline("entries"))
    terms = fitted.table.select("idx", "term")
    return entries.join(F.broadcast(terms), "idx").select(
        F.col("doc").alias("doc_id"), "term", F.round("value", 6).alias("tfidf")
    )


@query
def char_vocabulary(spark, d):
    from threadlens.operators import features as FT
    from threadlens.operators.model import IMPROVED

    docs = _documents(spark, d)
    n = docs.count()
    stats = FT.block_of(FT.document_statistics(docs, "doc_id", "text", [FT.TC.CHAR]), FT.TC.CHAR)
    vocab = FT.vocabulary_of(stats, n, IMPROVED.char_max_features)
    return vocab.table.select("term", "df", "total", F.round("idf", 6).alias("idf"))


def _union_entries(spark, d, of=None):
    """Both blocks of the improved detector's features, fitted over all documents: (doc, entries) of all, or of the ids of ``of`` with their target counts."""
    from threadlens.operators import features as FT
    from threadlens.operators import model as M

    docs = _documents(spark, d).select(F.col("doc_id").alias("doc"), "text")
    fm = M.fit_text_features(docs, "doc", docs.count(), M.IMPROVED)
    return FT.entries_of(*M.coded_for(fm, docs)) if of is None else M.counted_entries(fm, docs, of)


@query
def feature_union(spark, d):
    entries = _union_entries(spark, d).select(F.col("doc").alias("doc_id"), F.inline("entries"))
    return entries.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


@query
def linear_scores(spark, d):
    """Scoring with a given coefficient table: a weight by index, the published threshold."""
    from threadlens.operators import features as FT

    entries = _union_entries(spark, d)
    coefficients = spark.range(SCORED_TERMS).select(F.col("id").cast("int").alias("idx"), ((F.col("id") % 7 - 3) / 4.0).alias("weight"))
    scored = FT.linear_scores(entries, coefficients, SCORE_INTERCEPT)
    return scored.select(
        F.col("doc").alias("doc_id"), F.round("probability", 6).alias("probability"),
        S.threshold_label(F.round("probability", 6), S.DEFAULT_THRESHOLD).alias("prediction"),
    )


@query
def oof_coverage(spark, d):
    """Fold, actual label and number of scores of every trained row."""
    from threadlens.operators import model as M

    p = M.oof_predictions(_labelled(spark, d), M.BASELINE)
    p = p.groupBy("annotation_id", "fold", "actual_label").agg(
        F.count("*").alias("scores"), F.count_if(F.col("workaround_probability").between(0, 1)).alias("valid_scores")
    )
    return p.withColumn("fold", F.col("fold").cast("long"))


@query
def fit_optimality(spark, d):
    """The objective's largest slope without a model, and whether the fit left at most a tenth of it."""
    from threadlens.operators import model as M

    lab = _labelled(spark, d)
    return M.fit_certificate(M.fit_detector(lab, M.BASELINE), lab).select("rows", F.round("zero_slope", 8).alias("zero_slope"), "converged")


@query
def objective_slopes(spark, d):
    """The training objective's slope at a given coefficient table, over both feature blocks."""
    from threadlens.operators import model as M

    rows = _labelled(spark, d).filter(T.lower_clean("has_workaround").isin("yes", "no"))
    docs = rows.select(F.col("issue_number").alias("doc"), T.yes_no_target("has_workaround").alias("target"))
    given = spark.range(SCORED_TERMS).select(F.col("id").cast("int").alias("idx"), ((F.col("id") % 7 - 3) / 4.0).alias("weight"))
    docs = cut_lineage(docs)
    slopes = M.objective_slopes(_union_entries(spark, d, docs), docs, given, SCORE_INTERCEPT, M.IMPROVED.C)
    return slopes.select(F.col("idx").cast("long").alias("idx"), F.round("slope", 8).alias("slope"))


@query
def training_set_summary(spark, d):
    from threadlens.operators import model as M

    lab = _labelled(spark, d)
    return M.training_set_summary(lab, M.BASELINE).unionByName(M.training_set_summary(lab, M.IMPROVED))


# -- M5-M12: detector (rows-only checks: solver and fold details differ by design) ---------
@query
def oof_predictions(spark, d):
    from threadlens.operators import model as M

    p = M.oof_predictions(_labelled(spark, d), M.IMPROVED)
    return p.select("annotation_id", "fold", "actual_label", "model_prediction", "workaround_probability", "behavioral_cues", "model_correct", "error_type")


@query
def baseline_oof_predictions(spark, d):
    from threadlens.operators import model as M

    p = M.oof_predictions(_labelled(spark, d), M.BASELINE)
    return p.select("annotation_id", "fold", "actual_label", "model_prediction", "workaround_probability", "model_correct")


@query
def final_model_terms(spark, d):
    from threadlens.operators import model as M

    return M.top_terms(M.fit_detector(_labelled(spark, d), M.BASELINE))


@query
def score_documents(spark, d):
    from threadlens.operators import model as M

    det = M.fit_detector(_labelled(spark, d), M.IMPROVED)
    docs = A.table(spark, d, "documents").select(
        F.format_string("NS-%04d", F.col("doc_id") + 1).alias("annotation_id"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"),
        F.coalesce("text", F.lit("")).alias("thread_text"),
    )
    return M.score(det, docs)


# -- thread order with missing positions -------------------------------------------
@query
def thread_comments_unplaced(spark, d):
    """Every fifth comment lost its position: it goes to the end of its thread."""
    c = _comments(spark, d).withColumn("position_in_thread", F.when(F.col("comment_id") % 5 != 0, F.col("position_in_thread")))
    return threads.comment_threads(c).select("repository", "issue_number", "comments_text")


# -- extensions: clusters, agreement, recurrence, incremental collection -------------
CLUSTERS = 8
CLUSTER_ROUNDS = 5
SEED_ROUNDS = 3
CLUSTER_SALT = 42


def _clusters(spark, d):
    return clustering.clusters(A.table(spark, d, "embeddings"), "vec_id", "embedding", k=CLUSTERS, rounds=CLUSTER_ROUNDS, seed_rounds=SEED_ROUNDS, salt=CLUSTER_SALT)


@query
def vector_clusters(spark, d):
    return _clusters(spark, d).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query
def cluster_summary(spark, d):
    s = clustering.cluster_summary(_clusters(spark, d))
    return s.select("cluster", "members", F.round("mean_distance", 6).alias("mean_distance"), F.round("radius", 6).alias("radius"))


def _annotators(spark, d):
    """The labels as two annotators' decisions: the second one left some out, left some blank and differs on others."""
    first = _labelled(spark, d).select("issue_number", "annotation_id", "primary_label")
    n = F.col("issue_number")
    label = F.when(n % 13 == 5, F.lit(" ")).when(n % 7 == 0, F.lit("Bug_Report ")).when(n % 17 == 1, F.lit("question")).otherwise(F.col("primary_label"))
    return first.filter(n % 19 != 2), first.withColumn("primary_label", label).filter(n % 11 != 3)


@query
def annotator_agreement(spark, d):
    out = agreement.agreement(agreement.label_pairs(*_annotators(spark, d)))
    return out.select("label", "n_both", "n_first", "n_second", "agreed", "one_sided", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


@query
def annotator_cross_tab(spark, d):
    return agreement.cross_tab(agreement.label_pairs(*_annotators(spark, d)))


def _weekly(spark, d):
    """Corpus cues of each discussion, spread over a year by its number."""
    day = F.date_add(F.lit(A.EPOCH_DATE).cast("date"), (F.col("issue_number") * 37 % 364).cast("int"))
    t = _threads(spark, d, A.CORPUS).withColumn("cues", F.split("matched_patterns", " \\| "))
    return recurrence.weekly_cues(t.filter("matched_patterns <> ''").withColumn("created_on", day))


@query
def cue_recurrence(spark, d):
    return recurrence.recurrence(_weekly(spark, d))


@query
def cue_runs(spark, d):
    r = recurrence.cue_runs(_weekly(spark, d))
    return r.select("cue", F.col("run_start").cast("string").alias("run_start"), F.col("run_end").cast("string").alias("run_end"), "weeks", "n_threads", "n_open", "gap_weeks")


# -- extension: leave one repository out ---------------------------------------------
REPOSITORY_FOLDS = 10


@query
def repository_folds(spark, d):
    """Every trained row is scored once, by a model of so many rows of other repositories."""
    from threadlens.operators import model as M

    p = M.leave_one_group_out(_labelled(spark, d), M.BASELINE, max_folds=REPOSITORY_FOLDS)
    sizes = p.groupBy("fold").agg(F.count(F.lit(1)).alias("_own"))
    total = p.agg(F.count(F.lit(1)).alias("_all"))  # one row
    scored = p.groupBy(F.col("doc").alias("annotation_id"), F.col("group").alias("repository"), "fold", "target").agg(
        F.count(F.lit(1)).alias("scores"), F.count_if(F.col("probability").between(0, 1)).alias("valid_scores")
    )
    return scored.join(sizes, "fold").join(F.broadcast(total)).select(
        "annotation_id", "repository", F.col("fold").cast("long").alias("fold"), S.label_name("target").alias("actual_label"), "scores", "valid_scores",
        (F.col("_all") - F.col("_own")).alias("trained_rows"),
    )


@query
def held_out_frequencies(spark, d):
    """Of each source's terms, the document frequency in all other sources."""
    from threadlens.operators import features as FT

    docs = _documents(spark, d).withColumn("fold", F.col("source"))
    stats = FT.block_of(FT.document_statistics(docs, "doc_id", "text", [FT.TC.WORD], ["fold"]), FT.TC.WORD)
    return FT.held_out_statistics(stats).withColumnRenamed("fold", "source")


# -- extension: incremental collection -------------------------------------------------
@query
def collected_issues(spark, d):
    """Pages land in two overlapping deliveries, the stream stops between them and once more
    runs without news: its sink holds each issue exactly once."""
    import uuid

    from threadlens.session import ensure_checkpoint_dir
    from threadlens.streaming import collect_stream

    run = uuid.uuid4().hex
    landing, sink = (f"{ensure_checkpoint_dir(spark).rstrip('/')}/{x}-{run}" for x in ("landing", "collected"))
    pages = _pages(spark, d)
    for delivery in (pages.filter("pmod(xxhash64(url), 2) = 0"), pages, None):
        if delivery is not None:
            delivery.write.mode("append").json(landing)
        collect_stream(spark, landing, sink, name=f"collect-{run}").awaitTermination()
    return spark.read.parquet(sink).select(
        "repository", "issue_number", "title", "state", "labels",
        F.col("comments_count").cast("long").alias("comments_count"), "created_at",
        F.col("body_length").cast("long").alias("body_length"), "issue_url",
    )
