"""DuckDB SQL oracle: one statement per registered query.

Written independently of the Spark plans (window functions, ``string_agg``,
``md5``, RE2 regex), over the driver's pre-registered views.
"""

from __future__ import annotations

from threadlens.functions import cues as C
from threadlens.functions import scoring as S
from threadlens.plans import adapters as A
from threadlens.plans import queries as Q
from threadlens.plans.sqltext import (
    NL,
    comment_text_cte,
    comments_cte,
    cue_names,
    cue_score,
    issues_cte,
    labelled_cte,
    lit,
    lower_clean,
    normalize,
    strip,
    thread_prelude,
    threads_cte,
)

ORACLE: dict[str, str] = {}


def sql(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn

    return deco


def _binlabel(x: str) -> str:
    v = lower_clean(x)
    w = ", ".join(lit(s) for s in ["workaround", "yes", "true", "1", "positive"])
    n = ", ".join(lit(s) for s in ["no_workaround", "no workaround", "no", "false", "0", "negative"])
    return f"(CASE WHEN {v} IN ({w}) THEN 'workaround' WHEN {v} IN ({n}) THEN 'no_workaround' ELSE {v} END)"


def _model_text(title: str, thread: str) -> str:
    t, th = normalize(title), normalize(thread)
    return f"concat_ws({NL} || {NL}, CASE WHEN {t} <> '' THEN 'TITLE: ' || {t} END, CASE WHEN {th} <> '' THEN {th} END)"


# -- labelled discussions, keyword predictions ---------------------------------------
def _lab_prelude() -> str:
    return f"""WITH {labelled_cte(A.SIGNAL)},
kp AS (
  SELECT *,
         CASE WHEN {lower_clean('primary_label')} = 'workaround' THEN 1 ELSE 0 END AS target,
         CASE WHEN coalesce(TRY_CAST(heuristic_score AS DOUBLE), 0) > 0 THEN 'workaround' ELSE 'no_workaround' END AS heuristic_prediction
  FROM labelled),
preds AS (
  SELECT *,
         CASE WHEN target = 1 THEN 'workaround' ELSE 'no_workaround' END AS actual_label,
         heuristic_prediction AS model_prediction,
         round(least(TRY_CAST(heuristic_score AS DOUBLE) / CAST(5.0 AS DOUBLE), CAST(1.0 AS DOUBLE)), 4) AS workaround_probability
  FROM kp),
flags AS (
  SELECT *, CASE WHEN actual_label = 'workaround' THEN 1 ELSE 0 END AS af,
            CASE WHEN heuristic_prediction = 'workaround' THEN 1 ELSE 0 END AS pf
  FROM preds),
cm AS (
  SELECT count(*) FILTER (WHERE af = 0 AND pf = 0) AS tn, count(*) FILTER (WHERE af = 0 AND pf = 1) AS fp,
         count(*) FILTER (WHERE af = 1 AND pf = 0) AS fn, count(*) FILTER (WHERE af = 1 AND pf = 1) AS tp
  FROM flags)
"""


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


# -- T1-T4, T13, T14 -----------------------------------------------------------------
@sql("normalized_text")
def _():
    n = normalize("text")
    return f"SELECT doc_id, {n} AS normalized_text, CAST(length({n}) AS BIGINT) AS normalized_chars, {strip('text')} AS clean_text FROM documents"


@sql("text_lengths")
def _():
    return f"WITH {comments_cte()} SELECT comment_id, CAST(length(comment_body) AS BIGINT) AS comment_length FROM comments"


@sql("label_synonyms")
def _():
    return f"""SELECT doc_id, {_binlabel('quality')} AS quality_label, {_binlabel('toxic')} AS toxic_label,
       CAST(CASE WHEN quality = 0 THEN 1 ELSE 0 END AS BIGINT) AS workaround_target FROM labels"""


@sql("lenient_number")
def _():
    k = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    e = "TRY_CAST(event_type AS DOUBLE)"
    return f"""SELECT event_id, CASE WHEN isnan({k}) THEN NULL ELSE {k} END AS k_value,
       CASE WHEN isnan({e}) THEN NULL ELSE {e} END AS event_type_value FROM events"""


# -- threads -------------------------------------------------------------------------
@sql("thread_comments")
def _():
    return f"WITH {comments_cte()},\n{comment_text_cte()}\nSELECT repository, issue_number, comments_text FROM ct"


@sql("thread_documents")
def _():
    return f"WITH {issues_cte()},\n{comments_cte()},\n{comment_text_cte()},\n{threads_cte()}\nSELECT repository, issue_number, comments_text, thread_text FROM threads0"


@sql("thread_cues")
def _():
    return thread_prelude(C.WORKAROUND) + f"""SELECT repository, issue_number, CAST(heuristic_score AS BIGINT) AS heuristic_score, matched_patterns,
       CAST({cue_score('thread_text', A.CORPUS)} AS BIGINT) AS corpus_score, {cue_names('thread_text', A.CORPUS)} AS corpus_patterns
FROM threads"""


def _top(d) -> str:
    return thread_prelude(d) + f"""SELECT repository, issue_number, title, CAST(comments_count AS BIGINT) AS comments_count,
       CAST(heuristic_score AS BIGINT) AS heuristic_score, matched_patterns, CAST(length(thread_text) AS BIGINT) AS thread_chars
FROM threads ORDER BY heuristic_score DESC, comments_count DESC, repository, issue_number LIMIT {Q.TOP_THREADS}"""


@sql("top_cue_threads")
def _():
    return _top(C.WORKAROUND)


@sql("top_corpus_cue_threads")
def _():
    return _top(A.CORPUS)


# -- cues on documents -----------------------------------------------------------------
def _doc_cues(d) -> str:
    return f"SELECT doc_id, CAST({cue_score('text', d)} AS BIGINT) AS behavioral_cue_count, {cue_names('text', d)} AS behavioral_cues FROM documents"


@sql("behaviour_cues_6")
def _():
    return _doc_cues(C.BEHAVIOUR6)


@sql("behaviour_cues_8")
def _():
    return _doc_cues(C.BEHAVIOUR8)


@sql("augmented_text")
def _():
    mt = _model_text(f"split_part(coalesce(text, ''), {NL}, 1)", "text")
    d = C.BEHAVIOUR8
    tokens = ", ".join(
        f"CASE WHEN regexp_matches(mt, {lit(d.re2_pattern(p))}) THEN {lit(C.CUE_TOKEN_PREFIX + n + ' ' + C.CUE_TOKEN_PREFIX + n)} END"
        for n, p in d.entries
    )
    return f"""WITH m AS (SELECT doc_id, {mt} AS mt FROM documents)
SELECT doc_id,
       CASE WHEN {cue_score('mt', d)} > 0 THEN mt || {NL} || {NL} || concat_ws(' ', {tokens}) ELSE mt END AS augmented_text,
       {cue_names('mt', d)} AS behavioral_cues
FROM m"""


@sql("cue_token_counts")
def _():
    d = A.CORPUS
    cases = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {lit(d.re2_pattern(p))}) THEN {lit(n)} END" for n, p in d.entries)
    return f"""SELECT behavioral_pattern, count(*) AS documents FROM (
  SELECT unnest([{cases}]) AS behavioral_pattern FROM documents)
WHERE behavioral_pattern IS NOT NULL
GROUP BY behavioral_pattern"""


# -- sampling ----------------------------------------------------------------------------
def _sample_prelude() -> str:
    key = "concat_ws(':', repository, CAST(issue_number AS VARCHAR), '42')"
    shuffle = "concat_ws(':', repository, CAST(issue_number AS VARCHAR), '42', 'shuffle')"
    return thread_prelude(A.CORPUS) + f""",
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE heuristic_score > 0) AS sig,
             count(*) FILTER (WHERE heuristic_score = 0) AS ord FROM threads),
t1 AS (SELECT least({Q.SAMPLE_SIZE}, total) AS n, sig, ord FROM c),
t2 AS (SELECT n, least(sig, CAST(round_even(n * CAST(0.7 AS DOUBLE), 0) AS BIGINT)) AS st, ord FROM t1),
t3 AS (SELECT n, st, least(ord, n - st) AS ct FROM t2),
r AS (SELECT th.*, md5({key}) AS so,
             row_number() OVER (PARTITION BY heuristic_score > 0 ORDER BY md5({key}), repository, issue_number) AS pr
      FROM threads th WHERE heuristic_score >= 0),
sel AS (SELECT r.* FROM r, t3 WHERE (r.heuristic_score > 0 AND r.pr <= t3.st) OR (r.heuristic_score = 0 AND r.pr <= t3.ct)),
rest AS (SELECT r.*, row_number() OVER (ORDER BY so, repository, issue_number) AS rr FROM r
         WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.repository = r.repository AND sel.issue_number = r.issue_number)),
topup AS (SELECT rest.* EXCLUDE (rr) FROM rest, t3 WHERE rest.rr <= t3.n - t3.st - t3.ct),
allsel AS (SELECT * FROM sel UNION ALL SELECT * FROM topup),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5({shuffle}), repository, issue_number) AS seq FROM allsel)
"""


@sql("annotation_sample")
def _():
    return _sample_prelude() + """SELECT printf('NS-%04d', seq) AS annotation_id, repository, issue_number, issue_url, title,
       CAST(comments_count AS BIGINT) AS comments_count, CAST(heuristic_score AS BIGINT) AS heuristic_score,
       matched_patterns, '' AS primary_label, '' AS has_workaround, '' AS confidence
FROM numbered"""


@sql("annotation_batch")
def _():
    return _sample_prelude() + "SELECT printf('NS-%04d', seq) AS annotation_id, thread_text, '' AS user_goal, '' AS evidence_quote, '' AS annotator_notes FROM numbered"


@sql("stratified_folds")
def _():
    return f"""WITH {labelled_cte(A.SIGNAL)},
l2 AS (SELECT annotation_id, CASE WHEN {lower_clean('primary_label')} = 'workaround' THEN 1 ELSE 0 END AS target FROM labelled),
k AS (SELECT least(5, count(*) FILTER (WHERE target = 1), count(*) FILTER (WHERE target = 0)) AS k FROM l2)
SELECT annotation_id, CAST(target AS BIGINT) AS target,
       CAST((row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws(':', annotation_id, '42')), annotation_id) - 1) % k.k AS BIGINT) AS fold
FROM l2, k"""


@sql("unlabelled_queue")
def _():
    return _sample_prelude() + f"SELECT printf('NS-%04d', seq) AS annotation_id, repository, issue_number FROM numbered ORDER BY annotation_id LIMIT {Q.QUEUE_LIMIT}"


# -- labels ----------------------------------------------------------------------------
@sql("label_upsert")
def _():
    pl = lower_clean("primary_label")
    fields = ",\n       ".join(f"CASE WHEN {pl} = 'workaround' THEN {strip(f)} ELSE '' END AS {f}" for f in S.WORKAROUND_FIELDS)
    conf = lower_clean("confidence")
    return f"""WITH {labelled_cte(A.SIGNAL)}
SELECT annotation_id, {pl} AS primary_label, CASE WHEN {pl} = 'workaround' THEN 'yes' ELSE 'no' END AS has_workaround,
       {fields},
       CASE WHEN {conf} IN ('high', 'medium', 'low') THEN {conf} ELSE '' END AS confidence,
       'final' AS annotator_notes
FROM labelled"""


@sql("validation_findings")
def _():
    label, hw, conf = lower_clean("primary_label"), lower_clean("has_workaround"), lower_clean("confidence")
    valid = f"({label} IN ({', '.join(lit(x) for x in S.VALID_LABELS)}))"
    isw = f"({label} = 'workaround')"
    confok = f"({conf} IN ('high', 'medium', 'low'))"
    msgs = [
        f"CASE WHEN NOT {valid} THEN 'Invalid primary label: ' || {label} END",
        f"CASE WHEN {valid} AND NOT {confok} THEN 'Confidence must be high, medium, or low. Found: ' || CASE WHEN {conf} = '' THEN 'blank' ELSE {conf} END END",
        f"CASE WHEN {valid} AND {isw} AND {hw} <> 'yes' THEN 'Workaround label must have has_workaround=yes' END",
        *[f"CASE WHEN {valid} AND {isw} AND {strip(f)} = '' THEN 'Workaround record is missing {f}' END" for f in S.WORKAROUND_FIELDS],
        f"CASE WHEN {valid} AND NOT {isw} AND {hw} <> 'no' THEN 'Non-workaround label must have has_workaround=no' END",
    ]
    nth = f"FROM labelled WHERE issue_number % {A.FLAW_EVERY} ="
    return f"""WITH {labelled_cte(A.SIGNAL)},
flawed AS (
  SELECT * FROM labelled
  UNION ALL SELECT * {nth} 0
  UNION ALL SELECT * REPLACE (annotation_id || '-l' AS annotation_id, ' Mystery ' AS primary_label) {nth} 1
  UNION ALL SELECT * REPLACE (annotation_id || '-c' AS annotation_id, 'certain' AS confidence) {nth} 2
  UNION ALL SELECT * REPLACE (annotation_id || '-b' AS annotation_id, ' ' AS confidence) {nth} 3
  UNION ALL SELECT * REPLACE (annotation_id || '-y' AS annotation_id, CASE WHEN has_workaround = 'yes' THEN 'no' ELSE 'yes' END AS has_workaround) {nth} 4
  UNION ALL SELECT * REPLACE (annotation_id || '-w' AS annotation_id, 'no' AS has_workaround) FROM labelled WHERE has_workaround = 'yes')
SELECT annotation_id, problem FROM (
  SELECT {strip('annotation_id')} AS annotation_id, unnest([{', '.join(msgs)}]) AS problem
  FROM flawed WHERE {label} <> '') WHERE problem IS NOT NULL
UNION ALL
SELECT {strip('annotation_id')} AS annotation_id, 'Duplicate annotation_id' AS problem FROM flawed
WHERE annotation_id IN (SELECT annotation_id FROM flawed GROUP BY annotation_id HAVING count(*) > 1)"""


@sql("duplicate_ids")
def _():
    return """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents)
SELECT doc_id, text_md5 FROM d WHERE text_md5 IN (SELECT text_md5 FROM d GROUP BY text_md5 HAVING count(*) > 1)"""


@sql("label_counts")
def _():
    return f"""WITH {labelled_cte(A.SIGNAL)}
SELECT primary_label, count(*) AS records FROM labelled WHERE {strip('primary_label')} <> '' GROUP BY primary_label"""


@sql("dataset_summary")
def _():
    lab = f"({strip('primary_label')} <> '')"
    w = f"({lower_clean('primary_label')} = 'workaround')"
    return f"""WITH {labelled_cte(A.SIGNAL)}
SELECT count(*) AS total_records, count(*) FILTER (WHERE {lab}) AS labelled_records,
       count(*) FILTER (WHERE NOT {lab}) AS unlabelled_records,
       count(*) FILTER (WHERE {lab} AND {w}) AS workaround_records,
       count(*) FILTER (WHERE {lab} AND NOT {w}) AS non_workaround_records,
       count(*) FILTER (WHERE coalesce(TRY_CAST(heuristic_score AS DOUBLE), 0) > 0) AS likely_signals
FROM labelled"""


@sql("class_guard")
def _():
    return f"""WITH {labelled_cte(A.SIGNAL)},
l2 AS (SELECT CASE WHEN {lower_clean('primary_label')} = 'workaround' THEN 1 ELSE 0 END AS target FROM labelled),
k AS (SELECT least(5, count(*) FILTER (WHERE target = 1), count(*) FILTER (WHERE target = 0)) AS k FROM l2)
SELECT CAST(target AS BIGINT) AS target, count(*) AS records, CAST(any_value(k.k) AS BIGINT) AS folds FROM l2, k GROUP BY target"""


# -- evaluation ------------------------------------------------------------------------
@sql("keyword_predictions")
def _():
    return _lab_prelude() + """SELECT annotation_id, repository, issue_number, title, primary_label, actual_label,
       CAST(heuristic_score AS BIGINT) AS heuristic_score, matched_patterns, heuristic_prediction,
       heuristic_prediction = actual_label AS heuristic_correct
FROM preds"""


@sql("confusion_matrix")
def _():
    return _lab_prelude() + "SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives FROM cm"


@sql("keyword_metrics")
def _():
    return _lab_prelude() + f"""SELECT round({_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy,
       round({_div('tp', 'tp + fp')}, 4) AS precision, round({_div('tp', 'tp + fn')}, 4) AS recall,
       round({_div('2 * tp', '2 * tp + fp + fn')}, 4) AS f1 FROM cm"""


@sql("classification_report")
def _():
    p0, r0, f0 = _div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fn + fp")
    p1, r1, f1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
    n = "(tn + fp + fn + tp)"
    acc = _div("tp + tn", n)
    w = lambda a, b: _div(f"({a}) * (tn + fp) + ({b}) * (tp + fn)", n)
    rows = [
        ("no_workaround", p0, r0, f0, "tn + fp"),
        ("workaround", p1, r1, f1, "tp + fn"),
        ("accuracy", "NULL", "NULL", acc, n),
        ("macro avg", f"(({p0}) + ({p1})) / 2", f"(({r0}) + ({r1})) / 2", f"(({f0}) + ({f1})) / 2", n),
        ("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n),
        ("balanced_accuracy", "NULL", f"(({r0}) + ({r1})) / 2", "NULL", n),
    ]
    sel = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS class_name, round(CAST({p} AS DOUBLE), 4) AS precision, round(CAST({r} AS DOUBLE), 4) AS recall, "
        f"round(CAST({f} AS DOUBLE), 4) AS f1_score, CAST({s} AS BIGINT) AS support FROM cm"
        for c, p, r, f, s in rows
    )
    return _lab_prelude() + sel


@sql("error_table")
def _():
    return _lab_prelude() + """SELECT annotation_id, actual_label, model_prediction, workaround_probability,
       CASE WHEN actual_label = 'workaround' AND model_prediction = 'no_workaround' THEN 'false_negative'
            WHEN actual_label = 'no_workaround' AND model_prediction = 'workaround' THEN 'false_positive' ELSE '' END AS error_type
FROM preds WHERE actual_label <> model_prediction"""


@sql("model_comparison")
def _():
    mt = _model_text("title", "thread_text")
    return _lab_prelude() + f""",
b8 AS (SELECT target AS af, CASE WHEN {cue_score(mt, C.BEHAVIOUR8)} > 0 THEN 1 ELSE 0 END AS pf FROM kp),
cm2 AS (SELECT count(*) FILTER (WHERE af = 0 AND pf = 0) AS tn, count(*) FILTER (WHERE af = 0 AND pf = 1) AS fp,
               count(*) FILTER (WHERE af = 1 AND pf = 0) AS fn, count(*) FILTER (WHERE af = 1 AND pf = 1) AS tp FROM b8),
both_ AS (SELECT 'keyword_heuristic' AS model_name, * FROM cm UNION ALL SELECT 'behavioural_cue_rule', * FROM cm2)
SELECT model_name, round({_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy, CAST(fn AS BIGINT) AS false_negatives,
       CAST(fp AS BIGINT) AS false_positives, CAST(tp + tn AS BIGINT) AS correct_predictions,
       CAST(fp + fn AS BIGINT) AS incorrect_predictions FROM both_"""


# -- false-negative analysis -----------------------------------------------------------
def _fn_prelude() -> str:
    fields = ["title", "thread_text", "user_goal", "obstacle", "workaround", "human_cost", "underlying_need", "evidence_quote"]
    at = f"concat_ws({NL}, " + ", ".join(f"CASE WHEN {strip(f)} <> '' THEN {strip(f)} END" for f in fields) + ")"
    return _lab_prelude() + f""",
comb AS (SELECT *, {_binlabel('actual_label')} AS actual, {_binlabel('model_prediction')} AS predicted,
                CASE WHEN isnan(TRY_CAST(workaround_probability AS DOUBLE)) THEN NULL ELSE TRY_CAST(workaround_probability AS DOUBLE) END AS probability,
                {at} AS analysis_text FROM preds),
fna AS (SELECT *, {cue_score('analysis_text', C.BEHAVIOUR6)} AS behavioral_cue_count, {cue_names('analysis_text', C.BEHAVIOUR6)} AS behavioral_cues
        FROM comb WHERE actual = 'workaround' AND predicted = 'no_workaround')
"""


@sql("fn_analysis")
def _():
    return _fn_prelude() + """SELECT annotation_id, issue_number, title, probability, CAST(behavioral_cue_count AS BIGINT) AS behavioral_cue_count,
       behavioral_cues, user_goal, human_cost FROM fna"""


@sql("fn_cue_counts")
def _():
    return _fn_prelude() + f"""SELECT behavioral_pattern, count(*) AS false_negative_count FROM (
  SELECT unnest(string_split(behavioral_cues, ' | ')) AS behavioral_pattern FROM fna)
WHERE {strip('behavioral_pattern')} <> '' GROUP BY behavioral_pattern"""


def _audit_prelude() -> str:
    code = "CASE WHEN length(user_goal) < 60 THEN 'e' WHEN length(user_goal) < 120 THEN 'i' ELSE 'n' END"
    status = " ".join(f"WHEN '{k}' THEN '{s}'" for k, s, _ in S.AUDIT_CODES)
    outcome = " ".join(f"WHEN '{k}' THEN '{o}'" for k, _, o in S.AUDIT_CODES)
    return _fn_prelude() + f""",
dec AS (SELECT annotation_id, {code} AS code, 'audited ' || annotation_id AS notes FROM fna WHERE title < 'M'),
aud AS (SELECT f.annotation_id,
               coalesce(CASE d.code {status} END, '') AS evidence_status,
               coalesce(CASE d.code {outcome} END, '') AS audit_outcome,
               CASE WHEN d.code IS NULL THEN '' ELSE d.notes END AS audit_notes
        FROM fna f LEFT JOIN dec d ON f.annotation_id = d.annotation_id)
"""


@sql("audit_upsert")
def _():
    return _audit_prelude() + "SELECT annotation_id, evidence_status, audit_outcome, audit_notes FROM aud"


@sql("audit_queue")
def _():
    return _audit_prelude() + f"SELECT annotation_id, evidence_status FROM aud WHERE evidence_status = '' ORDER BY annotation_id LIMIT {Q.QUEUE_LIMIT}"


@sql("audit_summary")
def _():
    return _audit_prelude() + """SELECT 'total' AS section, '' AS value, count(*) AS records FROM aud
UNION ALL SELECT 'reviewed', '', count(*) FILTER (WHERE evidence_status <> '') FROM aud
UNION ALL SELECT 'remaining', '', count(*) FILTER (WHERE evidence_status = '') FROM aud
UNION ALL SELECT 'warning', 'relabel annotation_error records before retraining',
                 count(*) FILTER (WHERE evidence_status <> '' AND audit_outcome = 'annotation_error') FROM aud
UNION ALL SELECT 'evidence_status', evidence_status, count(*) FROM aud WHERE evidence_status <> '' GROUP BY evidence_status
UNION ALL SELECT 'audit_outcome', audit_outcome, count(*) FROM aud WHERE evidence_status <> '' GROUP BY audit_outcome"""


# -- opportunities -----------------------------------------------------------------------
def _score_sql() -> str:
    conf = lower_clean("confidence")
    w = "CASE " + " ".join(f"WHEN {conf} = '{n}' THEN CAST({v} AS DOUBLE)" for n, v in S.CONFIDENCE_WEIGHTS) + " ELSE CAST(0.0 AS DOUBLE) END"

    def present(c, v):
        return f"CASE WHEN {strip(c)} <> '' THEN CAST({v} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"

    def capped(c, cap, wt):
        x = f"TRY_CAST({c} AS DOUBLE)"
        return f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) THEN least({x}, CAST({cap} AS DOUBLE)) * CAST({wt} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"

    s = (
        f"(((((((CAST(0.0 AS DOUBLE) + {w}) + {present('human_cost', S.HUMAN_COST_WEIGHT)}) + {present('obstacle', S.OBSTACLE_WEIGHT)})"
        f" + {present('underlying_need', S.UNDERLYING_NEED_WEIGHT)}) + {present('evidence_quote', S.EVIDENCE_QUOTE_WEIGHT)})"
        f" + {capped('comments_count', S.COMMENTS_CAP, S.COMMENTS_WEIGHT)}) + {capped('heuristic_score', S.HEURISTIC_CAP, S.HEURISTIC_WEIGHT)})"
    )
    return f"round_even({s}, 2)"


def _cost_sql(x: str = "human_cost") -> str:
    t = lower_clean(x)
    parts = []
    for name, words in S.COST_KEYWORDS:
        cond = " OR ".join(f"contains({t}, {lit(w)})" for w in words)
        parts.append(f"CASE WHEN {cond} THEN '{name}' END")
    j = f"concat_ws(' | ', {', '.join(parts)})"
    return f"CASE WHEN {j} = '' THEN 'unspecified' ELSE {j} END"


def _opp_prelude() -> str:
    return f"""WITH {labelled_cte(A.SIGNAL)},
opp AS (SELECT *, {_score_sql()} AS opportunity_score, {_cost_sql()} AS cost_type,
               'Users need a better way to ' || {strip('user_goal')} || ' without having to ' || {strip('workaround')} || '.' AS opportunity_statement
        FROM labelled WHERE {lower_clean('primary_label')} = 'workaround')
"""


@sql("opportunity_scores")
def _():
    return _opp_prelude() + "SELECT annotation_id, repository, issue_number, confidence, cost_type, opportunity_score FROM opp"


@sql("cost_types")
def _():
    return f"WITH {labelled_cte(A.SIGNAL)} SELECT annotation_id, human_cost, {_cost_sql()} AS cost_type FROM labelled"


@sql("opportunity_ranking")
def _():
    return _opp_prelude() + f"SELECT annotation_id, title, cost_type, opportunity_score FROM opp ORDER BY opportunity_score DESC, annotation_id LIMIT {Q.OPPORTUNITY_PREVIEW}"


@sql("opportunity_statements")
def _():
    return _opp_prelude() + "SELECT annotation_id, opportunity_statement FROM opp"


# -- dashboard marts -----------------------------------------------------------------------
def _base_prelude() -> str:
    return _lab_prelude() + f""",
base AS (
  SELECT l.annotation_id, l.primary_label, {_binlabel("coalesce(p.actual_label, '')")} AS actual,
         {_binlabel("coalesce(p.model_prediction, '')")} AS predicted, p.workaround_probability AS probability
  FROM labelled l LEFT JOIN preds p ON l.annotation_id = p.annotation_id),
base2 AS (
  SELECT *, CASE WHEN actual = '' OR predicted = '' THEN 'not_evaluated' WHEN actual = predicted THEN 'correct'
                 WHEN actual = 'workaround' AND predicted = 'no_workaround' THEN 'false_negative'
                 WHEN actual = 'no_workaround' AND predicted = 'workaround' THEN 'false_positive' ELSE 'other_error' END AS error_type
  FROM base),
ev AS (SELECT * FROM base2 WHERE actual IN ('workaround', 'no_workaround') AND predicted IN ('workaround', 'no_workaround')),
k AS (SELECT count(*) AS evaluated, count(*) FILTER (WHERE actual = predicted) AS correct,
             count(*) FILTER (WHERE actual = 'workaround') AS aw,
             count(*) FILTER (WHERE actual = 'workaround' AND predicted = 'workaround') AS det,
             count(*) FILTER (WHERE actual = 'workaround' AND predicted = 'no_workaround') AS missed,
             count(*) FILTER (WHERE actual = 'no_workaround' AND predicted = 'workaround') AS fpos FROM ev)
"""


@sql("dashboard_base")
def _():
    return _base_prelude() + "SELECT annotation_id, primary_label, actual, predicted, probability, error_type FROM base2"


@sql("kpis")
def _():
    return _base_prelude() + f"""SELECT evaluated, correct, round({_div('correct', 'evaluated')}, 6) AS accuracy,
       round({_div('det', 'aw')}, 6) AS workaround_recall, missed AS missed_workarounds FROM k"""


@sql("kpis_from_record")
def _():
    return _lab_prelude() + f"""SELECT tn + fp + fn + tp AS evaluated, tn + tp AS correct, round({_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy,
       CAST(0.0 AS DOUBLE) AS workaround_recall FROM cm"""


@sql("evaluation_summary")
def _():
    return _base_prelude() + """SELECT 'Evaluated records' AS metric, evaluated AS records FROM k
UNION ALL SELECT 'Correct predictions', correct FROM k
UNION ALL SELECT 'False negatives', missed FROM k
UNION ALL SELECT 'False positives', fpos FROM k"""


@sql("opportunity_kpis")
def _():
    return _opp_prelude() + """SELECT count(*) AS confirmed_signals, round(coalesce(avg(opportunity_score), 0.0), 6) AS average_score,
       count(*) FILTER (WHERE lower(confidence) = 'high') AS high_confidence_signals,
       count(DISTINCT repository) AS repositories FROM opp"""


@sql("merged_thread_counts")
def _():
    return f"""WITH {comments_cte()}
SELECT repository, count(DISTINCT substr(CAST(created_at AS VARCHAR), 1, 10)) AS days, count(DISTINCT issue_number) AS threads, TRUE AS within_bound
FROM comments GROUP BY repository"""


@sql("facets")
def _():
    c = strip("confidence")
    return _opp_prelude() + f"""SELECT DISTINCT facet, value FROM (
  SELECT 'confidence' AS facet, upper(left({c}, 1)) || lower(substr({c}, 2)) AS value FROM opp
  UNION ALL
  SELECT 'cost_type', {strip('v')} FROM (SELECT unnest(string_split(coalesce(cost_type, ''), '|')) AS v FROM opp))
WHERE value <> ''"""


@sql("opportunity_filter")
def _():
    cols = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ["title", "user_goal", "obstacle", "workaround", "human_cost", "underlying_need"])
    return _opp_prelude() + f"""SELECT annotation_id, opportunity_score FROM opp
WHERE lower(confidence) = 'medium' AND contains(lower(cost_type), 'time') AND regexp_matches(concat_ws(' ', {cols}), '(?i)the')"""


@sql("record_filter")
def _():
    return _base_prelude() + """SELECT annotation_id, actual, predicted, error_type FROM base2
WHERE actual IN ('workaround') AND error_type IN ('false_negative', 'correct')"""


# -- ingest ------------------------------------------------------------------------------
def _pages_prelude() -> str:
    base = "'https://api.example.org/repos/' || repository || '/issues?page='"
    return f"""WITH {issues_cte()},
{comments_cte()},
pg AS (SELECT DISTINCT repository, issue_number // {A.PAGE_SIZE} AS page FROM issues),
lp AS (SELECT repository, max(page) AS last_page FROM pg GROUP BY repository),
pages AS (SELECT repository, page, {base} || CAST(page AS VARCHAR) AS url, 200 AS status,
                 CASE WHEN page < last_page THEN {base} || CAST(page + 1 AS VARCHAR) END AS next_url
          FROM pg JOIN lp USING (repository)),
flat AS (SELECT * FROM issues WHERE state <> 'closed')
"""


@sql("issues_flatten")
def _():
    return _pages_prelude() + """SELECT repository, issue_number, title, state, labels, CAST(comments_count AS BIGINT) AS comments_count,
       created_at, CAST(body_length AS BIGINT) AS body_length, issue_url FROM flat"""


@sql("pull_request_filter")
def _():
    return _pages_prelude() + "SELECT repository, issue_number FROM issues WHERE state = 'closed'"


@sql("newest_per_repo")
def _():
    return _pages_prelude() + f"""SELECT repository, issue_number, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY repository ORDER BY created_at DESC NULLS LAST, issue_number DESC) AS rn FROM flat)
WHERE rn <= {Q.NEWEST_PER_REPO}"""


@sql("comment_positions")
def _():
    return f"""WITH {comments_cte()}
SELECT comment_id, CAST(row_number() OVER (PARTITION BY repository, issue_number ORDER BY created_at NULLS LAST, comment_id) AS BIGINT) AS position_in_thread
FROM comments"""


@sql("comments_capped")
def _():
    return f"""WITH {comments_cte()}
SELECT repository, issue_number, comment_id FROM (
  SELECT *, row_number() OVER (PARTITION BY repository, issue_number ORDER BY position_in_thread, comment_id) AS rn FROM comments)
WHERE rn <= {Q.COMMENT_CAP}"""


@sql("richest_issues")
def _():
    return _pages_prelude() + """SELECT repository, issue_number, CAST(coalesce(comments_count, 0) AS BIGINT) AS comments_count FROM flat
WHERE coalesce(comments_count, 0) > 0 ORDER BY comments_count DESC, issue_number, repository LIMIT 25"""


@sql("issues_nested")
def _():
    return _pages_prelude() + f""",
cm AS (SELECT *, '{A.URL_ROOT}' || repository || '/' || CAST(issue_number AS VARCHAR) || '#c' || CAST(position_in_thread AS VARCHAR) AS comment_url FROM comments),
agg AS (SELECT repository, issue_number, count(*) AS n,
               string_agg(author, ',' ORDER BY position_in_thread, comment_id) AS authors,
               string_agg(CAST(comment_id AS VARCHAR), ',' ORDER BY position_in_thread, comment_id) AS ids,
               string_agg(CAST(position_in_thread AS VARCHAR), ',' ORDER BY position_in_thread, comment_id) AS places,
               string_agg(author_association || '/' || created_at || '/' || created_at || '/' || comment_url, ',' ORDER BY position_in_thread, comment_id) AS meta,
               string_agg(CASE WHEN {strip('comment_body')} <> '' THEN {strip('comment_body')} END, {NL} || {NL} ORDER BY position_in_thread, comment_id) AS txt
        FROM cm GROUP BY repository, issue_number)
SELECT f.repository AS repo, f.issue_number, f.labels, CAST(f.comments_count AS BIGINT) AS comment_count,
       CAST(f.comments_count AS BIGINT) AS reaction_count,
       CAST(CASE WHEN f.comments_count > 0 THEN coalesce(a.n, 0) ELSE 0 END AS BIGINT) AS n_comments,
       CASE WHEN f.comments_count > 0 THEN coalesce(a.authors, '') ELSE '' END AS authors,
       CASE WHEN f.comments_count > 0 THEN coalesce(a.ids, '') ELSE '' END AS comment_ids,
       CASE WHEN f.comments_count > 0 THEN coalesce(a.places, '') ELSE '' END AS positions,
       CASE WHEN f.comments_count > 0 THEN coalesce(a.meta, '') ELSE '' END AS comment_meta,
       CASE WHEN f.comments_count > 0 THEN coalesce(a.txt, '') ELSE '' END AS comments_text
FROM flat f LEFT JOIN agg a ON f.repository = a.repository AND f.issue_number = a.issue_number"""


@sql("payload_quarantine")
def _():
    return _pages_prelude() + """SELECT repository, url || '&try=1' AS url, 'status 403' AS reason FROM pages WHERE page % 3 = 0
UNION ALL SELECT repository, url || '&try=2', 'unexpected response format' FROM pages WHERE page % 3 = 0"""


@sql("comment_quarantine")
def _():
    return f"""WITH {comments_cte()},
pg AS (SELECT DISTINCT repository, issue_number, CAST((position_in_thread - 1) // {A.COMMENT_PAGE_SIZE} + 1 AS INTEGER) AS page_number FROM comments)
SELECT repository, issue_number, page_number, unnest(['status 403', 'unexpected response format']) AS reason FROM pg WHERE page_number % 3 = 0"""


@sql("updated_per_repo")
def _():
    return _pages_prelude() + """SELECT repository, issue_number, updated_at FROM (
  SELECT *, created_at AS updated_at, row_number() OVER (PARTITION BY repository ORDER BY created_at DESC NULLS LAST, issue_number DESC) AS rn FROM flat)
WHERE rn <= 175"""


@sql("crawl_links")
def _():
    return _pages_prelude() + """SELECT repository, url, next_url FROM pages
UNION ALL SELECT repository, url || unnest(['&try=1', '&try=2']), next_url FROM pages WHERE page % 3 = 0"""


@sql("crawl_frontier")
def _():
    return _pages_prelude() + """, landed AS (SELECT * FROM pages WHERE next_url IS NOT NULL)
SELECT DISTINCT repository, next_url FROM landed WHERE next_url NOT IN (SELECT url FROM landed)"""


# -- features ---------------------------------------------------------------------------
_WORD_RE2 = r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}"


def _word_counts_cte(source: str = "documents") -> str:
    return f"""d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '{_WORD_RE2}') AS toks
      FROM {source}),
t AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM d),
g AS (SELECT doc_id, tok AS term FROM t
      UNION ALL
      SELECT doc_id, tok || ' ' || nxt FROM (SELECT doc_id, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM t)
      WHERE nxt IS NOT NULL),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM {source})"""


@sql("document_frequencies")
def _():
    return f"WITH {_word_counts_cte()}\nSELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM c GROUP BY term"


@sql("word_ngram_tfidf")
def _():
    from threadlens.operators.model import BASELINE

    return f"""WITH {_word_counts_cte()},
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term),
v AS (SELECT st.* FROM st, nd WHERE st.df <= CAST({BASELINE.word_max_df} AS DOUBLE) * nd.n ORDER BY total DESC, term LIMIT {BASELINE.word_max_features}),
vi AS (SELECT v.term, ln((1.0 + nd.n) / (1.0 + v.df)) + 1.0 AS idf FROM v, nd),
w AS (SELECT c.doc_id, c.term, (1.0 + ln(c.tf)) * vi.idf AS w FROM c JOIN vi ON c.term = vi.term),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT w.doc_id, w.term, round(w.w / nr.norm, 6) AS tfidf FROM w JOIN nr ON w.doc_id = nr.doc_id"""


@sql("char_vocabulary")
def _():
    from threadlens.functions.text import WS_CLASS_RE2
    from threadlens.operators.model import IMPROVED

    return f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
wd AS (SELECT doc_id, ' ' || x || ' ' AS w FROM (SELECT doc_id, unnest(string_split_regex(t, '{WS_CLASS_RE2}+')) AS x FROM d) WHERE x <> ''),
s AS (SELECT doc_id, w, length(w) AS l, k FROM wd, (VALUES (3), (4), (5)) sizes(k) WHERE k = 3 OR length(w) > k - 1),
g AS (SELECT doc_id, w AS term FROM s WHERE l <= k
      UNION ALL
      SELECT doc_id, substr(w, i, k) FROM (SELECT doc_id, w, k, unnest(range(1, l - k + 2)) AS i FROM s WHERE l > k)),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term),
nd AS (SELECT count(*) AS n FROM d),
st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM c GROUP BY term)
SELECT term, df, total, round(ln((1.0 + nd.n) / (1.0 + df)) + 1.0, 6) AS idf FROM st, nd
ORDER BY total DESC, term LIMIT {IMPROVED.char_max_features}"""


def _union_cte() -> str:
    """Both feature blocks: words first, the character block's indices after them."""
    from threadlens.functions.text import WS_CLASS_RE2
    from threadlens.operators.model import IMPROVED

    return f"""{_word_counts_cte()},
wv AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term) ORDER BY total DESC, term LIMIT {IMPROVED.word_max_features}),
wi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1.0 + nd.n) / (1.0 + df)) + 1.0 AS idf FROM wv, nd),
ct AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
wd AS (SELECT doc_id, ' ' || x || ' ' AS w FROM (SELECT doc_id, unnest(string_split_regex(t, '{WS_CLASS_RE2}+')) AS x FROM ct) WHERE x <> ''),
sz AS (SELECT doc_id, w, length(w) AS l, k FROM wd, (VALUES (3), (4), (5)) sizes(k) WHERE k = 3 OR length(w) > k - 1),
cg AS (SELECT doc_id, w AS term FROM sz WHERE l <= k
       UNION ALL
       SELECT doc_id, substr(w, i, k) FROM (SELECT doc_id, w, k, unnest(range(1, l - k + 2)) AS i FROM sz WHERE l > k)),
cc AS (SELECT doc_id, term, count(*) AS tf FROM cg GROUP BY doc_id, term),
cv AS (SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM cc GROUP BY term) ORDER BY total DESC, term LIMIT {IMPROVED.char_max_features}),
ci AS (SELECT term, row_number() OVER (ORDER BY term) - 1 + (SELECT count(*) FROM wi) AS idx, ln((1.0 + nd.n) / (1.0 + df)) + 1.0 AS idf FROM cv, nd),
e AS (SELECT doc_id, 0 AS block, idx, (1.0 + ln(tf)) * idf AS w FROM c JOIN wi USING (term)
      UNION ALL SELECT doc_id, 1, idx, (1.0 + ln(tf)) * idf FROM cc JOIN ci USING (term)),
u AS (SELECT doc_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, block)) AS value FROM e)"""


@sql("feature_union")
def _():
    return f"WITH {_union_cte()}\nSELECT doc_id, CAST(idx AS BIGINT) AS idx, round(value, 6) AS value FROM u"


@sql("linear_scores")
def _():
    return f"""WITH {_union_cte()},
p AS (SELECT doc_id, round(1.0 / (1.0 + exp(-(sum(value * ((idx % 7 - 3) / 4.0)) + {Q.SCORE_INTERCEPT}))), 6) AS probability FROM u GROUP BY doc_id)
SELECT doc_id, probability, CASE WHEN probability >= 0.5 THEN 'workaround' ELSE 'no_workaround' END AS prediction FROM p"""


@sql("oof_coverage")
def _():
    hw = lower_clean("has_workaround")
    return f"""WITH {labelled_cte(A.SIGNAL)},
l2 AS (SELECT annotation_id, CASE WHEN {hw} = 'yes' THEN 1 ELSE 0 END AS target FROM labelled
       WHERE {hw} IN ('yes', 'no') AND {strip('thread_text')} <> ''),
k AS (SELECT least(5, count(*) FILTER (WHERE target = 1), count(*) FILTER (WHERE target = 0)) AS k FROM l2)
SELECT annotation_id,
       CAST((row_number() OVER (PARTITION BY target ORDER BY md5(concat_ws(':', annotation_id, '42')), annotation_id) - 1) % k.k AS BIGINT) AS fold,
       CASE WHEN target = 1 THEN 'workaround' ELSE 'no_workaround' END AS actual_label,
       CAST(1 AS BIGINT) AS scores, CAST(1 AS BIGINT) AS valid_scores
FROM l2, k"""


@sql("fit_optimality")
def _():
    from threadlens.operators.model import BASELINE

    hw = lower_clean("has_workaround")
    return f"""WITH {labelled_cte(A.SIGNAL)},
l2 AS (SELECT annotation_id AS doc_id, {strip('thread_text')} AS text, CASE WHEN {hw} = 'yes' THEN 1 ELSE 0 END AS target
       FROM labelled WHERE {hw} IN ('yes', 'no') AND {strip('thread_text')} <> ''),
{_word_counts_cte('l2')},
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term),
v AS (SELECT st.* FROM st, nd WHERE st.df <= CAST({BASELINE.word_max_df} AS DOUBLE) * nd.n ORDER BY total DESC, term LIMIT {BASELINE.word_max_features}),
w AS (SELECT c.doc_id, c.term, (1.0 + ln(c.tf)) * (ln((1.0 + nd.n) / (1.0 + v.df)) + 1.0) AS w FROM c JOIN v USING (term), nd),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM w),
nn AS (SELECT count(*) AS n, sum(target) AS pos FROM l2),
r AS (SELECT doc_id, (0.5 - target) / (2.0 * CASE WHEN target = 1 THEN pos ELSE n - pos END) AS r FROM l2, nn),
slopes AS (SELECT sum(value * r) AS slope FROM u JOIN r USING (doc_id) GROUP BY term UNION ALL SELECT sum(r) FROM r)
SELECT (SELECT n FROM nn) AS rows, round(max(abs(slope)), 8) AS zero_slope, TRUE AS converged FROM slopes"""


@sql("objective_slopes")
def _():
    from threadlens.operators.model import IMPROVED

    hw = lower_clean("has_workaround")
    return f"""WITH {labelled_cte(A.SIGNAL)},
{_union_cte()},
y AS (SELECT issue_number AS doc_id, CASE WHEN {hw} = 'yes' THEN 1 ELSE 0 END AS target FROM labelled WHERE {hw} IN ('yes', 'no')),
nn AS (SELECT count(*) AS n, sum(target) AS pos FROM y),
m AS (SELECT y.doc_id, y.target, coalesce(sum(value * ((idx % 7 - 3) / 4.0)), 0.0) + {Q.SCORE_INTERCEPT} AS z FROM y LEFT JOIN u USING (doc_id) GROUP BY y.doc_id, y.target),
r AS (SELECT doc_id, (1.0 / (1.0 + exp(-z)) - target) / (2.0 * CASE WHEN target = 1 THEN pos ELSE n - pos END) AS r FROM m, nn),
k AS (SELECT idx, sum(value * r) AS g FROM u JOIN r USING (doc_id) GROUP BY idx)
SELECT CAST(i.idx AS BIGINT) AS idx, round(coalesce(k.g, 0.0) + ((i.idx % 7 - 3) / 4.0) / ({IMPROVED.C} * nn.n), 8) AS slope
FROM (SELECT unnest(range({Q.SCORED_TERMS})) AS idx) i LEFT JOIN k USING (idx), nn
UNION ALL SELECT -1, round(sum(r), 8) FROM r"""


@sql("training_set_summary")
def _():
    from threadlens.operators.model import BASELINE, IMPROVED

    def part(name, eligible, text, target):
        kept = f"({eligible} AND length({text}) > 0)"
        return (
            f"SELECT '{name}' AS model_name, count(*) FILTER (WHERE {eligible}) AS considered_records, "
            f"count(*) FILTER (WHERE {eligible} AND length({text}) = 0) AS dropped_empty_text, "
            f"count(*) FILTER (WHERE {kept}) AS kept_records, "
            f"count(*) FILTER (WHERE {kept} AND {target} = 1) AS workaround_records, "
            f"count(*) FILTER (WHERE {kept} AND {target} = 0) AS non_workaround_records FROM labelled"
        )

    hw = lower_clean("has_workaround")
    base = part(BASELINE.name, f"({hw} IN ('yes', 'no'))", strip("thread_text"), f"(CASE WHEN {hw} = 'yes' THEN 1 WHEN {hw} = 'no' THEN 0 END)")
    imp = part(
        IMPROVED.name,
        f"({strip('primary_label')} <> '')",
        _model_text("title", "thread_text"),
        f"(CASE WHEN {lower_clean('primary_label')} = 'workaround' THEN 1 ELSE 0 END)",
    )
    return f"WITH {labelled_cte(A.SIGNAL)}\n{base}\nUNION ALL\n{imp}"


@sql("comments_flatten")
def _():
    return f"""WITH {comments_cte()}
SELECT repository, issue_number, comment_id, CAST(position_in_thread AS BIGINT) AS position_in_thread,
       CAST(comment_length AS BIGINT) AS comment_length, author, author_association, user_type FROM comments"""


@sql("error_overview")
def _():
    return _fn_prelude() + """SELECT count(*) AS evaluated_records, count(*) FILTER (WHERE actual = predicted) AS correct_predictions,
       count(*) FILTER (WHERE actual = 'workaround' AND predicted = 'no_workaround') AS false_negatives,
       count(*) FILTER (WHERE actual = 'no_workaround' AND predicted = 'workaround') AS false_positives FROM comb"""


# -- thread order with missing positions ----------------------------------------------
@sql("thread_comments_unplaced")
def _():
    sep = lit("\n\n--- COMMENT ---\n\n")
    return f"""WITH {comments_cte()}
SELECT repository, issue_number, string_agg(nb, {sep} ORDER BY p NULLS LAST, comment_id) AS comments_text
FROM (SELECT repository, issue_number, comment_id, CASE WHEN comment_id % 5 <> 0 THEN position_in_thread END AS p, {normalize('comment_body')} AS nb FROM comments)
WHERE nb <> '' GROUP BY repository, issue_number"""


# -- clusters: the seeding draws and every Lloyd round, unrolled ------------------------
def _draw(salt: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':{salt}'), 1, 12) AS BIGINT) / {float(1 << 48)})"


def _nearest(name: str, centres: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT id, v, c, dist FROM (
    SELECT e.id, e.v, s.id AS c, list_distance(e.v, s.v) AS dist, row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.v, s.v), s.id) AS r
    FROM e CROSS JOIN {centres} s) WHERE r = 1)"""


def _clusters_sql() -> str:
    salt, k = Q.CLUSTER_SALT, Q.CLUSTERS
    parts = [
        """e AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1))""",
        f"s0 AS MATERIALIZED (SELECT id, v FROM e ORDER BY {_draw(salt)}, id LIMIT 1)",
    ]
    for r in range(1, Q.SEED_ROUNDS + 1):
        parts.append(_nearest(f"f{r}", f"s{r - 1}"))
        parts.append(
            f"""s{r} AS MATERIALIZED (SELECT id, v FROM s{r - 1} UNION
  SELECT id, v FROM f{r} WHERE {_draw(salt + r)} < dist * dist * ({2 * k} / (SELECT sum(dist * dist) FROM f{r})))"""
        )
    parts.append(_nearest("fw", f"s{Q.SEED_ROUNDS}"))
    parts.append("c0 AS MATERIALIZED (SELECT s.id, s.v FROM s%d s LEFT JOIN (SELECT c, count(*) AS n FROM fw GROUP BY c) w ON s.id = w.c ORDER BY coalesce(n, 0) DESC, s.id LIMIT %d)" % (Q.SEED_ROUNDS, k))
    for r in range(1, Q.CLUSTER_ROUNDS + 1):
        parts.append(_nearest(f"a{r}", f"c{r - 1}"))
        parts.append(
            f"""c{r} AS MATERIALIZED (SELECT c.id, coalesce(m.v, c.v) AS v FROM c{r - 1} c LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, avg(x) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c
  ) m ON c.id = m.c)"""
        )
    parts.append(_nearest("final", f"c{Q.CLUSTER_ROUNDS}"))
    return "WITH " + ",\n".join(parts) + "\n"


@sql("vector_clusters")
def _():
    return _clusters_sql() + "SELECT id AS vec_id, c AS cluster, round(dist, 6) AS distance FROM final"


@sql("cluster_summary")
def _():
    return _clusters_sql() + "SELECT c AS cluster, count(*) AS members, round(avg(dist), 6) AS mean_distance, round(max(dist), 6) AS radius FROM final GROUP BY c"


# -- agreement --------------------------------------------------------------------------
def _pairs_sql() -> str:
    return f"""WITH {labelled_cte(None)},
one AS (SELECT annotation_id AS id, {lower_clean('primary_label')} AS label FROM labelled WHERE issue_number % 19 <> 2),
two AS (SELECT annotation_id AS id, {lower_clean("CASE WHEN issue_number % 13 = 5 THEN ' ' WHEN issue_number % 7 = 0 THEN 'Bug_Report ' WHEN issue_number % 17 = 1 THEN 'question' ELSE primary_label END")} AS label
  FROM labelled WHERE issue_number % 11 <> 3),
pairs AS (SELECT nullif(one.label, '') AS a, nullif(two.label, '') AS b FROM one FULL JOIN two ON one.id = two.id),
judged AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
labels AS (SELECT a AS label FROM pairs WHERE a IS NOT NULL UNION SELECT b FROM pairs WHERE b IS NOT NULL)
"""


@sql("annotator_agreement")
def _():
    return _pairs_sql() + """, counted AS (
  SELECT label, (SELECT count(*) FROM judged) AS n_both, (SELECT count(*) FROM judged WHERE a = label) AS n_first, (SELECT count(*) FROM judged WHERE b = label) AS n_second,
    (SELECT count(*) FROM judged WHERE (a = label) = (b = label)) AS agreed, (SELECT count(*) FROM pairs WHERE (a IS NULL AND b = label) OR (b IS NULL AND a = label)) AS one_sided
  FROM labels),
scored AS (
  SELECT *, (n_first * n_second + (n_both - n_first) * (n_both - n_second)) / (n_both * n_both) AS expected FROM counted
  UNION ALL
  SELECT '(overall)', n_both, sum(n_first), sum(n_second), (SELECT count(*) FROM judged WHERE a = b), sum(one_sided), sum(n_first * n_second) / (n_both * n_both) FROM counted GROUP BY n_both)
SELECT label, CAST(n_both AS BIGINT) AS n_both, CAST(n_first AS BIGINT) AS n_first, CAST(n_second AS BIGINT) AS n_second, CAST(agreed AS BIGINT) AS agreed, CAST(one_sided AS BIGINT) AS one_sided,
  round(agreed / n_both, 9) AS observed, round(expected, 9) AS expected, round((agreed / n_both - expected) / (1 - expected), 9) AS kappa FROM scored"""


@sql("annotator_cross_tab")
def _():
    return _pairs_sql() + "SELECT a AS first_label, b AS second_label, count(*) AS n FROM pairs GROUP BY a, b"


# -- recurrence -------------------------------------------------------------------------
def _weekly_sql() -> str:
    return thread_prelude(A.CORPUS) + f""", cues AS (
  SELECT issue_number, state, unnest(string_split(matched_patterns, ' | ')) AS cue FROM threads WHERE matched_patterns <> ''),
weekly AS (
  SELECT cue, CAST(date_trunc('week', DATE '{A.EPOCH_DATE}' + CAST(issue_number * 37 % 364 AS INTEGER)) AS DATE) AS week, count(*) AS n_threads, count(*) FILTER (state = 'open') AS n_open
  FROM cues GROUP BY ALL),
marked AS (SELECT *, CASE WHEN week - lag(week) OVER (PARTITION BY cue ORDER BY week) = 7 THEN 0 ELSE 1 END AS starts FROM weekly),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY cue ORDER BY week) AS run FROM marked),
runs AS (SELECT cue, run, min(week) AS run_start, max(week) AS run_end, count(*) AS weeks, CAST(sum(n_threads) AS BIGINT) AS n_threads, CAST(sum(n_open) AS BIGINT) AS n_open FROM numbered GROUP BY cue, run),
gaps AS (SELECT *, (run_start - lag(run_end) OVER (PARTITION BY cue ORDER BY run)) // 7 - 1 AS gap_weeks FROM runs)
"""


@sql("cue_runs")
def _():
    return _weekly_sql() + "SELECT cue, CAST(run_start AS VARCHAR) AS run_start, CAST(run_end AS VARCHAR) AS run_end, weeks, n_threads, n_open, gap_weeks FROM gaps"


@sql("cue_recurrence")
def _():
    return _weekly_sql() + """, ends AS (SELECT max(week) AS last_week FROM weekly),
spells AS (SELECT cue, (last_week - min(week)) // 7 + 1 AS spell FROM weekly, ends WHERE n_open > 0 GROUP BY cue, last_week)
SELECT g.cue, CAST(sum(n_threads) AS BIGINT) AS n_threads, CAST(sum(weeks) AS BIGINT) AS n_weeks, count(*) AS n_runs, max(weeks) AS longest_run, coalesce(max(gap_weeks), 0) AS longest_gap,
  CAST(min(run_start) AS VARCHAR) AS first_week, CAST(max(run_end) AS VARCHAR) AS latest_week, CAST(sum(n_open) AS BIGINT) AS n_open,
  coalesce(any_value(spell), 0) AS open_spell_weeks, max(run_end) = any_value(last_week) AS persists
FROM gaps g LEFT JOIN spells ON g.cue = spells.cue, ends GROUP BY g.cue"""


# -- leave one repository out -----------------------------------------------------------
@sql("repository_folds")
def _():
    hw = lower_clean("has_workaround")
    return f"""WITH {labelled_cte(None)},
l2 AS (SELECT annotation_id, coalesce(repository, '') AS repository, CASE WHEN {hw} = 'yes' THEN 'workaround' ELSE 'no_workaround' END AS actual_label FROM labelled
       WHERE {hw} IN ('yes', 'no') AND {strip('thread_text')} <> ''),
r AS (SELECT repository, CAST((row_number() OVER (ORDER BY md5(concat_ws(':', repository, '42')), repository) - 1) % {Q.REPOSITORY_FOLDS} AS BIGINT) AS fold FROM (SELECT DISTINCT repository FROM l2)),
p AS (SELECT l2.*, fold FROM l2 JOIN r USING (repository))
SELECT annotation_id, repository, fold, actual_label, count(*) AS scores, count(*) AS valid_scores, (SELECT count(*) FROM p o WHERE o.fold <> p.fold) AS trained_rows
FROM p GROUP BY ALL"""


@sql("held_out_frequencies")
def _():
    return f"""WITH {_word_counts_cte()},
s AS (SELECT source, term, count(*) AS df, sum(tf) AS total FROM c JOIN documents USING (doc_id) GROUP BY source, term),
a AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY term)
SELECT s.source, s.term, a.df - s.df AS df, CAST(a.total - s.total AS BIGINT) AS total FROM s JOIN a USING (term) WHERE a.df > s.df"""


# -- incremental collection: what the batch flattening gives -----------------------------
ORACLE["collected_issues"] = ORACLE["issues_flatten"]
