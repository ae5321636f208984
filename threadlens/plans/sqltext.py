"""DuckDB SQL fragments for the independent oracle (RE2 regex, ``chr`` literals).

These restate the library's column semantics in plain SQL so every
registered query can be checked against a second engine.
"""

from __future__ import annotations

from threadlens.functions.cues import CueDictionary
from threadlens.functions.text import WS_CLASS_RE2
from threadlens.plans import adapters as A

NL = "chr(10)"
CR = "chr(13)"
STRIP_RE2 = f"^{WS_CLASS_RE2}+|{WS_CLASS_RE2}+$"


def lit(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)`` concatenations."""
    pieces = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in pieces]
    return (" || " + NL + " || ").join(quoted) if len(quoted) > 1 else quoted[0]


def strip(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '{STRIP_RE2}', '', 'g')"


def lower_clean(x: str) -> str:
    return f"lower({strip(x)})"


def normalize(x: str) -> str:
    t = f"replace(coalesce(CAST({x} AS VARCHAR), ''), {CR} || {NL}, {NL})"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    return strip(t)


def cue_case(x: str, name: str, pattern: str, d: CueDictionary) -> str:
    return f"CASE WHEN regexp_matches(coalesce({x}, ''), {lit(d.re2_pattern(pattern))}) THEN {lit(name)} END"


def cue_names(x: str, d: CueDictionary, sep: str = " | ") -> str:
    cases = ", ".join(cue_case(x, n, p, d) for n, p in d.entries)
    return f"concat_ws({lit(sep)}, {cases})"


def cue_score(x: str, d: CueDictionary) -> str:
    terms = " + ".join(
        f"(CASE WHEN regexp_matches(coalesce({x}, ''), {lit(d.re2_pattern(p))}) THEN 1 ELSE 0 END)" for _, p in d.entries
    )
    return f"CAST(({terms}) AS INTEGER)"


def repository(conv: str = "conv_id") -> str:
    return f"('chat/' || substr(md5(CAST({conv} AS VARCHAR)), 1, 1))"


def created_at(conv: str = "conv_id") -> str:
    return (
        f"(CAST(DATE '{A.EPOCH_DATE}' + CAST({conv} // 24 AS INTEGER) AS VARCHAR) || 'T' || "
        f"lpad(CAST({conv} % 24 AS VARCHAR), 2, '0') || ':00:00Z')"
    )


def issues_cte() -> str:
    return f"""issues AS (
  SELECT {repository('c.conv_id')} AS repository,
         c.conv_id AS issue_number,
         split_part(coalesce(c.text, ''), {NL}, 1) AS title,
         coalesce(c.text, '') AS body,
         CASE WHEN c.role = 'system' THEN 'closed' ELSE 'open' END AS state,
         CAST(NULL AS VARCHAR) AS state_reason,
         'role:' || c.role AS labels,
         CAST(coalesce(k.comments_count, 0) AS INTEGER) AS comments_count,
         {created_at('c.conv_id')} AS created_at,
         {created_at('c.conv_id')} AS updated_at,
         CAST(NULL AS VARCHAR) AS closed_at,
         CAST(length(coalesce(c.text, '')) AS INTEGER) AS body_length,
         '{A.URL_ROOT}' || {repository('c.conv_id')} || '/' || CAST(c.conv_id AS VARCHAR) AS issue_url
  FROM conversations c
  LEFT JOIN (SELECT conv_id, count(*) FILTER (WHERE turn >= 1) AS comments_count FROM conversations GROUP BY conv_id) k
    ON c.conv_id = k.conv_id
  WHERE c.turn = 0)"""


def comments_cte() -> str:
    return f"""comments AS (
  SELECT {repository('conv_id')} AS repository,
         conv_id AS issue_number,
         conv_id * 1000 + turn AS comment_id,
         CAST(turn AS INTEGER) AS position_in_thread,
         coalesce(text, '') AS comment_body,
         CAST(length(coalesce(text, '')) AS INTEGER) AS comment_length,
         'user-' || role AS author,
         CASE WHEN role = 'assistant' THEN 'MEMBER' ELSE 'NONE' END AS author_association,
         CASE WHEN role = 'system' THEN 'Bot' ELSE 'User' END AS user_type,
         {created_at('conv_id')} AS created_at
  FROM conversations WHERE turn >= 1)"""


def comment_text_cte() -> str:
    sep = lit("\n\n--- COMMENT ---\n\n")
    return f"""ct AS (
  SELECT repository, issue_number,
         string_agg(nb, {sep} ORDER BY position_in_thread, comment_id) AS comments_text
  FROM (SELECT repository, issue_number, position_in_thread, comment_id, {normalize('comment_body')} AS nb FROM comments)
  WHERE nb <> ''
  GROUP BY repository, issue_number)"""


def threads_cte(d: CueDictionary | None = None) -> str:
    th = (
        f"concat_ws({NL} || {NL}, 'TITLE:' || {NL} || {normalize('i.title')}, "
        f"'ISSUE DESCRIPTION:' || {NL} || {normalize('i.body')}, "
        f"CASE WHEN coalesce(ct.comments_text, '') <> '' THEN 'DISCUSSION:' || {NL} || ct.comments_text END)"
    )
    return f"""threads0 AS (
  SELECT i.*, coalesce(ct.comments_text, '') AS comments_text, {th} AS thread_text
  FROM issues i LEFT JOIN ct ON i.repository = ct.repository AND i.issue_number = ct.issue_number)"""


def thread_prelude(d: CueDictionary) -> str:
    return (
        "WITH " + issues_cte() + ",\n" + comments_cte() + ",\n" + comment_text_cte() + ",\n" + threads_cte() + f""",
threads AS (
  SELECT *, {cue_score('thread_text', d)} AS heuristic_score, {cue_names('thread_text', d)} AS matched_patterns
  FROM threads0)
"""
    )


def line(x: str, i: int) -> str:
    return f"coalesce(string_split({x}, {NL})[{i}], '')"


def labelled_cte(d: CueDictionary | None = A.SIGNAL) -> str:
    rule = "CASE " + " ".join(f"WHEN l.quality = {q} AND l.toxic = {t} THEN '{n}'" for q, t, n in A.LABEL_RULE) + " END"
    fields = ["user_goal", "obstacle", "workaround", "human_cost", "underlying_need", "evidence_quote"]
    text = f"(CASE WHEN d.doc_id % {A.EMPTY_EVERY} = 5 THEN '' ELSE coalesce(d.text, '') END)"
    phrases = "[" + ", ".join(lit(x) for x in A.COST_PHRASES) + f"][d.doc_id % {len(A.COST_PHRASES)} + 1]"

    def field(i: int, f: str) -> str:
        x = line(text, i)
        return f"CASE WHEN {x} = '' THEN '' ELSE {x} || {phrases} END" if f == "human_cost" else x

    fcols = ",\n         ".join(
        f"CASE WHEN {rule} = 'workaround' THEN {field(i + 2, f)} ELSE '' END AS {f}" for i, f in enumerate(fields)
    )
    score = cue_score(text, d) if d is not None else "NULL"
    names = cue_names(text, d) if d is not None else "''"
    return f"""labelled AS (
  SELECT printf('NS-%04d', d.doc_id + 1) AS annotation_id,
         d.source AS repository,
         d.doc_id AS issue_number,
         '{A.URL_ROOT}' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS issue_url,
         {line(text, 1)} AS title,
         {text} AS thread_text,
         CAST(CAST(trunc(d.n_chars / 1000) AS BIGINT) AS VARCHAR) AS comments_count,
         CAST({score} AS VARCHAR) AS heuristic_score,
         {names} AS matched_patterns,
         {rule} AS primary_label,
         CASE WHEN {rule} = 'workaround' THEN 'yes' ELSE 'no' END AS has_workaround,
         {fcols},
         CASE WHEN d.n_chars < 1000 THEN 'low' WHEN d.n_chars < 5000 THEN 'medium' ELSE 'high' END AS confidence,
         '' AS annotator_notes
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
