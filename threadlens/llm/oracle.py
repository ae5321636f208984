"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_HOST = r"translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1)"

OP1 = rf"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS canonical,
    try_cast(regexp_extract(path, '([0-9]+)(\.html)?/*$', 1) AS BIGINT) AS doc_id
  FROM p
),
listed AS (SELECT DISTINCT canonical FROM c WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND canonical IS NOT NULL),
rules(rhost, rpath, ruled) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(ruled, length(rhost || rpath)) AS ruled
  FROM (SELECT DISTINCT page_id, host, path FROM c) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT c.page_id, c.host, c.path, rule,
  coalesce(ruled, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN listed l ON c.canonical = l.canonical
LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.host = b.host AND c.path = b.path
"""

# A line without its outer white space, as the operator compares it.
_BARE = r"trim(regexp_replace({}, '[\t\r\v\f]+', ' ', 'g'), ' ')"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT rid, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d),
k AS (SELECT rid, site, line_no, line, CASE WHEN trim(line, ' ') <> '' THEN {_BARE.format('line')} END AS bare FROM x),
totals AS (SELECT site, count(*) AS pages FROM d GROUP BY site),
bad AS (
  SELECT site, bare FROM (SELECT DISTINCT rid, site, bare FROM k WHERE bare IS NOT NULL) JOIN totals USING (site)
  GROUP BY site, bare, pages HAVING count(*) >= 2 AND count(*) > pages * 0.1
),
kept AS (
  SELECT k.rid, count(*) AS n_lines, count(*) FILTER (bad.bare IS NOT NULL) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (bad.bare IS NULL), '') AS body
  FROM k LEFT JOIN bad ON k.site = bad.site AND k.bare = bad.bare GROUP BY k.rid
)
SELECT doc_id, source, CASE WHEN text IS NOT NULL THEN body END AS text, n_lines, n_dropped FROM d JOIN kept USING (rid)
"""

OP7 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM n JOIN g USING (content)
"""


def _edit(state: str, cost: str, letter: str) -> str:
    """A state (six digits of cost, then the edits' letters) after one more edit; null stays null."""
    return f"lpad(CAST(CAST(left({state}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7) || '{letter}'"


_CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"""

_WS = r"[\x20\x09-\x0D]"

# States of the repaired initials (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a.
OP12 = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
f AS (SELECT *, CAST({_CRC} AS BIGINT) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) FROM f)
),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
q AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
    CASE WHEN regexp_full_match(text, '{_WS}*') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[.!?]{_WS}*$') THEN 'none' ELSE 'truncated' END AS fault
  FROM p
),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM q GROUP BY conv_id
),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM facts
  UNION ALL
  SELECT i.conv_id, q.pos, {_edit('s0', '4', 'D')},
    least({_edit('s1', '4', 'D')}, CASE WHEN may AND initial = 's' THEN {_edit('s0', 'more', 'K')} END),
    least({_edit('s2', '4', 'D')}, CASE WHEN may AND initial = 'u' THEN {_edit('least(s0, s1, s3)', 'more', 'K')} END, CASE WHEN may THEN {_edit('least(s0, s1, s3)', '3 + more', 'R')} END),
    least({_edit('s3', '4', 'D')}, CASE WHEN may AND initial = 'a' THEN {_edit('s2', 'more', 'K')} END, CASE WHEN may THEN {_edit('s2', '3 + more', 'R')} END)
  FROM (SELECT conv_id, pos, s0, s1, s2, least(s3, {_edit('s2', '3', 'I')}) AS s3
    FROM (SELECT conv_id, pos, s0, s1, s3, least(s2, {_edit('least(s0, s1, s3)', '3', 'I')}) AS s2 FROM path)) i
  JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS may, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM q) q
    ON q.conv_id IS NOT DISTINCT FROM i.conv_id AND q.pos = i.pos + 1
),
best AS (
  SELECT path.conv_id, least(s0, s3, {_edit('s2', '3', 'I')}, {_edit('s1', '6', 'II')}) AS best
  FROM path JOIN facts ON path.conv_id IS NOT DISTINCT FROM facts.conv_id AND path.pos = facts.n
),
letters AS (SELECT conv_id, substr(best, 7) AS audit, unnest(range(1, length(best) - 5)) AS step FROM best),
steps AS (
  SELECT conv_id, step, audit[step] AS letter,
    length(regexp_replace(audit[1:step], 'I', '', 'g')) AS pos, length(regexp_replace(audit[1:step], 'D', '', 'g')) AS made FROM letters
),
lines AS (
  SELECT steps.*, q.role, q.text, max(CASE WHEN made = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY steps.conv_id) AS has_s
  FROM steps LEFT JOIN q ON letter <> 'I' AND q.conv_id IS NOT DISTINCT FROM steps.conv_id AND q.pos = steps.pos WHERE letter <> 'D'
),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY step) AS body
  FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(left(best, 6), '0') AS BIGINT) AS cost, coalesce(substr(best, 7), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1,
    "op2_line_dedup": OP2,
    "op7_exact_dedup": OP7,
    "op12_repair_conversations": OP12,
}
