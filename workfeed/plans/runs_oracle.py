"""DuckDB SQL for the queries of runs.py."""

from __future__ import annotations

from . import bindings as b
from .landed_oracle import _PLANNER, _WORK
from .landed_oracle import ORACLES as LANDED
from .oracle import ORACLES as ORACLE
from .oracle import _ATTACHED, _EVENTS, _HOMEWORK, _ITEMS, _KIND, _LINES, _STATE, _cut, _pick, _rfc, _short, _when

#: What the pages' character references stand for.
_DECODED = "replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"

_PLAIN = r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\v\f]+(\n|$)', '\1', 'g')"

_FETCHED = f"""WITH {_ITEMS}, {_PLANNER}, {_WORK}, gcal AS ({LANDED['calendar_feed']}), gdoc AS ({LANDED['whole_documents']})
SELECT id, 'canvas' AS source, kind, coalesce(CASE WHEN c_custkey % 3 = 0 THEN concat('C-', c_custkey) ELSE 'Course ' || c_custkey END, CAST(cid AS VARCHAR)) AS course, CAST(cid AS VARCHAR) AS course_id, shown AS title, url,
       {_rfc('due')} AS due_at, {_rfc('assigned_at')} AS assigned_at, points, md5('') AS description, 0 AS n_files, state, NULL AS grade
FROM stub LEFT JOIN customer ON c_custkey = cid
UNION ALL SELECT concat('classroom:', course_id, ':', ordinal), 'classroom', {_pick("'assignment', 'question', 'question', 'other'", "m", 4)}, NULL, course_id, title, url, {_rfc('due')}, {_rfc('assigned')}, CASE WHEN points > 0 THEN points END,
       md5(coalesce(description, '')), 1, CASE WHEN hand_state = 'RETURNED' THEN 'graded' WHEN hand_state = 'TURNED_IN' THEN 'submitted' WHEN due < {b.NOW} THEN 'missing' ELSE 'not_started' END,
       CASE WHEN hand_state = 'RETURNED' THEN CASE WHEN points > 0 THEN {_short('l_quantity')} || '/' || {_short('points')} ELSE {_short('l_quantity')} END END
FROM work WHERE kind NOT IN ('material', 'announcement') AND published = 'PUBLISHED'
UNION ALL SELECT concat('classroom:', course_id, ':', kind, ':', ordinal), 'classroom', kind, NULL, course_id, CASE WHEN kind = 'announcement' THEN 'First line of ' || title ELSE title END, url, NULL, {_rfc('assigned')}, NULL,
       md5(CASE WHEN kind = 'announcement' THEN chr(10) || ' First line of ' || title || chr(10) || 'more' ELSE coalesce(description, '') END), 1, NULL, NULL
FROM work WHERE kind IN ('material', 'announcement') AND published = 'PUBLISHED'
UNION ALL SELECT g.id, 'gdoc', kind, d.source, NULL, title, 'u', due_at, NULL, NULL, coalesce(said, md5('')), 0, NULL, NULL FROM gdoc g JOIN documents d ON CAST(d.doc_id AS VARCHAR) = split_part(g.id, ':', 2)
UNION ALL SELECT c.id, 'gcal', 'announcement', course, concat(split_part(c.id, ':', 2), '@feeds.example'), title, url, due_at, NULL, NULL, md5(''), 0, NULL, NULL FROM gcal c"""

ORACLES: dict[str, str] = {
    "fetched_table": _FETCHED,
    "fetch_errors": "SELECT 'classroom' AS source, true AS one_file, 'malformed page' AS error UNION ALL SELECT 'canvas', false, 'AnalysisException'",
    "homework_store": f"""WITH {_ITEMS}, {_HOMEWORK}
SELECT source, source_id, title, CASE WHEN CAST(source_id AS BIGINT) % 997 = 0 THEN 'submitted' ELSE status END AS status, due_at,
       CASE WHEN CAST(source_id AS BIGINT) % 997 = 0 THEN fetched_at + INTERVAL '1' DAY ELSE fetched_at END AS fetched_at FROM homework""",
    "stream_from_snapshot": """SELECT id, hash, n FROM (
  SELECT CAST(user_id AS VARCHAR) AS id, event_type AS hash, event_id AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
WHERE n >= (SELECT floor((min(event_id) + max(event_id)) / 2) FROM events) AND (k = 1 OR hash IS DISTINCT FROM earlier)""",
    "state_import": f"""WITH {_ITEMS}, {_STATE} SELECT external_id, note_id, created_at, last_pushed_state FROM sync_state
UNION ALL SELECT 'error: malformed', NULL, '', '' UNION ALL SELECT 'error: missing', NULL, '', ''""",
    "action_log": f"""WITH tasks AS ({ORACLE['reconcile_actions']}), days AS ({ORACLE['calendar_actions']})
SELECT 'tasks' AS run, action, external_id FROM tasks WHERE action <> 'unchanged' UNION ALL SELECT 'calendar', action, external_id FROM days""",
    "answer_cycle": f"""WITH {_ITEMS},
first AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) <= 2000 AND NOT ends_with(title, '13') AS known FROM items),
asked AS (
  SELECT id, ordinal, title, CASE WHEN ordinal % 3 = 0 THEN title || ' again' ELSE title END AS prompt, CASE WHEN NOT known THEN 'missing' WHEN ordinal % 3 = 0 THEN 'stale' ELSE 'fresh' END AS memo,
         known AND ordinal % 3 = 0 AND ordinal % 5 < 2 AS waits FROM items JOIN first USING (ordinal)),
sent AS (SELECT *, memo <> 'fresh' AND NOT waits AS asks, row_number() OVER (PARTITION BY memo <> 'fresh' AND NOT waits ORDER BY ordinal) AS n FROM asked),
told AS (
  SELECT *, CASE WHEN memo = 'fresh' THEN 'cached' WHEN waits THEN 'waiting' WHEN n > 3000 THEN 'deferred' WHEN ends_with(prompt, '13') THEN 'failed' ELSE 'answered' END AS outcome FROM sent)
SELECT id, outcome, CASE WHEN outcome = 'answered' THEN '2:' || upper(prompt) WHEN memo <> 'missing' THEN '1:' || upper(title) END AS answer, CASE WHEN outcome = 'failed' THEN 'ValueError: unlucky' END AS error FROM told""",
    "briefed_tasks": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED}, told AS (
  SELECT *, CASE WHEN ordinal % 4 <> 0 THEN 'Do ' || title END AS summary, CASE WHEN ordinal % 4 <> 0 AND ordinal % 700 > 0 THEN ordinal % 700 END AS m FROM items LEFT JOIN handed USING (ordinal)),
timed AS (SELECT *, round(m / 60.0, 1) AS h FROM told),
est AS (SELECT *, CASE WHEN m < 60 THEN concat(m, ' min') ELSE {_short('h')} || ' h' END AS estimate FROM timed)
SELECT id, estimate, md5(concat_ws(chr(10), 'Due: ' || coalesce({_when('due_at')}, 'none'), 'Course: ' || course, {_KIND}, 'Estimate: ~' || estimate, 'Link: ' || url, chr(10) || summary,
       CASE WHEN summary IS NULL THEN chr(10) ELSE concat(chr(10), 'From the teacher:', chr(10)) END || description, chr(10) || 'Attachments:' || chr(10) || shown)) AS description FROM est""",
    "office_files": r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, CASE WHEN strlen(coalesce(text, '')) > 20000 THEN 2 + doc_id % 2 ELSE doc_id % 4 END AS k, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
f AS (
  SELECT *, ['docx', 'pptx', 'txt', 'bin'][CAST(k AS INTEGER) + 1] AS ext, CASE WHEN doc_id % 7 = 0 AND k < 2 THEN array_to_string(lines[1:CAST(len(lines) // 2 AS INTEGER)], ' ') ELSE text END AS body FROM d WHERE k < 2 OR text <> ''),
told AS (
  SELECT *, CASE WHEN k = 3 THEN 'unsupported type' WHEN k = 2 AND strlen(text) > 30000 THEN 'too large' WHEN k = 1 AND len(lines) // CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END = 0 THEN 'cannot be read: ValueError' END AS error FROM f)
SELECT concat(doc_id, '.', ext) AS name, CASE k WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'text' END AS format,
       CASE WHEN error IS NULL THEN md5(trim(regexp_replace(body, '\s+', ' ', 'g'))) END AS text, error, false AS truncated FROM told""",
    "html_text": rf"""WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g') AS h FROM pages),
broken AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<li>', chr(10) || '- ', 'g'), '</?(p|li|ul|nav|div|article|h1|footer)(>| [^>]*>)|<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM bare),
lines AS (SELECT page_id, trim(regexp_replace(t, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS t FROM broken)
SELECT page_id, {_DECODED.format('t')} AS text FROM lines""",
    "html_links": rf"""WITH link AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
         unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) AS k FROM pages),
one AS (SELECT * FROM link QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY k) = 1)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INTEGER) AS position, {_DECODED.format('href')} AS href, {_DECODED.format('label')} AS label, true AS linkable FROM one""",
    "plain_text": rf"""WITH t AS (SELECT doc_id, regexp_replace({_PLAIN}, '^\n+|\n+$', '', 'g') AS clean, strlen(text) AS size FROM documents)
SELECT concat('doc', doc_id, ['.txt', '.csv', '.md'][CAST(doc_id % 3 AS INTEGER) + 1]) AS path, 'text' AS format, md5(CASE WHEN strlen(clean) <= 65536 THEN clean ELSE {_cut('left(clean, 65536)', 65536)} END) AS digest,
       strlen(clean) > 65536 OR size > 262144 AS truncated, NULL AS error, true AS cacheable FROM t""",
    "due_texts": """SELECT doc_id, concat('text:', substr(sha256(text), 1, 24)) AS version, strftime(DATE '1998-05-01' + CAST(doc_id % 20 AS INTEGER), '%Y-%m-%d') AS landed_on, md5(text) AS digest
FROM documents WHERE (doc_id % 7 > 0 AND doc_id % 20 IN (4, 9) AND doc_id % 11 >= 4) OR (doc_id % 7 = 0 AND doc_id % 20 = 2)""",
    "zoned_events": f"""WITH {_EVENTS}, e AS (SELECT ordinal, date_trunc('second', start_at) AS s FROM feed_events)
SELECT ordinal AS uid, strftime(CASE ordinal % 3 WHEN 0 THEN timezone('UTC', timezone('America/New_York', s)) WHEN 1 THEN timezone('UTC', timezone('Europe/Paris', date_trunc('day', s) + INTERVAL '1439' MINUTE)) ELSE timezone('UTC', timezone('Europe/Paris', s)) END,
       '%Y-%m-%dT%H:%M:%SZ') AS start_at, ordinal % 3 = 1 AS all_day FROM e""",
}
