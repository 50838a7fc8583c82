"""DuckDB SQL for the queries of landed.py."""

from __future__ import annotations

from ..operators.reconcile import COUNTERS
from . import bindings as b
from .oracle import _ACTIONS, _ATTACHED, _CHUNKS, _DOWN, _ENTRIES, _EVENTS, _ITEMS, _KIND, _LINES, _LISTING, _MEMO, _PLACEHOLDER, _STATE, _cut, _pick, _rfc, _short, _when

BASE = "https://lms.example"
_CODE = _pick("'assignment', 'sub_assignment', 'assessment_request', 'quiz', 'discussion_topic', 'wiki_page', 'announcement', 'planner_note', 'other_thing'", "ordinal", 9)
_PART = """CASE WHEN code = 'quiz' THEN '/quizzes/' WHEN code IN ('discussion_topic', 'announcement') THEN '/discussion_topics/' WHEN code = 'wiki_page' THEN '/pages/'
  WHEN code IN ('assignment', 'sub_assignment', 'assessment_request') THEN '/assignments/' END"""

_PLANNER = f"""plan0 AS (
  SELECT *, {_CODE} AS code, ordinal // 4 AS m, CASE WHEN ordinal % 50 <> 0 THEN CAST(course_id AS BIGINT) END AS cid,
         CASE WHEN ordinal % 3 = 1 THEN concat('/courses/', course_id, '/x/', ordinal) WHEN ordinal % 3 = 2 THEN url ELSE '' END AS href
  FROM items WHERE source = 'canvas'),
plan AS (
  SELECT *, m % 4 <> 0 AND ordinal % 7 = 0 AS excused, m % 4 <> 0 AND ordinal % 3 = 0 AS submitted, m % 4 <> 0 AND m % 2 = 0 AS missing, CASE WHEN starts_with(href, '/') THEN '{BASE}' || href ELSE href END AS link,
         CASE WHEN ordinal % 5 <> 0 THEN title ELSE concat('Named ', ordinal) END AS shown
  FROM plan0),
stub AS (
  SELECT concat('canvas:', CASE WHEN code IN ('assignment', 'sub_assignment', 'assessment_request') THEN 'assignment' WHEN code = 'discussion_topic' THEN 'discussion' WHEN code = 'wiki_page' THEN 'page' ELSE code END, ':', ordinal) AS id,
         CASE WHEN code IN ('assignment', 'sub_assignment', 'assessment_request') THEN 'assignment' WHEN code = 'quiz' THEN 'quiz' WHEN code = 'discussion_topic' THEN 'discussion' WHEN code = 'wiki_page' THEN 'material'
              WHEN code = 'announcement' THEN 'announcement' ELSE 'other' END AS kind, cid, shown,
         CASE WHEN link <> '' THEN link ELSE coalesce(concat('{BASE}/courses/', coalesce(cid, 0)) || ({_PART}) || ordinal, concat('{BASE}/courses/', coalesce(cid, 0))) END AS url,
         coalesce(due_at, CASE WHEN ordinal % 20 = 0 THEN date_trunc('day', assigned_at) END) AS due, assigned_at, points,
         CASE WHEN excused THEN 'excused' WHEN submitted THEN 'submitted' WHEN missing THEN 'missing' ELSE 'not_started' END AS state
  FROM plan WHERE code <> 'planner_note' AND ordinal <> 0)"""

_FIRST_LINE = """first_line AS (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""

_WORK = f"""work0 AS (
  SELECT *, ordinal // 4 AS m, {_pick("'PUBLISHED', 'PUBLISHED', 'DRAFT', 'PUBLISHED'", '(ordinal // 4)', 4)} AS published,
         date_trunc('day', due_at) + CASE WHEN ordinal % 11 = 0 THEN INTERVAL '31' DAY ELSE INTERVAL '0' DAY END
           + CASE WHEN (ordinal // 4) % 2 = 1 THEN to_minutes(CAST(hour(due_at) * 60 + 30 AS BIGINT)) ELSE INTERVAL '0' DAY END AS due,
         CASE WHEN ordinal % 6 = 1 THEN assigned_at + INTERVAL '2' DAY ELSE assigned_at END AS assigned
  FROM items WHERE source = 'classroom'),
{_FIRST_LINE},
work AS (
  SELECT w.*, l_orderkey IS NOT NULL AS handed, CASE l_returnflag WHEN 'A' THEN 'RETURNED' WHEN 'R' THEN 'TURNED_IN' WHEN 'N' THEN 'CREATED' END AS hand_state, l_returnflag, l_quantity, l_partkey, l_shipdate, l_linestatus
  FROM work0 w LEFT JOIN first_line f ON f.l_orderkey = w.ordinal)"""

_CONTEXT = f"concat_ws(chr(10), 'Course: ' || course, {_KIND}, concat('Posted: ', strftime(assigned_at, '%a %b %-d %Y %H:%M'), ' UTC'), 'Title: ' || title, coalesce('Description:' || chr(10) || description, 'Description: (none)')) || chr(10) || coalesce(told, '')"
_DESCRIPTION = f"concat_ws(chr(10), 'Due: ' || coalesce({_when('due_at')}, 'none'), 'Course: ' || course, {_KIND}, 'Link: ' || url, chr(10) || description, chr(10) || 'Attachments:' || chr(10) || shown)"
_PROGRESS = f"concat_ws(', ', 'Progress: ' || state, 'grade ' || grade, 'submitted ' || {_when('submitted_at')}, CASE WHEN late THEN 'late' END)"
_HASH = f"sha256(concat_ws('|', title, coalesce(description, ''), concat('Progress: ', state, chr(10), 'x-id: ', id), {_DOWN}, coalesce({_rfc('due_at')}, ''), url))"
_ORDER = "position, l_partkey, l_suppkey, l_quantity, l_extendedprice, name"

_CALENDAR = f"""{_ENTRIES},
known AS (SELECT external_id, CASE WHEN ordinal % 3 = 0 THEN 'old' ELSE entry_hash END AS hash, ordinal % 11 = 0 AS declined, ordinal % 13 <> 0 AS there FROM entry WHERE ordinal % 5 <> 0),
both_ AS (SELECT coalesce(e.external_id, k.external_id) AS id, e.on_date, e.start_time, e.entry_hash, k.hash, k.declined, coalesce(k.there, false) AS there, e.external_id IS NOT NULL AS live, k.external_id IS NOT NULL AS known
          FROM (SELECT * FROM entry WHERE ordinal % 17 <> 0 AND valid) e FULL JOIN known k ON k.external_id = e.external_id)"""


def _calendar(there: str) -> str:
    return f"""day_base AS (
  SELECT *, CASE WHEN live AND known AND (declined OR NOT {there}) THEN 'declined' WHEN live AND known AND hash = entry_hash THEN 'unchanged' WHEN live THEN 'write' WHEN declined THEN 'keep' WHEN {there} THEN 'withdraw' ELSE 'forget' END AS base
  FROM both_),
day_action AS (SELECT id AS external_id, CASE WHEN base = 'write' AND row_number() OVER (PARTITION BY base ORDER BY on_date, start_time, id) > 200 THEN 'deferred' ELSE base END AS action FROM day_base WHERE base <> 'keep')"""


_SENT = """is_task AS (SELECT external_id FROM listing WHERE external_id <> '' UNION SELECT external_id FROM sync_state WHERE note_id % 3 = 0),
call AS (
  SELECT id, ordinal, 1 AS prio, ordinal % 5 = 0 AS promote, ordinal % 4 = 0 AS same FROM items
  WHERE kind IN ('material', 'announcement') AND NOT (source = 'gcal' AND due_at IS NOT NULL) AND id NOT IN (SELECT external_id FROM is_task)
  UNION ALL SELECT concat('brief:', id), ordinal, 2, false, false FROM items WHERE state = 'not_started' AND ordinal % 9 = 0),
sent AS (
  SELECT *, CASE WHEN promote THEN 'promote' WHEN same THEN 'unchanged' WHEN row_number() OVER (PARTITION BY NOT promote AND NOT same ORDER BY prio, ordinal) <= 100 THEN 'send' ELSE 'deferred' END AS action FROM call)"""

_COUNTERS = ", ".join(f"('{part}', '{o}', '{c}')" for part, table in COUNTERS.items() for o, c in table.items()) + ", ('task', 'migrated', 'migrated')"

_SCHEDULE = """t AS (
  SELECT id, kind, ordinal, concat(title, CASE WHEN ordinal % 3 = 0 THEN ' Calendar' ELSE '' END) AS title, ordinal % 7 = 0 AS configured,
         strlen(repeat(coalesce(description, ''), 10)) + CASE WHEN description IS NOT NULL THEN 2 ELSE 0 END + strlen(course) AS size
  FROM items WHERE source IN ('canvas', 'classroom')),
u AS (SELECT *, size >= 200 AS long_ FROM t WHERE kind IN ('material', 'announcement') AND contains(lower(title), 'calendar'))"""

_ASKED = f"""asked AS (
  SELECT id, ordinal, state = 'graded' AS done, CASE WHEN ordinal % 3 = 0 THEN 'missing' WHEN ordinal % 2 = 0 THEN 'fresh' ELSE 'stale' END AS memo, CASE WHEN ordinal % 3 <> 0 THEN 'answer ' || id END AS answer FROM items),
outcome AS (
  SELECT id, answer, CASE WHEN done THEN 'skipped' WHEN memo = 'fresh' THEN 'cached' WHEN row_number() OVER (PARTITION BY NOT done AND memo <> 'fresh' ORDER BY ordinal) > 300 THEN 'deferred'
                          WHEN ordinal % 5 <> 0 THEN 'enriched' ELSE 'failed' END AS outcome FROM asked)"""

_N = "event_id"
ORACLES: dict[str, str] = {
    "planner_feed": f"""WITH {_ITEMS}, {_PLANNER} SELECT id, kind, cid AS course_id, shown AS title, url, {_rfc('due')} AS due_at, {_rfc('assigned_at')} AS assigned_at, points, state,
       coalesce(CASE WHEN c_custkey % 3 = 0 THEN concat('C-', c_custkey) ELSE 'Course ' || c_custkey END, CAST(cid AS VARCHAR)) AS course FROM stub LEFT JOIN customer ON c_custkey = cid""",
    "listing_feed": f"""WITH p AS (SELECT *, p_partkey AS n, TIMESTAMP '1998-01-01 00:00:00' + to_days(CAST(p_partkey % 300 AS INTEGER)) AS made FROM part)
SELECT concat('canvas:assignment:', n) AS id, 'assignment' AS kind, CAST(p_size AS BIGINT) AS course_id, CASE WHEN n % 6 <> 0 THEN p_name END AS title, concat('{BASE}/a/', n) AS url, CASE WHEN n % 4 <> 0 THEN {_rfc('made')} END AS due_at,
       {_rfc('made')} AS assigned_at, p_retailprice AS points, 'not_started' AS state, CASE WHEN n % 9 = 0 THEN n END AS quiz_id, CASE WHEN n % 10 = 0 THEN n END AS topic_id
FROM p WHERE n % 4 = 0 OR made >= TIMESTAMP '1998-06-01 00:00:00'""",
    "classroom_feed": f"""WITH {_ITEMS}, {_WORK}
SELECT concat('classroom:', course_id, ':', ordinal) AS id, {_pick("'assignment', 'question', 'question', 'other'", "m", 4)} AS kind, course_id, title, url, {_rfc('due')} AS due_at, {_rfc('assigned')} AS assigned_at, CASE WHEN points > 0 THEN points END AS points,
       CASE WHEN hand_state = 'RETURNED' THEN 'graded' WHEN hand_state = 'TURNED_IN' THEN 'submitted' WHEN due < {b.NOW} THEN 'missing' ELSE 'not_started' END AS state,
       CASE WHEN hand_state = 'RETURNED' THEN CASE WHEN points > 0 THEN {_short('l_quantity')} || '/' || {_short('points')} ELSE {_short('l_quantity')} END END AS grade, {_rfc('l_shipdate')} AS turned_in_at,
       coalesce(l_linestatus = 'O', false) AS late, concat(url, CASE WHEN l_returnflag <> 'N' THEN concat(' u/', l_partkey) ELSE '' END) AS urls
FROM work WHERE kind NOT IN ('material', 'announcement') AND published = 'PUBLISHED'
UNION ALL SELECT concat('classroom:', course_id, ':', kind, ':', ordinal), kind, course_id, CASE WHEN kind = 'announcement' THEN 'First line of ' || title ELSE title END, url, NULL, {_rfc('assigned')}, NULL, NULL, NULL, NULL, false, url
FROM work WHERE kind IN ('material', 'announcement') AND published = 'PUBLISHED'""",
    "legacy_feed": f"""WITH {_ITEMS}, {_PLANNER}, {_WORK}
SELECT 'canvas' AS source, concat(code, ':', ordinal) AS source_id, coalesce(concat('C-', c_custkey), 'Context ' || course) AS course, shown AS title,
       CASE code WHEN 'discussion_topic' THEN 'discussion' WHEN 'wiki_page' THEN 'page' WHEN 'planner_note' THEN 'note' ELSE code END AS kind, {_rfc('due_at')} AS due_at,
       CASE WHEN excused THEN 'excused' WHEN submitted THEN 'submitted' WHEN missing THEN 'missing' ELSE 'todo' END AS status, points, nullif(link, '') AS url, '1998-06-01T00:00:00Z' AS fetched_at
FROM plan LEFT JOIN (SELECT c_custkey FROM customer) c ON c_custkey = cid WHERE cid IS NOT NULL
UNION ALL SELECT 'canvas', concat(code, ':', ordinal), 'Context ' || course, shown, CASE code WHEN 'discussion_topic' THEN 'discussion' WHEN 'wiki_page' THEN 'page' WHEN 'planner_note' THEN 'note' ELSE code END, {_rfc('due_at')},
       CASE WHEN excused THEN 'excused' WHEN submitted THEN 'submitted' WHEN missing THEN 'missing' ELSE 'todo' END, points, nullif(link, ''), '1998-06-01T00:00:00Z' FROM plan WHERE cid IS NULL
UNION ALL SELECT 'classroom', concat(course_id, ':', ordinal), concat('C-', course_id), title, {_pick("'assignment', 'question', 'question', 'assignment'", "m", 4)}, {_rfc('due')},
       CASE WHEN NOT handed THEN 'todo' WHEN hand_state = 'RETURNED' THEN 'submitted' WHEN hand_state = 'TURNED_IN' THEN CASE WHEN l_linestatus = 'O' THEN 'late' ELSE 'submitted' END WHEN due < {b.NOW} THEN 'missing' ELSE 'todo' END,
       coalesce(points, 0.0), url, '1998-06-01T00:00:00Z' FROM work WHERE kind NOT IN ('material', 'announcement')""",
    "feed_counts": f"""WITH {_ITEMS}, {_PLANNER}, {_WORK}, rows_ AS (
  SELECT 'canvas' AS source, kind, due, 0 AS files FROM stub
  UNION ALL SELECT 'classroom', {_pick("'assignment', 'question', 'question', 'other'", "m", 4)}, due, 1 FROM work WHERE kind NOT IN ('material', 'announcement') AND published = 'PUBLISHED')
SELECT source, kind, count(*) AS n, count(due) AS n_dated, CAST(sum(files) AS BIGINT) AS n_files FROM rows_ GROUP BY source, kind""",
    "calendar_feed": f"""WITH {_EVENTS}, e AS (
  SELECT * REPLACE (CASE WHEN ordinal % 7 = 0 THEN date_trunc('day', start_at) + INTERVAL '1439' MINUTE ELSE date_trunc('second', start_at) END AS start_at,
                    CASE WHEN ordinal % 7 = 0 THEN date_trunc('day', end_at) + INTERVAL '1439' MINUTE ELSE date_trunc('second', end_at) END AS end_at) FROM feed_events),
kept AS (
  SELECT *, CASE WHEN series_id IS NOT NULL THEN series_id || ':' || strftime(start_at, '%Y%m%d') WHEN event_id IS NOT NULL THEN event_id
              ELSE lower(regexp_replace(trim(summary), '\\s+', '-', 'g')) || ':' || strftime(start_at, '%Y%m%d') END AS key
  FROM e WHERE status <> 'cancelled' AND NOT declined AND start_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'),
named AS (SELECT *, concat('gcal:', split_part(feed, '@', 1), ':', regexp_replace(regexp_replace(key, '[^A-Za-z0-9:_@.-]', '-', 'g'), '^-+|-+$', '', 'g')) AS id FROM kept)
SELECT id, CASE WHEN lower(trim(summary)) IN ({_PLACEHOLDER}) THEN coalesce(label, CASE WHEN trim(summary) = '' THEN '(untitled event)' ELSE trim(summary) END) ELSE trim(summary) END AS title,
       label AS course, {_rfc('start_at')} AS due_at, CASE WHEN end_at > start_at THEN {_rfc('end_at')} END AS ends_at, url
FROM named QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1""",
    "whole_documents": f"""SELECT concat('gdoc:', doc_id, ':1998-06-01-read-on') AS id, 'quiz' AS kind, 'Read on' AS title, '1998-06-01T23:59:00Z' AS due_at, CAST(NULL AS VARCHAR) AS said FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT concat('gdoc:', doc_id), 'material', CASE WHEN doc_id % 2 = 0 THEN concat('Doc ', doc_id) ELSE 'Course calendar' END, NULL,
  md5('Course calendar document, not broken into rows.' || chr(10) || chr(10) || CASE WHEN strlen(trim(text)) <= 6000 THEN trim(text) ELSE trim({_cut('left(trim(text), 6000)', 6000)}) || '…' END || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '[cut off at the extraction size limit]' ELSE '' END) FROM documents WHERE doc_id % 3 <> 0""",
    "json_export": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id, source, kind, course, title, {_rfc('due_at')} AS due_at, points, state, grade, coalesce(n, 0) AS n_files FROM items LEFT JOIN handed USING (ordinal)""",
    "schedule_texts": f"""{_CHUNKS}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts, {b.NOW} + to_days(CAST(doc_id % 30 AS INTEGER)) AS today FROM chunk JOIN documents USING (doc_id))
SELECT doc_id, CAST(part AS INTEGER) AS part, md5(s) AS chunk, md5(concat('Course: ', source, chr(10), 'Document: Doc ', doc_id, chr(10), 'Today: ', strftime(today, '%Y-%m-%d (%A)'), chr(10),
         CASE WHEN parts > 1 THEN concat('This is part ', part + 1, ' of ', parts, ' of the document.', chr(10)) ELSE '' END,
         CASE WHEN doc_id % 5 = 0 THEN 'The document was cut off at a size limit; parse what is here.' || chr(10) ELSE '' END,
         chr(10), 'Calendar document:', chr(10), '---', chr(10), CASE WHEN s = '' THEN '' ELSE '*' END, chr(10), '---', chr(10))) AS prompt,
       concat(CASE WHEN doc_id % 2 = 0 THEN concat('Read ', source, chr(10), chr(10)) ELSE '' END, 'From ', CASE WHEN doc_id % 3 = 0 THEN source ELSE 'the course calendar' END, ', row dated ', strftime(today, '%a %-d %b %Y'), '.') AS said FROM c""",
    "instants": f"""SELECT event_id, CASE WHEN {_N} % 5 IN (0, 2) THEN {_rfc('ts')} END AS strict, CASE WHEN {_N} % 5 IN (0, 2) THEN {_rfc('ts')} WHEN {_N} % 5 = 1 THEN {_rfc("date_trunc('day', ts)")} END AS lenient, {_N} % 5 IN (0, 2) AS same,
       CAST(list_extract([129600, 604800, 5400, 1209600, 30, NULL, NULL], CAST({_N} % 7 AS INTEGER) + 1) AS BIGINT) AS seconds, CAST(list_extract([12, -3, 0, 0, 0, 0], CAST({_N} % 6 AS INTEGER) + 1) AS BIGINT) AS whole,
       ts >= TIMESTAMP '2024-01-05 00:00:00' AS inside, NOT ({_N} % 3 = 0 OR epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts) < 432000000000) AS reread,
       CASE WHEN {_N} % 13 > 0 AND {_N} % 33 > 0 THEN {_rfc(f"CAST(make_date(2024 - {_N} % 2, {_N} % 13, 1) AS TIMESTAMP) + to_days(CAST({_N} % 33 - 1 AS INTEGER)) + to_minutes(CAST({_N} % 26 * 60 + {_N} % 70 AS BIGINT))")} END AS parts FROM events""",
    "references": f"""WITH p AS (SELECT *, p_partkey AS n, concat('id', p_partkey) AS i, CAST(p_partkey % 12 AS INTEGER) AS k, {_CODE.replace('ordinal', 'p_partkey')} AS code FROM part)
SELECT p_partkey, list_extract([i, 'https://d.example/document/d/' || i || '/edit?x=1', 'https://d.example/open?a=1&id=' || i || '#p', 'https://d.example/file/d/' || i, 'https://d.example/none/' || i, '',
         'http://c.example/ical/' || i || '%40g.example/public/basic.ics', 'https://c.example/caldav/v2/' || i || '/events/', 'https://c.example/embed?src=' || i || '%40g.example&x', 'https://c.example/' || i || '@h/events',
         'HTTP://c.example/a.ICS', 'http://c.example/a.ICS?k=b.txt'], k + 1) AS ref,
       CASE WHEN k IN (0, 1, 2, 3) THEN i END AS document, CASE WHEN k IN (0, 7) THEN i WHEN k IN (6, 8) THEN i || '@g.example' WHEN k = 9 THEN i || '@h' END AS calendar, k IN (6, 11) AS feed,
       list_extract(['{BASE}/x', 'http://h/y', 'z', ''], CAST(n % 4 AS INTEGER) + 1) AS absolute,
       coalesce(concat('{BASE}/courses/', p_size) || ({_PART}) || n, concat('{BASE}/courses/', p_size)) AS page,
       CASE WHEN n % 3 = 0 THEN 'a.pdf' WHEN n % 2 = 0 THEN 'b.txt' ELSE concat('file-', n) END AS name, CASE WHEN n % 3 <> 0 THEN concat('1998-01-01||', p_size, '|10|20') ELSE '' END AS version,
       concat(n % 2, '|', CASE WHEN n % 3 <> 0 THEN '1998-01-01' ELSE '' END, '|sum|5|6') AS drive_version, CASE WHEN n % 2 = 1 THEN 'N' WHEN n % 3 = 1 THEN 'S' ELSE i END AS course FROM p""",
    "plain_bodies": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(concat(' ', chr(13), chr(10), replace(text, '. ', '.' || chr(13)), chr(13), chr(10), ' ', chr(9)), '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM documents""",
    "list_answers": """SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN doc_id END AS id, CASE WHEN doc_id % 3 <> 2 THEN concat('t', doc_id) END AS title, CASE WHEN doc_id % 3 <> 2 THEN true END AS quiet FROM labels
UNION ALL SELECT doc_id, 0, NULL, NULL FROM labels WHERE doc_id % 3 <> 2""",
    "inbox_texts": f"WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id, md5({_CONTEXT}) AS told FROM items LEFT JOIN handed USING (ordinal)",
    "event_texts": f"""WITH {_EVENTS} SELECT ordinal, concat(strftime(start_at, '%a %-d %b %Y'), CASE WHEN ordinal % 7 = 0 THEN ' (all day)' ELSE concat(strftime(start_at, ' %H:%M'), coalesce(strftime(end_at, '–%H:%M'), '')) END,
       CASE WHEN ordinal % 3 = 0 THEN concat(' · Room ', ordinal) ELSE '' END, chr(10), CASE WHEN ordinal % 5 <> 0 AND trim(summary) <> '' THEN trim(summary) || chr(10) ELSE '' END, 'From the ', coalesce(label, 'shared'), ' calendar.') AS said FROM feed_events""",
    "state_after": f"""WITH {_ITEMS}, {_LISTING}, {_STATE}, {_ACTIONS}, done AS (
  SELECT a.external_id, a.note_id, '1998-06-01T00:00:00Z' AS created_at, {_DOWN} AS last_pushed_state, {_HASH} AS hash FROM action a JOIN items i ON i.id = a.external_id WHERE action IN ('create', 'update', 'unchanged'))
SELECT *, false AS dry FROM done UNION ALL SELECT *, false FROM sync_state WHERE external_id NOT IN (SELECT external_id FROM done) UNION ALL SELECT *, true FROM sync_state""",
    "owned_elsewhere": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id AS external_id, '' AS description, md5({_DESCRIPTION} || chr(10) || chr(10) || {_PROGRESS} || chr(10) || 'x-id: ' || id) AS notes, CAST(64 AS BIGINT) AS n_hash
FROM items LEFT JOIN handed USING (ordinal)""",
    "content_hashes": f"WITH {_ITEMS} SELECT id AS external_id, {_HASH} AS content_hash FROM items",
    "handed_notes": rf"""WITH {_ITEMS}, {_LINES}, {_ATTACHED}, mine AS (
  SELECT ordinal, string_agg(concat('- ', name, ' (', url, ')', chr(10)), '' ORDER BY {_ORDER}) AS lines, string_agg(concat(chr(10), '--- Your file: ', name, ' ---', chr(10), content), chr(10) ORDER BY {_ORDER}) AS own
  FROM line WHERE content IS NOT NULL GROUP BY ordinal)
SELECT id, md5(regexp_replace(concat_ws(chr(10), {_PROGRESS}, CASE WHEN ordinal % 2 = 0 THEN concat('Submitted text:', chr(10), 'My ', title, chr(10)) END, 'Submitted files:' || chr(10) || lines, own, texts), '\n+$', '') || chr(10) || 'x-id: ' || id) AS notes
FROM items LEFT JOIN handed USING (ordinal) LEFT JOIN mine USING (ordinal)""",
    "calendar_blind": f"WITH {_ITEMS}, {_CALENDAR}, {_calendar('known')} SELECT * FROM day_action",
    "calendar_needed": f"""WITH {_ITEMS}, {_CALENDAR} SELECT (SELECT coalesce(bool_or(source = 'gcal' AND due_at IS NOT NULL), false) FROM items) AS any_event, (SELECT count(*) > 0 FROM known) AS any_remembered,
       (SELECT coalesce(bool_or(source = 'gcal' AND due_at IS NOT NULL), false) FROM items) OR (SELECT count(*) > 0 FROM known) AS reads_calendar""",
    "inbox_budget": f"WITH {_ITEMS}, {_LISTING}, {_STATE}, {_SENT} SELECT id, action FROM sent",
    "run_counters": f"""WITH {_ITEMS}, {_LISTING}, {_STATE}, {_ACTIONS}, {_CALENDAR}, {_calendar('there')}, {_SENT},
told AS (
  SELECT 'task' AS part, action AS outcome FROM action UNION ALL SELECT 'task', 'migrated' FROM action WHERE migrated UNION ALL SELECT 'calendar', action FROM day_action
  UNION ALL SELECT CASE WHEN prio = 2 THEN 'brief' ELSE 'inbox' END, CASE WHEN prio = 2 THEN action WHEN action = 'promote' THEN 'task' WHEN action = 'send' THEN {_pick("'remembered', 'nothing', 'retry'", "ordinal", 3)} ELSE action END FROM sent),
counter(part, outcome, counter) AS (VALUES {_COUNTERS})
SELECT counter, count(t.part) AS n FROM counter LEFT JOIN told t USING (part, outcome) GROUP BY counter""",
    "expansion_tally": f"""WITH {_ITEMS}, {_SCHEDULE} SELECT count(*) AS found, count(*) FILTER (long_ AND NOT configured AND ordinal % 2 = 0) AS expanded, count(*) FILTER (long_ AND NOT configured AND ordinal % 2 = 0) AS rows,
       count(*) FILTER (NOT long_ OR configured) AS skipped, count(*) FILTER (long_ AND NOT configured AND ordinal % 2 <> 0) AS failed FROM u""",
    "memo_counts": f"""WITH {_MEMO}, w AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('v', p_size % 2) END AS version FROM part)
SELECT count(m.key) AS hits, count(*) - count(m.key) AS misses FROM w LEFT JOIN memo m ON m.key = w.key AND m.version = w.version AND w.version <> ''""",
    "answer_outcomes": f"WITH {_ITEMS}, {_ASKED} SELECT id, outcome, answer FROM outcome",
    "answer_tally": f"WITH {_ITEMS}, {_ASKED} SELECT outcome, count(*) AS n FROM outcome GROUP BY outcome",
    "answers_kept": f"""WITH {_ITEMS}, a AS (
  SELECT id, sha256(title) AS input_hash, 'new ' || id AS answer, {b.NOW} AS seen_at FROM items WHERE ordinal % 4 = 0
  UNION ALL SELECT id, sha256(kind), 'old ' || id, {b.NOW} - INTERVAL '1' DAY * CAST(ordinal % 60 AS INTEGER) FROM items WHERE ordinal % 3 <> 0 AND ordinal % 4 <> 0)
SELECT id, input_hash, answer, {_rfc('seen_at')} AS seen_at FROM a WHERE seen_at >= {b.NOW} - INTERVAL '30' DAY""",
    "chosen_sources": f"WITH {_ITEMS} SELECT id, source, due_at FROM items WHERE source IN ('gdoc', 'gcal') AND due_at BETWEEN {b.NOW} - INTERVAL '30' DAY AND {b.NOW} + INTERVAL '120' DAY",
}
