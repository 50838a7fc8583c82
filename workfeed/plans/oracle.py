"""DuckDB SQL for the named queries that SQL can express."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from . import bindings as b

_ITEMS = f"items AS ({b.for_duckdb(b.ITEMS)})"
_EVENTS = f"feed_events AS ({b.for_duckdb(b.EVENTS)})"
_LISTING = f"listing AS ({b.for_duckdb(b.LISTING)})"
_STATE = f"sync_state AS ({b.for_duckdb(b.SYNC_STATE)})"
_LINES = f"line AS ({b.for_duckdb(b.ATTACHMENTS)})"

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_DOWN = "CASE WHEN state IN ('submitted', 'graded', 'excused') THEN 'done' WHEN state = 'in_progress' THEN 'in_progress' ELSE 'open' END"


def _norm(t: str) -> str:
    return rf"trim(regexp_replace(lower({t}), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))"


def _words(t: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm(t)}, ' '), lambda w: w <> '' AND (strlen(w) >= 3 OR regexp_matches(w, '[0-9]')) AND w NOT IN ({_STOP})))"


def _cut(s: str, n: int) -> str:
    return f"left({s}, list_max(list_filter(range(0, {n + 1}), lambda k: strlen(left({s}, k)) <= {n})))"


def _pick(values: str, column: str, n: int) -> str:
    return f"list_extract([{values}], CAST({column} % {n} AS INTEGER) + 1)"


def _short(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _when(t: str) -> str:
    return f"strftime({t}, '%a %b %-d %H:%M')"


def _rfc(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"


_FIRST = """planner AS (
  SELECT concat('canvas:', kind, ':', ordinal) AS id, kind, course_id, CASE WHEN ordinal % 5 <> 0 THEN title END AS title, url, due_at, assigned_at, points, state
  FROM items WHERE source = 'canvas' AND ordinal % 3 <> 0),
listed AS (
  SELECT concat('canvas:assignment:', ordinal) AS id, 'assignment' AS kind, course_id, title, url, due_at, CAST(NULL AS TIMESTAMP) AS assigned_at, points, 'not_started' AS state
  FROM items WHERE source = 'canvas' AND ordinal % 2 = 0
    AND concat('canvas:quiz:', ordinal) NOT IN (SELECT id FROM planner) AND concat('canvas:discussion:', ordinal) NOT IN (SELECT id FROM planner))"""

_CODE = _pick("'assignment', 'sub_assignment', 'assessment_request', 'quiz', 'discussion_topic', 'wiki_page', 'announcement', 'other_thing', ''", "ordinal", 9)
_LOOSE = _pick("' Homework', 'EXAM ', 'event', 'note', 'lecture'", "ordinal", 5)
_WORK = _pick("'ASSIGNMENT', 'SHORT_ANSWER_QUESTION', 'MULTIPLE_CHOICE_QUESTION', 'X'", "ordinal", 4)
_FLOW = _pick("'graded', 'submitted', 'pending_review', 'unsubmitted', ''", "ordinal", 5)
_COURSE = _pick("'RETURNED', 'TURNED_IN', 'CREATED', NULL", "ordinal", 4)

_HOMEWORK = f"""homework AS (
  SELECT source, CAST(ordinal AS VARCHAR) AS source_id, course, title, kind, due_at,
         CASE WHEN state = 'graded' THEN 'graded' WHEN late THEN 'late' WHEN due_at < {b.NOW} THEN 'missing' ELSE 'todo' END AS status, points, url, {b.NOW} AS fetched_at
  FROM items)"""

_PLACEHOLDER = "'', 'busy', 'free', 'private', 'unavailable', 'blocked', '(no title)', 'untitled'"

_PAIRS = f"""word AS (SELECT id, unnest({_words('title')}) AS w FROM items),
freq AS (SELECT w, count(*) AS df FROM word GROUP BY w),
rare AS (SELECT greatest(2, count(*) // 20) AS rare FROM items),
mark AS (SELECT w, df, regexp_matches(w, '[0-9]') OR df <= rare AS strong FROM freq, rare),
dated AS (SELECT id, source, course, title, due_at, source = 'gdoc' AS doc, {_norm('title')} AS norm FROM items WHERE due_at IS NOT NULL),
met AS (
  SELECT a.id AS a_id, b.id AS b_id, bool_or(strong) AS strong, count(*) AS n
  FROM dated a JOIN word wa ON a.id = wa.id JOIN mark USING (w) JOIN word wb USING (w) JOIN dated b ON b.id = wb.id
  WHERE b.doc AND a.id <> b.id AND a.due_at BETWEEN b.due_at - INTERVAL '5' DAY AND b.due_at + INTERVAL '5' DAY
    AND (a.doc, a.due_at, a.course, a.title, a.id) < (b.doc, b.due_at, b.course, b.title, b.id)
  GROUP BY 1, 2 HAVING bool_or(strong) OR count(*) >= 2),
ranked AS (
  SELECT substr(sha256(concat_ws(chr(0), a.source, a.norm, strftime(a.due_at, '%Y-%m-%d'), b.source, b.norm, strftime(b.due_at, '%Y-%m-%d'))), 1, 32) AS pair_key,
         a_id, b_id, a.norm = b.norm AND abs(epoch_us(a.due_at) - epoch_us(b.due_at)) < 259200000000 AS obvious,
         row_number() OVER (ORDER BY b.doc, b.due_at, b.course, b.title, b.id, a.doc, a.due_at, a.course, a.title, a.id) AS place
  FROM met JOIN dated a ON a.id = a_id JOIN dated b ON b.id = b_id),
pair AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY place) = 1)"""

_OUTCOMES = f"""{_PAIRS},
asked AS (SELECT *, CASE WHEN substr(pair_key, 2, 1) < '8' THEN substr(pair_key, 1, 1) < '6' END AS same FROM pair),
open_ AS (SELECT pair_key, row_number() OVER (ORDER BY place) AS n FROM asked WHERE NOT obvious AND same IS NULL),
judged AS (
  SELECT a.*, CASE WHEN obvious THEN 'obvious' WHEN same THEN 'cached_same' WHEN NOT same THEN 'cached_different' WHEN n <= 100 THEN 'ask' ELSE 'deferred' END AS outcome,
         CASE WHEN n <= 100 THEN CAST((n - 1) // 20 AS INTEGER) END AS batch
  FROM asked a LEFT JOIN open_ USING (pair_key))"""


_ANSWERED = f"""{_OUTCOMES},
told AS (
  SELECT * REPLACE (CASE WHEN outcome <> 'ask' THEN outcome WHEN substr(pair_key, 3, 1) >= 'c' THEN 'failed' WHEN substr(pair_key, 4, 1) < '8' THEN 'judged_same' ELSE 'judged_different' END AS outcome)
  FROM judged)"""


def _side(name: str, p: str) -> str:
    return (
        f"concat('  {name} (', {p}.source, ' ', {p}.kind, strftime({p}.due_at, ', %a %-d %b %Y'), CASE WHEN {p}.points IS NOT NULL THEN concat(', ', {_short(p + '.points')}, ' pts') ELSE '' END, "
        f"'): ', {p}.title, chr(10), '     course: ', {p}.course, chr(10), CASE WHEN {p}.description IS NOT NULL THEN concat('     says: ', {p}.description, chr(10)) ELSE '' END)"
    )


def _tallies() -> str:
    """The drop's rounds, by the outcomes after this run's answers, counted with the pairs."""
    return _survivors(12, _ANSWERED, "told", "('obvious', 'cached_same', 'judged_same')", """SELECT
  (SELECT count(*) FROM told) AS pairs, (SELECT count(*) FROM told WHERE outcome = 'obvious') AS obvious, (SELECT count(*) FROM told WHERE starts_with(outcome, 'cached')) AS cached,
  (SELECT count(DISTINCT batch) FROM told) AS asked, (SELECT count(*) FROM told WHERE outcome = 'deferred') AS deferred, (SELECT count(*) FROM told WHERE outcome = 'failed') AS failed,
  (SELECT count(*) FROM items WHERE id IN ({falls})) AS duplicates""")


def _survivors(rounds: int = 12, outcomes: str = _OUTCOMES, table: str = "judged", same: str = "('obvious', 'cached_same')", last: str = "SELECT id, source, title, due_at FROM items WHERE id NOT IN ({falls})") -> str:
    """The rounds of the ordered drop written out; more than the longest chain of the data."""
    parts, falls = [f"WITH {_ITEMS},\n{outcomes},\nlink0 AS (SELECT a_id AS a, b_id AS b FROM {table} WHERE outcome IN {same})"], []
    for i in range(rounds):
        parts.append(f"fall{i} AS MATERIALIZED (SELECT DISTINCT b AS id FROM link{i} WHERE a NOT IN (SELECT b FROM link{i}))")
        parts.append(f"link{i + 1} AS MATERIALIZED (SELECT * FROM link{i} WHERE b NOT IN (SELECT id FROM fall{i}) AND a NOT IN (SELECT id FROM fall{i}))")
        falls.append(f"SELECT id FROM fall{i}")
    return ",\n".join(parts) + "\n" + last.format(falls=" UNION ALL ".join(falls))


_MEMO = f"""memo AS (
  SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('v', p_size % 3) END AS version, p_type AS content,
         {b.NOW} - INTERVAL '1' DAY * CAST(p_partkey % 60 AS INTEGER) AS seen_at
  FROM part WHERE p_partkey % 4 <> 0)"""

_ACTIONS = f"""rendered AS (
  SELECT id AS external_id, title, coalesce(description, '') AS description, concat('Progress: ', state, chr(10), 'x-id: ', id) AS notes, {_DOWN} AS state, due_at, url,
         CASE WHEN ordinal % 31 = 0 THEN false WHEN ordinal % 2 = 0 THEN true END AS homework
  FROM items),
keyed AS (
  SELECT external_id AS k, 1 AS prio, id AS note_id FROM listing WHERE external_id <> ''
  UNION ALL SELECT regexp_extract(notes, 'x-id: *(\\S+)$', 1), 2, id FROM listing WHERE notes LIKE '%x-id: %'
  UNION ALL SELECT s.external_id, 3, l.id FROM sync_state s JOIN listing l ON l.id = s.note_id),
best AS (SELECT k, note_id FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY prio, note_id) = 1),
diff AS (
  SELECT r.external_id, r.state AS new_state, r.homework, e.id AS note_id, s.external_id IS NOT NULL AS known, e.id IS NOT NULL AS found, e.external_id AS old_id,
         array_to_string(list_filter([
           CASE WHEN e.title <> r.title THEN 'title' END, CASE WHEN e.description <> r.description THEN 'description' END, CASE WHEN e.notes <> r.notes THEN 'notes' END,
           CASE WHEN e.state NOT IN ('done', 'dropped') AND CASE r.state WHEN 'in_progress' THEN 1 WHEN 'done' THEN 2 ELSE 0 END > CASE e.state WHEN 'in_progress' THEN 1 WHEN 'done' THEN 2 ELSE 0 END THEN 'state' END,
           CASE WHEN e.parent_id IS NULL AND e.due_at IS DISTINCT FROM r.due_at THEN 'due_at' END, CASE WHEN e.url <> r.url THEN 'url' END, CASE WHEN coalesce(e.external_id, '') = '' THEN 'external_id' END], lambda x: x IS NOT NULL), ',') AS fields
  FROM rendered r LEFT JOIN best b ON b.k = r.external_id LEFT JOIN listing e ON e.id = b.note_id LEFT JOIN sync_state s ON s.external_id = r.external_id),
action AS (
  SELECT external_id, note_id, CASE WHEN found THEN CASE WHEN fields <> '' THEN 'update' ELSE 'unchanged' END WHEN known THEN 'declined'
           WHEN new_state = 'done' THEN 'skip_done' WHEN homework IS NOT DISTINCT FROM false THEN 'skip_other' ELSE 'create' END AS action,
         CASE WHEN found THEN fields ELSE '' END AS fields, found AND coalesce(old_id, '') = '' AS migrated
  FROM diff)"""

_ENTRIES = """spans AS (
  SELECT *, CASE WHEN ends_at > due_at THEN ends_at ELSE due_at + INTERVAL '1' HOUR END AS until FROM items WHERE source = 'gcal' AND due_at IS NOT NULL),
entry0 AS (
  SELECT id AS external_id, ordinal, coalesce(nullif(trim(title), ''), 'Event') AS title, 'busy' AS kind, strftime(due_at, '%Y-%m-%d') AS on_date, strftime(due_at, '%H:%M') AS start_time,
         CASE WHEN CAST(until AS DATE) <> CAST(due_at AS DATE) THEN '23:59' ELSE strftime(until, '%H:%M') END AS end_time
  FROM spans),
entry AS (
  SELECT *, substr(sha256(concat_ws(chr(0), title, kind, 'false', start_time, end_time, on_date, '', '')), 1, 32) AS entry_hash, start_time < end_time AS valid FROM entry0)"""

_ATTACHED = """handed AS (
  SELECT ordinal, count(*) AS n, string_agg(name, ', ' ORDER BY position, l_partkey, l_suppkey, l_quantity, l_extendedprice, name) AS names,
         string_agg(concat('- ', name, ' (', url, ')'), chr(10) ORDER BY position, l_partkey, l_suppkey, l_quantity, l_extendedprice, name) AS shown,
         string_agg(CASE WHEN content IS NOT NULL THEN concat(chr(10), '--- Handout: ', name, ' ---', chr(10), content) END, chr(10) ORDER BY position, l_partkey, l_suppkey, l_quantity, l_extendedprice, name) AS texts,
         string_agg(CASE WHEN content IS NULL THEN concat(chr(10), '--- Attachment (no text extracted): ', name, ' ---', chr(10)) ELSE concat(chr(10), '--- Attachment: ', name, ' ---', chr(10), content, chr(10)) END, ''
                    ORDER BY position, l_partkey, l_suppkey, l_quantity, l_extendedprice, name) AS told
  FROM line GROUP BY ordinal)"""

_KIND = f"concat('Kind: ', kind, CASE WHEN points IS NOT NULL THEN concat(' · ', {_short('points')}, ' pts') ELSE '' END)"
_MESSY = "concat(chr(10), replace(text, '. ', concat('. ', chr(9), chr(13), chr(10))), '  ', chr(10), chr(10))"
_LF = rf"regexp_replace({_MESSY}, '\r\n?', chr(10), 'g')"
_RIGHT = rf"regexp_replace({_LF}, '[ \t\v\f]+(\n|$)', '\1', 'g')"

_TREE = "node AS (SELECT id, title, state, CASE WHEN id % 4 <> 0 THEN id - id % 4 END AS parent_id FROM listing)"

#: Whole lines packed greedily into at most 6,144 bytes.
_CHUNKS = r"""WITH RECURSIVE split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, s FROM (
    SELECT doc_id, i, l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS s FROM split, unnest(range(1, len(l) + 1)) AS t(i) WHERE strlen(text) > 6144) WHERE s <> ''),
step AS (
  SELECT doc_id, i, s, 0 AS part, strlen(s) AS size FROM line WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.s, CASE WHEN p.size + strlen(n.s) > 6144 THEN p.part + 1 ELSE p.part END, CASE WHEN p.size + strlen(n.s) > 6144 THEN strlen(n.s) ELSE p.size + strlen(n.s) END
  FROM step p JOIN line n ON n.doc_id = p.doc_id AND n.i = p.i + 1),
chunk AS (
  SELECT doc_id, part, string_agg(s, '' ORDER BY i) AS s FROM step GROUP BY doc_id, part
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE strlen(text) <= 6144)"""

ORACLES: dict[str, str] = {
    "doc_chunks": f"{_CHUNKS} SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(strlen(s) AS BIGINT) AS n_bytes, md5(s) AS digest FROM chunk",
    "dedup_survivors": _survivors(),
    "unified_table": f"WITH {_ITEMS} SELECT id, source, kind, course, course_id, title, url, assigned_at, due_at, points, state, {_DOWN} AS downstream FROM items",
    "full_outer_merge": f"""WITH {_ITEMS}, {_FIRST}
SELECT coalesce(a.id, b.id) AS id, coalesce(a.kind, b.kind) AS kind, coalesce(a.course_id, b.course_id) AS course_id, coalesce(a.title, b.title) AS title, coalesce(a.url, b.url) AS url,
       coalesce(a.due_at, b.due_at) AS due_at, coalesce(a.assigned_at, b.assigned_at) AS assigned_at, coalesce(a.points, b.points) AS points, coalesce(a.state, b.state) AS state
FROM planner a FULL JOIN listed b ON a.id = b.id""",
    "window_filter": f"""WITH {_ITEMS} SELECT id, due_at, assigned_at FROM items
WHERE CASE WHEN due_at IS NOT NULL THEN due_at BETWEEN {b.NOW} - INTERVAL '30' DAY AND {b.NOW} + INTERVAL '120' DAY
           ELSE assigned_at IS NULL OR assigned_at >= {b.NOW} - INTERVAL '30' DAY END""",
    "overlay_detail": f"""WITH {_ITEMS} SELECT id, kind, CASE WHEN ordinal % 4 = 0 THEN upper(title) ELSE title END AS title, CASE WHEN ordinal % 2 = 0 THEN concat(url, '/detail') ELSE url END AS url,
       CASE WHEN ordinal % 2 = 0 THEN coalesce(due_at, assigned_at + INTERVAL '20' DAY) ELSE due_at END AS due_at, CASE WHEN ordinal % 2 = 0 THEN coalesce(points, 5.0) ELSE points END AS points,
       CASE WHEN ordinal % 2 = 0 AND kind IN ('assignment', 'quiz') THEN assigned_at + INTERVAL '1' DAY ELSE assigned_at END AS assigned_at FROM items""",
    "kind_map": f"""WITH {_ITEMS}, x AS (SELECT id, {_CODE} AS c, lower(trim({_LOOSE})) AS l, {_WORK} AS w FROM items)
SELECT id, CASE WHEN c IN ('assignment', 'sub_assignment', 'assessment_request') THEN 'assignment' WHEN c = 'quiz' THEN 'quiz' WHEN c = 'discussion_topic' THEN 'discussion' WHEN c = 'wiki_page' THEN 'material'
         WHEN c = 'announcement' THEN 'announcement' ELSE 'other' END AS kind,
       CASE WHEN c IN ('assignment', 'sub_assignment', 'assessment_request') THEN 'assignment' WHEN c = 'discussion_topic' THEN 'discussion' WHEN c = 'wiki_page' THEN 'page' WHEN c = '' THEN 'item' ELSE c END AS namespace,
       CASE WHEN l = 'homework' THEN 'assignment' WHEN l = 'exam' THEN 'quiz' WHEN l IN ('event', 'note') THEN 'announcement' ELSE 'material' END AS loose,
       CASE w WHEN 'ASSIGNMENT' THEN 'assignment' WHEN 'X' THEN 'other' ELSE 'question' END AS work,
       CASE c WHEN 'discussion_topic' THEN 'discussion' WHEN 'wiki_page' THEN 'page' ELSE c END AS legacy, CASE WHEN w IN ('ASSIGNMENT', 'X') THEN 'assignment' ELSE 'question' END AS legacy_work FROM x""",
    "state_map": f"""WITH {_ITEMS}, x AS (SELECT *, {_FLOW} AS f, {_COURSE} AS c, coalesce(due_at < {b.NOW}, false) AS past FROM items),
y AS (SELECT *, CASE WHEN ordinal % 11 = 0 THEN 'excused' WHEN f = 'graded' THEN 'graded' WHEN f IN ('submitted', 'pending_review') THEN 'submitted' WHEN ordinal % 7 = 0 THEN 'missing'
                     WHEN submitted_at IS NOT NULL THEN 'submitted' WHEN f = '' AND past THEN 'missing' ELSE 'not_started' END AS submission FROM x)
SELECT id, submission, CASE WHEN ordinal % 11 = 0 THEN 'excused' WHEN ordinal % 7 = 0 THEN 'graded' WHEN ordinal % 5 = 0 THEN 'submitted' WHEN ordinal % 3 = 0 THEN 'missing' ELSE 'not_started' END AS planner,
       CASE WHEN c = 'RETURNED' AND ordinal % 7 = 0 THEN 'graded' WHEN c IN ('RETURNED', 'TURNED_IN') THEN 'submitted' WHEN c IS NOT NULL AND ordinal % 5 = 0 THEN 'in_progress' WHEN past THEN 'missing' ELSE 'not_started' END AS coursework,
       CASE WHEN submission IN ('submitted', 'graded', 'excused') THEN 'done' ELSE 'open' END AS downstream, CASE WHEN submission IN ('submitted', 'graded', 'excused') THEN 2 ELSE 0 END AS rank FROM y""",
    "legacy_status": f"""WITH {_ITEMS}, x AS (SELECT *, {_COURSE} AS c FROM items)
SELECT id, CASE WHEN ordinal % 11 = 0 THEN 'excused' WHEN ordinal % 7 = 0 THEN 'graded' WHEN ordinal % 10 = 0 THEN 'late' WHEN ordinal % 5 = 0 THEN 'submitted' WHEN ordinal % 3 = 0 THEN 'missing' ELSE 'todo' END AS planner,
       CASE WHEN c IS NULL THEN 'todo' WHEN c = 'RETURNED' THEN CASE WHEN ordinal % 7 = 0 THEN 'graded' ELSE 'submitted' END WHEN c = 'TURNED_IN' THEN CASE WHEN ordinal % 2 = 0 THEN 'late' ELSE 'submitted' END
            WHEN due_at < {b.NOW} THEN 'missing' ELSE 'todo' END AS coursework FROM x""",
    "todo_view": f"WITH {_ITEMS}, {_HOMEWORK} SELECT * EXCLUDE (fetched_at) FROM homework WHERE status IN ('todo', 'missing', 'late')",
    "pressing_items": f"""WITH {_ITEMS}, {_LISTING} SELECT id, title, state, due_at, state IN ('open', 'in_progress') AND coalesce(due_at < {b.NOW} + INTERVAL '48' HOUR, false) AS pressing FROM listing""",
    "legacy_homework": f"WITH {_ITEMS}, {_HOMEWORK} SELECT * FROM homework",
    "upsert_homework": f"""WITH {_ITEMS}, {_HOMEWORK} SELECT * REPLACE (CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN 'submitted' ELSE status END AS status,
  CASE WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN fetched_at + INTERVAL '1' DAY ELSE fetched_at END AS fetched_at) FROM homework""",
    "submission_latest": f"""WITH {_ITEMS},
grades AS (SELECT l_orderkey, l_quantity AS grade FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_quantity DESC) = 1),
ins AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS turned, max(l_shipdate) AS updated FROM lineitem GROUP BY 1)
SELECT id, g.grade, coalesce(turned, CASE WHEN state IN ('graded', 'in_progress') THEN updated END) AS turned_in_at,
       CASE WHEN points > 0 THEN {_short("g.grade")} || '/' || {_short("points")} ELSE {_short("g.grade")} END AS grade_text
FROM items LEFT JOIN grades g ON g.l_orderkey = ordinal LEFT JOIN ins i ON i.l_orderkey = ordinal""",
    "event_occurrences": f"""WITH {_EVENTS},
kept AS (
  SELECT *, CASE WHEN series_id IS NOT NULL THEN series_id || ':' || strftime(start_at, '%Y%m%d') WHEN event_id IS NOT NULL THEN event_id
              ELSE lower(regexp_replace(trim(summary), '\\s+', '-', 'g')) || ':' || strftime(start_at, '%Y%m%d') END AS key
  FROM feed_events WHERE status <> 'cancelled' AND NOT declined AND start_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'),
named AS (SELECT *, concat('gcal:', split_part(feed, '@', 1), ':', regexp_replace(regexp_replace(key, '[^A-Za-z0-9:_@.-]', '-', 'g'), '^-+|-+$', '', 'g')) AS id FROM kept)
SELECT id, 'gcal' AS source, 'announcement' AS kind, label AS course, feed AS course_id,
       CASE WHEN lower(trim(summary)) IN ({_PLACEHOLDER}) THEN coalesce(label, CASE WHEN trim(summary) = '' THEN '(untitled event)' ELSE trim(summary) END) ELSE trim(summary) END AS title,
       url, start_at AS due_at, CASE WHEN end_at > start_at THEN end_at END AS ends_at, ordinal
FROM named QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1""",
    "event_cap": f"""WITH {_EVENTS} SELECT feed, ordinal, start_at, CASE WHEN row_number() OVER (PARTITION BY feed ORDER BY start_at, ordinal) <= 50 THEN 'act' ELSE 'deferred' END AS act FROM feed_events""",
    "calendar_fields": f"WITH {_ITEMS}, {_ENTRIES} SELECT * EXCLUDE (ordinal) FROM entry",
    "ics_events": f"""WITH {_EVENTS} SELECT feed, ordinal AS uid, concat(summary, ', with a folded line') AS summary, 'Club' AS label, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, strftime(end_at, '%Y-%m-%d %H:%M:%S') AS end_at FROM feed_events""",
    "title_norm": f"SELECT doc_id, md5({_norm('text')}) AS norm, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line FROM documents",
    "title_words": f"SELECT doc_id, unnest({_words('text')}) AS word FROM documents",
    "slug_ids": rf"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS j FROM documents)
SELECT doc_id, coalesce(nullif(regexp_replace({_cut('j', 40)}, '^-+|-+$', '', 'g'), ''), 'row') AS slug FROM s""",
    "byte_clip": f"""WITH t AS (SELECT doc_id, text, left(text, 110) AS h FROM documents)
SELECT doc_id, CASE WHEN strlen(text) <= 101 THEN text ELSE {_cut('h', 101)} END AS cut, CASE WHEN strlen(text) <= 101 THEN text ELSE {_cut('h', 98)} || '…' END AS counted,
       CASE WHEN strlen(text) <= 101 THEN text ELSE trim({_cut('h', 101)}) || '…' END AS beyond, CASE WHEN length(text) <= 60 THEN text ELSE trim(left(text, 59)) || '…' END AS chars,
       CASE WHEN length(text) <= 60 THEN text ELSE left(text, 60) || '…' END AS chars_beyond FROM t""",
    "clean_text": rf"""SELECT doc_id, md5(regexp_replace({_RIGHT}, '^\n+|\n+$', '', 'g')) AS clean,
       md5(regexp_replace(regexp_replace({_RIGHT}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS tidy FROM documents""",
    "strip_images": """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN concat(text, chr(10), '![x]((image)) end', chr(10), 'last') ELSE text END) AS stripped FROM documents""",
    "announcement_titles": r"""WITH l AS (SELECT conv_id, turn, trim(split_part(trim(regexp_replace(text, '^\s+', '')), chr(10), 1)) AS line FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN line = '' THEN 'Announcement' WHEN length(line) <= 80 THEN line ELSE trim(left(line, 79)) || '…' END AS title FROM l""",
    "mime_class": f"""WITH {_LINES}, m AS (SELECT name, CAST(position % 6 AS INTEGER) AS k, regexp_extract(name, '\\.([a-z]+)$', 1) AS ext FROM line)
SELECT DISTINCT name, coalesce(list_extract([NULL, 'Text/Plain; charset=utf-8', 'application/pdf', 'application/ld+json', 'image/png', 'application/x-yaml'], k + 1), '') AS mime,
       CASE WHEN k IN (1, 3, 5) THEN 'text' WHEN k = 2 THEN 'pdf' WHEN ext = 'txt' THEN 'text' ELSE ext END AS format FROM m""",
    "file_links": f"""WITH {_LINES} SELECT ordinal, position, url, l.l_partkey AS file_id, p.p_name, CASE WHEN p.p_name IS NULL THEN 'not found' WHEN p.p_size > 40 THEN 'too large' END AS error
FROM line l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON p.p_partkey = l.l_partkey""",
    "json_polymorphic": """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_id % 2 = 0 END AS excused, CASE WHEN event_id % 3 = 1 THEN true END AS missing, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "answers_parsed": "SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN concat('p', doc_id) END AS id, CASE WHEN doc_id % 3 <> 2 THEN quality = 1 END AS same FROM labels",
    "brief_validated": """SELECT doc_id, quality = 1 AS homework, CASE WHEN quality <> 1 THEN 'lecture' END AS skip_reason, CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Item ', doc_id) END AS summary,
       CASE WHEN doc_id % 2 = 0 THEN 'a; b; c' ELSE 'only one' END AS steps, CAST(CASE WHEN doc_id + 1 BETWEEN 1 AND 10080 THEN doc_id + 1 END AS INTEGER) AS estimate_min, doc_id % 5 <> 0 AS valid FROM labels""",
    "doc_freq": f"WITH {_ITEMS}, word AS (SELECT unnest({_words('title')}) AS word FROM items) SELECT word, count(*) AS df FROM word GROUP BY word",
    "rare_tokens": f"""WITH {_ITEMS}, word AS (SELECT unnest({_words('title')}) AS word FROM items), freq AS (SELECT word, count(*) AS df FROM word GROUP BY word)
SELECT word, df, regexp_matches(word, '[0-9]') OR df <= (SELECT greatest(2, count(*) // 20) FROM items) AS strong FROM freq""",
    "candidate_pairs": f"WITH {_ITEMS},\n{_PAIRS} SELECT pair_key, a_id, b_id, obvious FROM pair",
    "pair_batches": f"WITH {_ITEMS},\n{_OUTCOMES} SELECT pair_key, outcome, batch FROM judged",
    "judged_answers": f"WITH {_ITEMS},\n{_ANSWERED} SELECT pair_key, outcome, batch FROM told",
    "run_tallies": _tallies(),
    "pair_prompts": f"""WITH {_ITEMS},\n{_OUTCOMES}, shown AS (
  SELECT batch, place, concat(chr(10), 'Pair ', pair_key, ':', chr(10), {_side('A', 'a')}, {_side('B', 'b')}) AS s
  FROM judged JOIN items a ON a.id = a_id JOIN items b ON b.id = b_id WHERE outcome = 'ask')
SELECT batch, md5('Are these the same piece of work?' || chr(10) || string_agg(s, '' ORDER BY place)) AS prompt FROM shown GROUP BY batch""",
    "memo_split": f"""WITH {_MEMO}, w AS (SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('v', p_size % 2) END AS version FROM part)
SELECT w.key, w.version, m.key IS NOT NULL AS hit, m.content FROM w LEFT JOIN memo m ON m.key = w.key AND m.version = w.version AND w.version <> ''""",
    "memo_prune": f"""WITH {_MEMO}, t AS (
  SELECT key, CASE WHEN p_partkey % 9 = 1 THEN 'new' ELSE version END AS version, CASE WHEN p_partkey % 9 = 1 OR p_partkey % 5 = 0 THEN {b.NOW} ELSE seen_at END AS seen_at FROM memo)
SELECT * FROM t WHERE seen_at >= {b.NOW} - INTERVAL '30' DAY""",
    "memo_stale": f"""WITH {_ITEMS} SELECT id, CASE WHEN ordinal % 3 = 0 THEN 'missing' WHEN ordinal % 2 = 0 THEN 'fresh' ELSE 'stale' END AS memo, CASE WHEN ordinal % 3 <> 0 THEN 'answer ' || id END AS answer,
       sha256(concat_ws('|', title, kind)) AS input_hash FROM items""",
    "reconcile_actions": f"WITH {_ITEMS}, {_LISTING}, {_STATE}, {_ACTIONS} SELECT external_id, action, migrated, note_id FROM action",
    "reconcile_diff": f"WITH {_ITEMS}, {_LISTING}, {_STATE}, {_ACTIONS} SELECT external_id, fields FROM action WHERE action = 'update'",
    "reconcile_tally": f"WITH {_ITEMS}, {_LISTING}, {_STATE}, {_ACTIONS} SELECT action, count(*) AS n, count(*) FILTER (migrated) AS n_migrated FROM action GROUP BY action",
    "brief_budget": f"""WITH {_ITEMS}, x AS (SELECT id, due_at, ordinal % 7 <> 0 AND state NOT IN ('submitted', 'graded', 'excused') AND ordinal % 2 <> 0 AS wants FROM items),
y AS (SELECT id, row_number() OVER (ORDER BY due_at NULLS LAST, id) AS n FROM x WHERE wants)
SELECT id, CASE WHEN n <= 20 THEN 'send' WHEN n IS NOT NULL THEN 'deferred' ELSE 'skip' END AS action FROM x LEFT JOIN y USING (id)""",
    "inbox_actions": f"""WITH {_ITEMS} SELECT id, CASE WHEN source = 'gcal' AND due_at IS NOT NULL THEN 'calendar' WHEN kind IN ('material', 'announcement') AND ordinal % 5 <> 0 THEN 'inbox' ELSE 'task' END AS route,
       CASE WHEN ordinal % 4 < 2 THEN CASE WHEN ordinal % 3 = 0 THEN 'task' ELSE 'remembered' END WHEN ordinal % 4 = 2 THEN 'rejected' ELSE 'retry' END AS outcome,
       NOT coalesce(bool_or(ordinal % 997 = 0) OVER (PARTITION BY course_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS attempted FROM items""",
    "calendar_actions": f"""WITH {_ITEMS}, {_ENTRIES},
known AS (SELECT external_id, CASE WHEN ordinal % 3 = 0 THEN 'old' ELSE entry_hash END AS hash, ordinal % 11 = 0 AS declined, ordinal % 13 <> 0 AS there FROM entry WHERE ordinal % 5 <> 0),
both_ AS (SELECT coalesce(e.external_id, k.external_id) AS id, e.on_date, e.start_time, e.entry_hash, k.hash, k.declined, coalesce(k.there, false) AS there, e.external_id IS NOT NULL AS live, k.external_id IS NOT NULL AS known
          FROM (SELECT * FROM entry WHERE ordinal % 17 <> 0 AND valid) e FULL JOIN known k ON k.external_id = e.external_id),
base AS (SELECT *, CASE WHEN live AND known AND (declined OR NOT there) THEN 'declined' WHEN live AND known AND hash = entry_hash THEN 'unchanged' WHEN live THEN 'write' WHEN declined THEN 'keep' WHEN there THEN 'withdraw' ELSE 'forget' END AS base FROM both_)
SELECT id AS external_id, CASE WHEN base = 'write' AND row_number() OVER (PARTITION BY base ORDER BY on_date, start_time, id) > 200 THEN 'deferred' ELSE base END AS action FROM base WHERE base <> 'keep'""",
    "expand_schedules": f"""WITH {_ITEMS}, t AS (
  SELECT id, kind, ordinal, concat(title, CASE WHEN ordinal % 3 = 0 THEN ' Calendar' ELSE '' END) AS title, ordinal % 7 = 0 AS configured,
         strlen(repeat(coalesce(description, ''), 10)) + CASE WHEN description IS NOT NULL THEN 2 ELSE 0 END + strlen(course) AS size
  FROM items WHERE source IN ('canvas', 'classroom')),
u AS (SELECT *, kind IN ('material', 'announcement') AND contains(lower(title), 'calendar') AS named FROM t),
v AS (SELECT *, named AND size >= 200 AND ordinal % 2 = 0 AS opened FROM u WHERE NOT (named AND size >= 200 AND configured))
SELECT id, kind, title, CAST(NULL AS VARCHAR) AS due_at FROM v WHERE NOT opened
UNION ALL SELECT concat('gdoc:', id, ':', DATE '1998-06-01' + CAST(ordinal % 200 AS INTEGER), '-read-', ordinal), 'assignment', concat('Read ', ordinal), concat(DATE '1998-06-01' + CAST(ordinal % 200 AS INTEGER), ' 08:30') FROM v WHERE opened""",
    "attachment_rollup": f"WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id, coalesce(n, 0) AS attachment_count, coalesce(names, '') AS attachment_names FROM items LEFT JOIN handed USING (ordinal)",
    "csv_export": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id, source, kind, coalesce(course, '') AS course, title, url, coalesce({_rfc('assigned_at')}, '') AS assigned_at, coalesce({_rfc('due_at')}, '') AS due_at,
       coalesce({_short('points')}, '') AS points, state, coalesce(grade, '') AS grade, coalesce({_rfc('submitted_at')}, '') AS submitted_at, late, coalesce(n, 0) AS attachment_count,
       coalesce(names, '') AS attachment_names, coalesce(description, '') AS description FROM items LEFT JOIN handed USING (ordinal)""",
    "render_notes": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id AS external_id, course || ' — ' || title AS title,
       md5(concat_ws(chr(10), 'Due: ' || coalesce({_when('due_at')}, 'none'), 'Course: ' || course, {_KIND}, 'Link: ' || url, chr(10) || description, chr(10) || 'Attachments:' || chr(10) || shown)) AS description,
       md5(concat_ws(chr(10), concat_ws(', ', 'Progress: ' || state, 'grade ' || grade, 'submitted ' || {_when('submitted_at')}, CASE WHEN late THEN 'late' END), texts) || chr(10) || 'x-id: ' || id) AS notes, {_DOWN} AS state
FROM items LEFT JOIN handed USING (ordinal)""",
    "task_context": f"""WITH {_ITEMS}, {_LINES}, {_ATTACHED} SELECT id,
       md5(concat_ws(chr(10), 'Course: ' || course, {_KIND}, 'Title: ' || title, coalesce('Description:' || chr(10) || description, 'Description: (none)')) || chr(10) || coalesce(told, '')) AS context
FROM items LEFT JOIN handed USING (ordinal)""",
    "tree_rebuild": f"""WITH {_ITEMS}, {_LISTING}, {_TREE} SELECT t.id, t.title, count(c.id) AS n, string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.id) AS children
FROM node t LEFT JOIN node c ON c.parent_id = t.id WHERE t.parent_id IS NULL GROUP BY t.id, t.title""",
    "tree_flatten": f"WITH {_ITEMS}, {_LISTING}, {_TREE} SELECT * FROM node WHERE parent_id IS NULL OR parent_id IN (SELECT id FROM node)",
    "stream_upsert": "SELECT CAST(user_id AS VARCHAR) AS id, event_type AS hash, event_id AS n, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "stream_changed_only": """SELECT CAST(user_id AS VARCHAR) AS id, event_type AS hash, event_id AS n FROM events
QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)""",
}
