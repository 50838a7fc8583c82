"""The driver's tables in the roles of feeds, downstream stores and memos.

Each binding is SQL that Spark and DuckDB read alike; table names stand in braces,
which Spark fills with DataFrames and the oracle with its views. NOW is fixed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '1998-06-01 00:00:00'"

#: Orders with their first line's part: work items of four sources.
ITEMS = """
SELECT o.o_orderkey AS ordinal,
       concat(src, ':', CAST(o.o_orderkey AS STRING)) AS id, src AS source,
       CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'assignment' WHEN '2' THEN 'quiz' WHEN '3' THEN 'discussion' WHEN '4' THEN 'material' ELSE 'announcement' END AS kind,
       c.c_mktsegment AS course, CAST(c.c_custkey AS STRING) AS course_id,
       concat(coalesce(p.p_name, 'item'), ' ', CAST(coalesce(p.p_partkey, o.o_orderkey) AS STRING)) AS title,
       concat('https://lms.example/', src, '/', CAST(o.o_orderkey AS STRING)) AS url,
       o.o_orderdate - INTERVAL '7' DAY AS assigned_at,
       CASE WHEN o.o_orderkey % 10 <> 0 THEN o.o_orderdate + INTERVAL '17' HOUR END AS due_at,
       CASE WHEN o.o_orderkey % 20 = 3 THEN o.o_orderdate + INTERVAL '26' HOUR WHEN o.o_orderkey % 4 = 3 THEN o.o_orderdate + INTERVAL '18' HOUR END AS ends_at,
       CASE WHEN o.o_orderkey % 3 <> 0 THEN floor(o.o_totalprice / 1000) / 2 END AS points,
       CASE o.o_orderstatus WHEN 'F' THEN 'graded' WHEN 'P' THEN 'in_progress' ELSE 'not_started' END AS state,
       CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + INTERVAL '1' DAY END AS submitted_at,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_orderkey % 100 AS STRING) END AS grade,
       o.o_orderkey % 6 = 0 AS late,
       CASE WHEN o.o_orderkey % 9 <> 0 THEN concat('Read about ', coalesce(p.p_type, 'this'), '.') END AS description
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'canvas' WHEN 1 THEN 'classroom' WHEN 2 THEN 'gdoc' ELSE 'gcal' END AS src FROM {orders}) o
LEFT JOIN (SELECT l_orderkey, min(CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey) % 1000000000000 AS first_part FROM {lineitem} GROUP BY l_orderkey) f
  ON o.o_orderkey = f.l_orderkey
LEFT JOIN {part} p ON p.p_partkey = f.first_part
LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

#: What a line's attachment is called, where it is and what it says; {} stands before the names of the line's columns.
FILE = {
    "name": "concat('part-', CAST({0}l_partkey AS STRING), CASE {0}l_returnflag WHEN 'A' THEN '.pdf' WHEN 'N' THEN '.docx' ELSE '.txt' END)",
    "url": "concat('https://files.example/files/', CAST({0}l_partkey AS STRING), '/download?v=', CAST({0}l_suppkey AS STRING))",
    "content": "CASE WHEN {0}l_returnflag = 'R' THEN concat('Quantity ', CAST(CAST({0}l_quantity AS BIGINT) AS STRING), ' of part ', CAST({0}l_partkey AS STRING)) END",
}

#: Lines: the attachments of the orders. (l_orderkey, l_linenumber) is not unique.
ATTACHMENTS = """
SELECT l_orderkey AS ordinal, CAST(l_linenumber AS BIGINT) AS position, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       %s AS name,
       %s AS url,
       %s AS content
FROM {lineitem}
""" % tuple(x.format("") for x in FILE.values())  # noqa: UP031

#: What the downstream store holds, from an earlier run of the same rule.
LISTING = """
SELECT ordinal AS id, CASE WHEN ordinal % 13 = 0 THEN '' ELSE id END AS external_id,
       CASE WHEN ordinal % 11 = 0 THEN concat(title, ' (old)') ELSE title END AS title,
       coalesce(description, '') AS description,
       CASE WHEN ordinal % 26 = 0 THEN 'free text' ELSE concat('Progress: ', state, chr(10), 'x-id: ', id) END AS notes,
       CASE WHEN ordinal % 17 = 0 THEN 'dropped' WHEN state = 'graded' AND ordinal % 2 = 0 THEN 'done' ELSE 'open' END AS state,
       CASE WHEN ordinal % 19 = 0 THEN due_at + INTERVAL '1' DAY ELSE due_at END AS due_at, url,
       CASE WHEN ordinal % 23 = 0 THEN ordinal - 1 END AS parent_id
FROM ({items}) i WHERE ordinal % 7 <> 0
"""

#: What the last run remembered.
SYNC_STATE = """
SELECT id AS external_id, ordinal AS note_id, '1998-05-01T00:00:00Z' AS created_at, 'open' AS last_pushed_state, '' AS hash
FROM ({items}) i WHERE ordinal % 5 <> 0
"""

#: Events as a calendar feed per user.
EVENTS = """
SELECT concat('user', CAST(user_id AS STRING), '@feeds.example') AS feed, CASE WHEN user_id % 3 <> 0 THEN concat('Club ', CAST(user_id AS STRING)) END AS label,
       event_id AS ordinal, CASE WHEN event_id % 6 <> 0 THEN concat('ev-', CAST(event_id % 5000 AS STRING)) END AS event_id,
       CASE WHEN event_id % 8 = 0 THEN concat('series ', CAST(event_id % 40 AS STRING)) END AS series_id,
       CASE event_type WHEN 'view' THEN 'Busy' WHEN 'click' THEN '' ELSE concat(event_type, ' ', CAST(event_id % 50 AS STRING)) END AS summary,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status,
       event_id % 9 = 0 AS declined, ts AS start_at, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL '90' MINUTE END AS end_at,
       concat('https://cal.example/', CAST(event_id AS STRING)) AS url
FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def nested(sql: str) -> str:
    """A binding with the bindings it uses written out."""
    return sql.replace("{items}", ITEMS)


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", nested(sql))


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The binding over the tables of sf_dir."""
    text = nested(sql)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)
