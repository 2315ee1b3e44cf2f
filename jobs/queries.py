"""The jobs as queries over the driver tables, with the SQL for their rows.

Each runs its job twice into one new folder of the shared checkpoint folder, and gives the output as it stands then; the files stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import region_report, text_intake
from punctaria.operators.storage import shared_folder


def _new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _new_folder(spark, "region_report")
    for _ in range(2):
        region_report.run(spark, f"{sf_dir}/events.parquet", out)
    return region_report.report(spark, out)


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _new_folder(spark, "text_intake")
    for _ in range(2):  # a pattern, as the table may be one file or a folder of files
        text_intake.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/checkpoint")
    return text_intake.items(spark, f"{folder}/out").drop("batch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_region_report, job2_text_intake)}

_JOB1 = """
WITH RECURSIVE points AS (SELECT coalesce(nullif(event_type, ''), 'none') AS channel, event_id AS pid, value AS x, CAST(user_id AS DOUBLE) * 3.2e0 AS y FROM events),
cells AS (SELECT *, floor(x / 4e0) AS cx, floor(y / 4e0) AS cy FROM points),
near AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
pairs AS (
  SELECT p.channel, p.pid AS p, q.pid AS q FROM (SELECT cells.*, cx + dx AS nx, cy + dy AS ny FROM cells, near) p
  JOIN cells q ON q.channel = p.channel AND q.cx = p.nx AND q.cy = p.ny AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 16e0
),
core AS (SELECT channel, p AS pid FROM pairs GROUP BY channel, p HAVING count(*) >= 8),
links AS (SELECT channel, p, q FROM pairs SEMI JOIN core a ON a.pid = p AND a.channel = pairs.channel SEMI JOIN core b ON b.pid = q AND b.channel = pairs.channel),
reach(channel, pid, seen) AS (SELECT channel, pid, pid FROM core UNION SELECT l.channel, l.q, r.seen FROM reach r JOIN links l ON l.channel = r.channel AND l.p = r.pid AND r.seen < l.q),
reps AS (SELECT channel, pid, min(seen) AS rep FROM reach GROUP BY channel, pid),
border AS (SELECT pairs.channel, p AS pid, min(rep) AS rep FROM pairs JOIN reps ON reps.channel = pairs.channel AND reps.pid = q GROUP BY pairs.channel, p),
labelled AS (SELECT channel, pid, x, y, coalesce(reps.rep, border.rep) AS rep FROM points LEFT JOIN reps USING (channel, pid) LEFT JOIN border USING (channel, pid)),
placed AS (SELECT channel, CAST(floor(x / 48e0) AS INTEGER) AS rx, CAST(floor(y / 48e0) AS INTEGER) AS ry, rep FROM labelled),
sizes AS (SELECT channel, rx, ry, rep, count(*) AS n FROM placed WHERE rep IS NOT NULL GROUP BY ALL),
clusters AS (SELECT channel, rx, ry, count(*) AS clusters, median(n) AS median_points FROM sizes GROUP BY ALL),
counts AS (SELECT channel, rx, ry, count(*) AS points, count(rep) AS clustered FROM placed GROUP BY ALL)
SELECT channel, rx, ry, 2304e0 AS area, points, clustered, CAST(clustered AS DOUBLE) / points AS clustered_share, coalesce(clusters, 0) AS clusters,
  points / 2304e0 AS points_per_area, coalesce(clusters, 0) / 2304e0 AS clusters_per_area, median_points
FROM counts LEFT JOIN clusters USING (channel, rx, ry)
"""

_JOB2 = r"""
SELECT doc_id AS id, coalesce(nullif(lang, ''), 'none') AS class, coalesce(nullif(source, ''), 'none') AS source, CAST(length(CAST(coalesce(length(text), 0) AS VARCHAR)) AS INTEGER) AS size,
  coalesce(length(text), 0) AS n_chars, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_full_match(l, '([ \t\r,;]+)?[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?([ \t\r,;]+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)*([ \t\r,;]+)?'))) AS n_data_lines,
  len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n,;]+'), lambda t: regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?'))) AS n_numbers
FROM documents
"""

SQL: dict[str, str] = {"job1_region_report": _JOB1, "job2_text_intake": _JOB2}
