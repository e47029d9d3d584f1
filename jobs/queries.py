"""The jobs as queries: each runs twice into a new folder, and its whole output is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wavemark.sources.shared import fresh_path

from . import recording_intake, session_protocols
from .command import default_config


def job1_recording_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with the report of its day and channel."""
    folder = fresh_path(spark, "job1")
    config = default_config(recording_intake.__file__)
    for _ in range(2):
        paths = recording_intake.run(spark, events=f"{sf_dir}/events.parquet", output=f"{folder}/tables", checkpoint=f"{folder}/checkpoint", config=config)
    samples, report = recording_intake.read(spark, paths)
    both = samples.join(report.withColumn("mean", F.round("mean", 6)), ["day", "channel"], "full")
    return both.withColumn("day", F.col("day").cast("string"))


def job2_session_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "job2")
    config = default_config(session_protocols.__file__)
    for _ in range(2):
        paths = session_protocols.run(spark, conversations=f"{sf_dir}/conversations.parquet", output=folder, config=config)
    return session_protocols.read(spark, paths)


QUERIES = {"job1_recording_intake": job1_recording_intake, "job2_session_protocols": job2_session_protocols}
ORACLE_SQL = {
    "job1_recording_intake": """
WITH typed AS (SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS channel, epoch_us(ts) AS time_us, value, CAST(ts AS DATE) AS day FROM events),
firsts AS (SELECT *, row_number() OVER (PARTITION BY day, event_id ORDER BY channel, time_us, value NULLS FIRST) AS k FROM typed WHERE event_id IS NOT NULL AND time_us IS NOT NULL AND channel IS NOT NULL),
stepped AS (SELECT event_id, channel, time_us, value, day, time_us - lag(time_us) OVER (PARTITION BY day, channel ORDER BY time_us, event_id) AS step_us FROM firsts WHERE k = 1),
samples AS (SELECT *, CASE WHEN step_us IS NULL THEN 'first' WHEN step_us = 0 THEN 'repeated' WHEN step_us > 1800000000 THEN 'gap' ELSE 'ok' END AS kind FROM stepped),
report AS (SELECT day, channel, count(*) AS n, count_if(value IS NULL OR NOT isfinite(value)) AS missing, count_if(kind = 'repeated') AS repeated_times, count_if(kind = 'gap') AS long_gaps, max(step_us) AS longest_gap_us,
 min(value) FILTER (WHERE isfinite(value)) AS low, max(value) FILTER (WHERE isfinite(value)) AS high, round(avg(value) FILTER (WHERE isfinite(value)), 6) AS mean, min(time_us) AS first_us, max(time_us) AS last_us FROM samples GROUP BY day, channel)
SELECT CAST(day AS VARCHAR) AS day, channel, event_id, time_us, value, step_us, kind, n, missing, repeated_times, long_gaps, longest_gap_us, low, high, mean, first_us, last_us FROM samples JOIN report USING (day, channel)
""",
    "job2_session_protocols": r"""
WITH noted AS (SELECT conv_id AS session, turn AS seq, role, trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS note FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
one AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY role NULLS FIRST, note) AS k FROM noted),
dated AS (SELECT session, seq, 'n' || session || '.' || seq AS marker_id, CASE role WHEN 'system' THEN 'led_on' WHEN 'user' THEN 'action_start' WHEN 'assistant' THEN 'action_end' END AS kind, note,
 coalesce(sum(length(note)) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 15.0::DOUBLE AS time_sec FROM one WHERE k = 1),
sound AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS number FROM dated WHERE kind IS NOT NULL),
islands AS (SELECT *, sum(CASE WHEN kind = 'action_start' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS island FROM sound WHERE kind LIKE 'action%'),
starts AS (SELECT session, island, marker_id AS sid, time_sec AS s FROM islands WHERE kind = 'action_start'),
pairs AS (SELECT i.session, sid, arg_min(marker_id, seq) AS eid, arg_min(time_sec, seq) - any_value(s) AS duration_sec FROM islands i JOIN starts t ON i.session = t.session AND i.island = t.island WHERE kind = 'action_end' AND time_sec > s GROUP BY i.session, sid),
partners AS (SELECT session, sid AS marker_id, eid AS partner_id, duration_sec FROM pairs UNION ALL SELECT session, eid, sid, duration_sec FROM pairs),
before AS (SELECT *, lag(kind) OVER p AS k, lag(time_sec) OVER p AS t, lag(number) OVER p AS n FROM sound WINDOW p AS (PARTITION BY session, substr(kind, 1, 3) ORDER BY seq)),
bad AS (SELECT session, number, marker_id, CASE WHEN k IS NULL OR k = 'action_end' THEN kind || ' has no start' WHEN time_sec <= t THEN kind || ' isn''t after #' || n END AS problem FROM before WHERE kind = 'action_end'),
problems AS (SELECT session, arg_min(marker_id, number) AS marker_id, arg_min(problem, number) AS problem FROM bad WHERE problem IS NOT NULL GROUP BY session),
clocked AS (SELECT *, CAST(round_even(time_sec * 1000, 0) AS BIGINT) AS ms FROM dated)
SELECT session, seq, marker_id, kind, time_sec, printf('%02d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) AS clock, note, CASE WHEN kind IS NULL THEN 'kind' END AS broken, partner_id, duration_sec, problem, CAST(floor(session / 1000) AS BIGINT) AS part
FROM clocked LEFT JOIN partners USING (session, marker_id) LEFT JOIN problems USING (session, marker_id)
""",
}
