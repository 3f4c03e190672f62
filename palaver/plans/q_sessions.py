"""Registered queries: sessions and other window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.timefmt import local_date
from palaver.operators import sessions as S
from palaver.plans.oracle import date_of, sql
from palaver.plans.registry import query

# The sample events are sparse, so thresholds are sixty times the defaults.
MERGE, GROUP, CAP_GAP, CAP_LEN = 150.0, 5400.0, 720.0, 108_000.0


def sessions_cte(gap_s: float, name: str = "s") -> str:
    return f"""
WITH {name}0 AS (
  SELECT *, lag(end_us) OVER w AS prev_end, lag(speaker) OVER w AS prev_speaker
  FROM v_segments WINDOW w AS (PARTITION BY device_id ORDER BY start_us, segment_id)),
{name}1 AS (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - prev_end > {int(gap_s * 1e6)} THEN 1 ELSE 0 END)
    OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS sid FROM {name}0),
{name} AS (
  SELECT *, first_value(segment_id) OVER w AS first_id,
         row_number() OVER w AS rn
  FROM {name}1 WINDOW w AS (PARTITION BY device_id, sid ORDER BY start_us, segment_id))
"""


UNIT_SQL = """
SELECT device_id, min_by(segment_id, rn) AS unit_id, min(start_us) AS start_us, max_by(end_us, rn) AS end_us,
       count(*) AS merge_count,
       CAST(sum(CASE WHEN rn > 1 AND start_us > prev_end THEN 1 ELSE 0 END) AS BIGINT) AS gaps_merged,
       CAST(sum(CASE WHEN rn > 1 THEN greatest(start_us - prev_end, 0) ELSE 0 END) AS BIGINT) AS total_gap_us,
       CAST(sum(end_us - start_us) AS BIGINT) AS speech_us,
       coalesce(round(sum(end_us - start_us) / nullif(max_by(end_us, rn) - min(start_us), 0), 6), 0.0)::DOUBLE AS speech_ratio,
       round(sum(end_us - start_us) / count(*) / 1e6, 6) AS avg_source_s
FROM s GROUP BY device_id, sid
"""


@query("merge_segments", sql("segments", sessions_cte(MERGE) + UNIT_SQL))
def merge_segments(t):
    u = S.merge_segments(t.segments, max_gap_s=MERGE)
    return u.withColumn("speech_ratio", F.round("speech_ratio", 6)).withColumn(
        "avg_source_s", F.round("avg_source_s", 6)
    )


@query(
    "speech_ratio",
    sql(
        "segments",
        sessions_cte(MERGE)
        + """SELECT unit_id, coalesce(round(speech_ratio, 6), 0.0)::DOUBLE AS speech_ratio FROM (
        SELECT min_by(segment_id, rn) AS unit_id,
               sum(end_us - start_us) / nullif(max_by(end_us, rn) - min(start_us), 0) AS speech_ratio
        FROM s GROUP BY device_id, sid)""",
    ),
)
def speech_ratio(t):
    return S.merge_segments(t.segments, max_gap_s=MERGE).select(
        "unit_id", F.round("speech_ratio", 6).alias("speech_ratio")
    )


LIMIT_US = 240_000_000
SPLIT_SQL = (
    sessions_cte(MERGE)
    + f""", u AS (SELECT device_id, min_by(segment_id, rn) AS unit_id, list({{'s': start_us, 'e': end_us}} ORDER BY rn) AS l FROM s GROUP BY device_id, sid),
r AS (SELECT device_id, unit_id, l FROM u
  UNION ALL
  SELECT device_id, unit_id, CASE WHEN side = 0 THEN l[1:cut] ELSE l[cut + 1:] END FROM (
    SELECT *, list_position(far, list_min(far)) AS cut FROM (
      SELECT *, [abs(2 * l[i].e - l[1].s - l[len(l)].e) FOR i IN range(1, len(l))] AS far FROM r
      WHERE len(l) > 1 AND l[len(l)].e - l[1].s > {LIMIT_US})), (VALUES (0), (1)) AS x(side)),
leaf AS (SELECT device_id, unit_id, l[1].s AS a, l[len(l)].e AS z, CAST(len(l) AS BIGINT) AS merge_count FROM r WHERE len(l) = 1 OR l[len(l)].e - l[1].s <= {LIMIT_US}),
piece AS (SELECT *, unnest(range(0, greatest(CAST(ceil((z - a) / {LIMIT_US}) AS BIGINT), 1))) AS p FROM leaf)
SELECT device_id, unit_id, a + p * {LIMIT_US} AS start_us, least(a + (p + 1) * {LIMIT_US}, z) AS end_us, merge_count FROM piece"""
)


@query("split_units", sql("segments", SPLIT_SQL, recursive=True))
def split_units(t):
    return S.split_units(t.segments, max_gap_s=MERGE, max_unit_s=LIMIT_US / 1e6).drop("part_no")


CONV_SQL = """
SELECT device_id, min_by(segment_id, rn) AS conversation, min(start_us) AS start_us, max_by(end_us, rn) AS end_us,
       count(*) AS n_segments, array_to_string(list_sort(list_distinct(list(speaker))), ',') AS participants,
       array_to_string(list_sort(list_filter(list_distinct(list(language)), lambda x: x <> '')), ',') AS languages,
       CAST(sum(CASE WHEN rn > 1 AND speaker <> prev_speaker THEN 1 ELSE 0 END) AS BIGINT) AS changes,
       avg(CASE WHEN speaker = 'unknown' THEN 1.0 ELSE 0.0 END) AS ratio,
       CAST(sum(end_us - start_us) AS BIGINT) AS speech_us
FROM s GROUP BY device_id, sid
"""


@query(
    "group_conversations",
    sql(
        "segments",
        sessions_cte(GROUP)
        + f"SELECT device_id, conversation, start_us, end_us, n_segments, participants, languages, speech_us FROM ({CONV_SQL})",
    ),
)
def group_conversations(t):
    c = S.group_conversations(t.segments, max_gap_s=GROUP)
    return c.select(
        "device_id",
        "conversation",
        "start_us",
        "end_us",
        "n_segments",
        F.array_join("participants", ",").alias("participants"),
        F.array_join("languages", ",").alias("languages"),
        "speech_us",
    )


@query(
    "speaker_alternations",
    sql(
        "segments",
        sessions_cte(GROUP)
        + f"""SELECT conversation, n_segments, changes, round(changes / n_segments, 6) AS alternation_ratio,
        n_segments >= 3 AND changes / n_segments > 0.5 AS rapid FROM ({CONV_SQL})""",
    ),
)
def speaker_alternations(t):
    c = S.group_conversations(t.segments, max_gap_s=GROUP)
    return c.select(
        "conversation",
        "n_segments",
        "changes",
        F.round(F.col("changes") / F.col("n_segments"), 6).alias("alternation_ratio"),
        "rapid",
    )


@query(
    "media_preflag",
    sql(
        "segments",
        sessions_cte(GROUP)
        + f"""SELECT conversation, round(ratio, 6) AS unknown_ratio,
        CASE WHEN ratio >= 0.7 OR (n_segments >= 3 AND changes / n_segments > 0.5 AND ratio > 0.3)
             OR participants = 'unknown' THEN 'media_or_unknown' ELSE 'live_conversation' END AS source_type
        FROM ({CONV_SQL})""",
    ),
)
def media_preflag(t):
    c = S.group_conversations(t.segments, max_gap_s=GROUP)
    return c.select("conversation", F.round("unknown_ratio", 6).alias("unknown_ratio"), "source_type")


CAPPED_SQL = f"""
WITH r AS (
  SELECT device_id, segment_id, start_us, end_us, date,
         row_number() OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS rn
  FROM v_segments),
f AS (
  SELECT device_id, rn, segment_id, segment_id AS first_id, start_us AS first_us,
         end_us AS max_end, date AS max_date, segment_id AS max_first, start_us AS max_first_us
  FROM r WHERE rn = 1
  UNION ALL
  SELECT device_id, rn, segment_id, first_id, first_us,
         CASE WHEN takes THEN end_us ELSE max_end END, CASE WHEN takes THEN date ELSE max_date END,
         CASE WHEN takes THEN first_id ELSE max_first END, CASE WHEN takes THEN first_us ELSE max_first_us END
  FROM (
    SELECT x.device_id, x.rn, x.segment_id, x.end_us, x.date, f.max_end, f.max_date, f.max_first, f.max_first_us,
           x.end_us >= f.max_end AS takes,
           CASE WHEN joins THEN f.max_first ELSE x.segment_id END AS first_id,
           CASE WHEN joins THEN f.max_first_us ELSE x.start_us END AS first_us
    FROM f JOIN (SELECT * FROM r) x ON x.device_id = f.device_id AND x.rn = f.rn + 1,
    LATERAL (SELECT x.date = f.max_date AND x.start_us - f.max_end BETWEEN 0 AND {int(CAP_GAP * 1e6)}
             AND x.end_us - f.max_first_us <= {int(CAP_LEN / 60 * 1e6)} AS joins))
)
SELECT device_id, segment_id, first_us AS session_start_us, first_id AS session_first FROM f
"""


# The day limit already keeps sample sessions under the scaled cap, so the cap stays at 1800 s.
@query("capped_sessions", sql("segments", CAPPED_SQL, recursive=True))
def capped_sessions(t):
    s = S.capped_sessions(t.segments, max_gap_s=CAP_GAP, max_length_s=CAP_LEN / 60)
    return s.select("device_id", "segment_id", "session_start_us", "session_first")


@query(
    "prev_segment_asof",
    sql(
        "segments",
        """SELECT segment_id, coalesce(max(end_us) OVER w, -1) AS latest_end_us,
        coalesce(lag(end_us) OVER v, -1) AS row_end_us,
        coalesce(start_us - max(end_us) OVER w, -1) AS gap_us
        FROM v_segments WINDOW
        w AS (PARTITION BY device_id ORDER BY start_us, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        v AS (PARTITION BY device_id ORDER BY start_us, segment_id)""",
    ),
)
def prev_segment_asof(t):
    from palaver.operators.ordered import running

    out = running(
        t.segments.select("device_id", "segment_id", "start_us", "end_us"),
        ["device_id"],
        ["start_us", "segment_id"],
        {"latest": ("max", F.col("end_us")), "row_end": ("last", F.col("end_us"))},
    )
    return out.select(
        "segment_id",
        F.coalesce("latest", F.lit(-1)).alias("latest_end_us"),
        F.coalesce("row_end", F.lit(-1)).alias("row_end_us"),
        F.coalesce(F.col("start_us") - F.col("latest"), F.lit(-1)).alias("gap_us"),
    )
