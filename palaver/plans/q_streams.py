"""Registered queries: streams over the sample tables, run once over all that is available.

Windows and sessions come out when the watermark passes their end, so the newest ones stay open;
the SQL applies the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.operators import activity as A
from palaver.plans import views
from palaver.plans.oracle import sql
from palaver.plans.q_sessions import CAP_GAP, CAP_LEN, CAPPED_SQL, GROUP
from palaver.plans.q_sources import BROKEN, NEGATIVE, stage
from palaver.plans.registry import query
from palaver.streaming import flows as W
from palaver.streaming import runtime as R
from palaver.streaming import stateful as Z


def segment_stream(t):
    R.prepare(t.spark)
    return views.segments(R.table_stream(t.spark, t.dir, "events"))


CLOSED = "(SELECT max(start_us) FROM v_segments) // 1000 * 1000 - 600000000"


@query(
    "stage_stream",
    sql("segments", f"SELECT segment_id, CASE WHEN event_id % 2 = 0 THEN 800 ELSE 0 END AS core_start FROM v_segments WHERE NOT ({BROKEN}) AND NOT ({NEGATIVE})"),
)
def stage_stream(t):
    from palaver.sources.files import pending

    out = R.run_append(pending(W.stage_stream(t.spark, stage(t))), "stage")
    return out.select("segment_id", F.col("core_start_samples").cast("int").alias("core_start"))


@query("dedupe_stream", sql("segments", "SELECT segment_id, start_us FROM v_segments"))
def dedupe_stream(t):
    s = segment_stream(t).select("segment_id", "start_us", "event_id")
    twice = s.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    return R.run_append(W.dedupe_stream(twice), "dedupe").select("segment_id", "start_us")


SESS = f"""WITH m AS (SELECT *, max(end_us) OVER (PARTITION BY device_id ORDER BY start_us, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM v_segments),
s AS (SELECT *, sum(CASE WHEN pm IS NULL OR start_us - pm > {int(GROUP * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS sid FROM m)
SELECT device_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM s GROUP BY device_id, sid HAVING max(end_us) + {int(GROUP * 1e6)} <= {CLOSED}"""


@query("session_stream", sql("segments", SESS))
def session_stream(t):
    s = segment_stream(t).select("device_id", "segment_id", "start_us", "end_us")
    return R.run_append(W.session_stream(s, gap_s=GROUP), "sessions")


@query("capped_session_stream", sql("segments", CAPPED_SQL, recursive=True))
def capped_session_stream(t):
    s = segment_stream(t).select("device_id", "segment_id", "start_us", "end_us")
    marks = R.EndMarks(t.spark)
    out = R.run_append(Z.capped_session_stream(marks.join(s), CAP_GAP, CAP_LEN / 60), "capped", marks=marks)
    return out.select("device_id", "segment_id", "session_start_us", "session_first")


#: Whole half-second frames of a segment.
FRAMES = "(end_us - start_us) div 500000"


def energy(i):
    """Energy of frame ``i`` of a segment, made from its ids."""
    return F.pmod(F.col("event_id") * 31 + i * 17, F.lit(101)) / 101.0


def frame_chunks(seg):
    """The frames of each segment as it comes in: one row with an array for each column of ``frame_rows``."""
    chunk = F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr(FRAMES) - 1), energy)
    rows = seg.filter(F.expr(FRAMES) > 0).select(F.col("segment_id").alias("device_id"), "start_us", chunk.alias("energy"))
    return rows.withColumn("speech", F.transform("energy", lambda e: e > 0.05))


def frame_rows(seg):
    """Half-second frames over each segment, with an energy made from its ids."""
    n = F.expr(FRAMES)
    rows = seg.filter(n > 0).select(
        "segment_id", "event_id", "start_us", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("i")
    )
    e = energy(F.col("i"))
    return rows.select(
        F.col("segment_id").alias("device_id"),
        (F.col("start_us") + F.col("i") * 500_000).alias("start_us"),
        e.alias("energy"),
        (e > 0.05).alias("speech"),
    )


# Runs of frames without a jump; in each, the next unit follows from where the one before ended.
UNITS_SQL = """WITH fr AS (
  SELECT segment_id AS device_id, start_us + i * 500000 AS us, ((event_id * 31 + i * 17) % 101) / 101.0 AS e
  FROM v_segments, LATERAL (SELECT unnest(range(0, (end_us - start_us) // 500000)) AS i)),
sp AS (SELECT *, e > 0.05 AS s, us - lag(us) OVER (PARTITION BY device_id ORDER BY us) AS d FROM fr),
rn AS (SELECT *, sum(CASE WHEN d IS NULL OR abs(d - 500000) > 25000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY us) AS run FROM sp),
po AS (SELECT *, row_number() OVER (PARTITION BY device_id, run ORDER BY us) - 1 AS p FROM rn),
ls AS (SELECT *, coalesce(max(CASE WHEN s THEN p END) OVER (PARTITION BY device_id, run ORDER BY p), -1) AS last FROM po),
r AS (SELECT device_id, run, min(us) AS base, count(*) AS n, list(e ORDER BY p) AS e, list(last ORDER BY p) AS last FROM ls GROUP BY ALL),
u AS (
  SELECT device_id, run, 0::BIGINT AS a, 0::BIGINT AS core, false AS unit, 0::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS cx, 0::BIGINT AS cy, false AS done FROM r
  UNION ALL
  SELECT device_id, run, CASE k WHEN 'drop' THEN a + 24 WHEN 'pause' THEN a + len WHEN 'cut' THEN cut - 1 ELSE n END,
    CASE k WHEN 'cut' THEN 1 ELSE 0 END, k IN ('pause', 'cut') OR (k = 'rest' AND n - a > core AND last[n] >= a), a,
    CASE k WHEN 'pause' THEN a + len WHEN 'cut' THEN least(cut + 1, a + 48) ELSE n END, a + core,
    CASE k WHEN 'pause' THEN a + len WHEN 'cut' THEN cut ELSE n END, k = 'rest'
  FROM (SELECT *, CASE WHEN n - a >= 24 AND last[a + 24] < a THEN 'drop' WHEN len IS NOT NULL THEN 'pause' WHEN n - a >= 48 THEN 'cut' ELSE 'rest' END AS k FROM (
    SELECT u.device_id, u.run, u.a, u.core, r.n, r.last,
      list_min([l FOR l IN range(24, least(48, r.n - u.a + 1)) IF l - 1 - (r.last[u.a + l] - u.a) >= 2 AND r.last[u.a + 24] >= u.a]) AS len,
      list_min([struct_pack(e := r.e[u.a + l], c := u.a + l) FOR l IN range(45, 48)]).c AS cut
    FROM u JOIN (SELECT * FROM r) r ON r.device_id = u.device_id AND r.run = u.run WHERE NOT u.done AND u.a < r.n)))
SELECT device_id, base + x * 500000 AS start_us, base + y * 500000 AS end_us, base + cx * 500000 AS core_start_us, base + cy * 500000 AS core_end_us
FROM u JOIN r USING (device_id, run) WHERE unit"""


@query("bounded_units_stream", sql("segments", UNITS_SQL, recursive=True))
def bounded_units_stream(t):
    marks = R.EndMarks(t.spark)
    # One file may come in one split, and a segment makes many frames, so segments are dealt out first.
    seg = segment_stream(t).repartition("segment_id")
    return R.run_append(Z.bounded_units_stream(marks.join(frame_chunks(seg))), "units", marks=marks)


# Requests and answers of an account in one order, folded row by row.
FOLD = """WITH e AS (SELECT account, start_us, 0 AS answers, request_id, billed_seconds AS billed, NULL::INT AS status, NULL::VARCHAR AS header FROM v_usage
  UNION ALL SELECT account, start_us + 2000000, 1, request_id, 0, CASE WHEN request_id % 41 = 0 THEN 401 WHEN request_id % 41 < 5 THEN 429 END,
    CASE request_id % 41 WHEN 1 THEN '900' WHEN 2 THEN '1' WHEN 3 THEN 'soon' END FROM v_usage WHERE request_id % 41 < 6),
q AS (SELECT *, (start_us + 19800000000) // 86400000000 AS dn, row_number() OVER (PARTITION BY account ORDER BY start_us, answers, request_id) AS rn,
  CASE WHEN answers = 0 THEN 0 WHEN status IS NULL THEN 30 WHEN status IN (401, 403) THEN 300 WHEN header IS NULL THEN 30
    WHEN TRY_CAST(header AS DOUBLE) IS NULL THEN 60 ELSE least(86400, greatest(5, TRY_CAST(header AS DOUBLE))) END AS pause FROM e),
f AS (
  SELECT account, 0::BIGINT AS rn, 0::BIGINT AS request_id, '' AS verdict, 0.0::DOUBLE AS retry_after, []::STRUCT(t BIGINT, b DOUBLE, id BIGINT)[] AS recent, 0::BIGINT AS dn, 0::BIGINT AS n, 0.0::DOUBLE AS total, 0::BIGINT AS retry_us
  FROM (SELECT DISTINCT account FROM q)
  UNION ALL
  SELECT account, rn, request_id, verdict, CASE WHEN verdict = 'paced' THEN greatest(1.0, 61 - (now_us - oldest) / 1e6) WHEN verdict = 'cooling' THEN (retry_us - now_us) / 1e6 ELSE 0.0 END,
    CASE WHEN verdict = 'admit' THEN list_append(hr, {'t': now_us, 'b': billed, 'id': request_id}) ELSE hr END, dn,
    n + CASE WHEN verdict = 'admit' THEN 1 ELSE 0 END, total + CASE WHEN verdict = 'admit' THEN billed ELSE 0.0 END,
    CASE WHEN verdict = 'answer' AND len([x FOR x IN hr IF x.id = request_id]) > 0 THEN now_us + CAST(pause * 1000000 AS BIGINT) ELSE retry_us END
  FROM (SELECT *, CASE WHEN answers = 1 THEN 'answer' WHEN retry_us > now_us THEN 'cooling'
        WHEN n + 1 > 2000 * 0.9 OR total + billed > 28800 * 0.9 OR coalesce(list_sum([x.b FOR x IN hr]), 0) + billed > 1500 * 0.9 THEN 'budget'
        WHEN len(mi) + 1 > 2 * 0.9 THEN 'paced' ELSE 'admit' END AS verdict, list_min(mi) AS oldest FROM (
      SELECT *, [x.t FOR x IN hr IF x.t > now_us - 60000000] AS mi FROM (
        SELECT q.account, q.rn, q.request_id, q.answers, q.pause, q.start_us AS now_us, q.billed, q.dn,
          CASE WHEN q.dn = f.dn THEN f.n ELSE 0 END AS n, CASE WHEN q.dn = f.dn THEN f.total ELSE 0.0 END AS total,
          [x FOR x IN f.recent IF x.t > q.start_us - 3600000000] AS hr, f.retry_us
        FROM f JOIN (SELECT * FROM q) q ON q.account = f.account AND q.rn = f.rn + 1))))
SELECT account, request_id, verdict, round(retry_after, 6)::DOUBLE AS retry_after FROM f WHERE rn > 0 AND verdict <> 'answer'"""


def answer_rows(usage):
    """Answers two seconds after some requests: refused, too many requests with several headers, no connection."""
    kind = F.pmod(F.col("request_id"), F.lit(41))
    return usage.where(kind < 6).select(
        "account",
        "request_id",
        (F.col("start_us") + 2_000_000).alias("start_us"),
        F.when(kind == 0, 401).when(kind < 5, 429).when(kind == 5, F.lit(None)).cast("int").alias("status"),
        F.when(kind == 1, "900").when(kind == 2, "1").when(kind == 3, "soon").alias("retry_header"),
    )


@query("quota_stream", sql("usage", FOLD, recursive=True))
def quota_stream(t):
    marks = R.EndMarks(t.spark)
    u = views.usage(segment_stream(t)).select("account", "request_id", "start_us", "audio_seconds")
    verdicts = Z.quota_stream(marks.join(u), answer_rows(u), per_minute=2, hourly_seconds=1500)
    return R.run_append(verdicts, "quota", marks=marks)


@query(
    "daily_rollup_stream",
    sql("segments", "SELECT date, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, count(*) AS segment_count, min(start_us) AS first_us, max_by(end_us, (start_us, segment_id)) AS last_us FROM v_segments GROUP BY date"),
)
def daily_rollup_stream(t):
    path = W.daily_rollup_stream(segment_stream(t))
    return t.spark.read.schema("speech_us bigint, segment_count bigint, first_us bigint, last_us bigint, date string").parquet(path)


# Three batches; the flag of a device comes from the last batch that changed its balance.
BACKLOG_SQL = """WITH m AS (SELECT device_id, event_id % 3 AS b, CAST(coalesce(sum(end_us - start_us) FILTER (processed_us IS NULL), 0) AS BIGINT) AS d,
  count(*) FILTER (processed_us IS NULL) AS k FROM v_segments GROUP BY ALL),
c AS (SELECT *, sum(d) OVER w AS waiting, sum(k) OVER w AS n FROM m WINDOW w AS (PARTITION BY device_id ORDER BY b)),
g AS (SELECT *, coalesce(lag(waiting) OVER v > 0 AND waiting > lag(waiting) OVER v, false) AS growing, lead(b) OVER v IS NULL AS newest FROM c WINDOW v AS (PARTITION BY device_id ORDER BY b))
SELECT device_id, CAST(waiting AS BIGINT) AS waiting_us, CAST(n AS BIGINT) AS segment_count, waiting / 3.6e9 >= 8.0 AS is_overflow, growing FROM g WHERE newest"""


@query("backlog_stream", sql("segments", BACKLOG_SQL))
def backlog_stream(t):
    from palaver.session import scratch_dir

    R.prepare(t.spark)
    arrivals, base = scratch_dir(t.spark, "arrivals"), None
    rows = t.segments.select("device_id", "start_us", "end_us", "processed_us", "event_id")
    for n in range(3):
        rows.where(F.col("event_id") % 3 == n).drop("event_id").write.mode("append").parquet(arrivals)
        stream = t.spark.readStream.schema(rows.drop("event_id").schema).parquet(arrivals)
        base = W.backlog_stream(stream, base=base)
    return W.balances(t.spark, base, 2)


@query(
    "live_updates",
    sql("conv", "SELECT 0 AS batch_id, (SELECT conversation_id FROM v_conv ORDER BY date DESC, start_us DESC, conversation_id DESC LIMIT 1) AS conversation_id, count(*) AS total, count(*) FILTER (is_pair) AS pair FROM v_conv"),
)
def live_updates(t):
    def summarise(batch):
        conv = views.conv(views.turns(batch))
        counts = conv.agg(F.count("*").alias("total"), F.count_if("is_pair").alias("pair"))
        return A.latest_conversation(conv).join(F.broadcast(counts))

    path = W.live_updates(R.table_stream(t.spark, t.dir, "conversations"), summarise)
    return t.spark.read.parquet(path).select("batch_id", "conversation_id", "total", "pair")


@query(
    "tumbling_activity",
    sql("segments", f"""WITH w AS (SELECT *, start_us // 3600000000 * 3600000000 AS window_us FROM v_segments)
    SELECT device_id, window_us, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us
    FROM w GROUP BY device_id, window_us HAVING window_us + 3600000000 <= {CLOSED}"""),
)
def tumbling_activity(t):
    s = segment_stream(t).select("device_id", "start_us", "end_us")
    return R.run_append(W.tumbling_activity(s, "device_id", "1 hour"), "tumbling")


@query(
    "sliding_vote",
    sql("segments", f"""WITH w AS (SELECT device_id, speaker, start_us // 3600000000 * 3600000000 - h * 3600000000 AS window_us FROM v_segments, range(0, 2) r(h))
    SELECT device_id, window_us, CASE WHEN min(speaker) = max(speaker) THEN min(speaker) ELSE '' END AS speaker, count(*) AS n FROM w GROUP BY ALL HAVING window_us + 7200000000 <= {CLOSED}"""),
)
def sliding_vote(t):
    s = segment_stream(t).select("device_id", "start_us", "speaker")
    return R.run_append(W.sliding_vote(s, "device_id", "2 hours", "1 hour"), "vote")


RESET = 1704499200000000


@query(
    "late_drop",
    sql("segments", f"SELECT CASE WHEN start_us > {RESET} THEN 'kept' ELSE 'late' END AS side, count(*) AS n FROM v_segments GROUP BY 1"),
)
def late_drop(t):
    base = W.late_drop(segment_stream(t).select("segment_id", "start_us"), RESET)
    sides = [t.spark.read.parquet(f"{base}/{s}").select(F.lit(s).alias("side")) for s in ("kept", "late")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "quarantine",
    sql("segments", f"SELECT CASE WHEN ({BROKEN}) OR ({NEGATIVE}) THEN 'broken' ELSE 'ready' END AS side, count(*) AS n FROM v_segments GROUP BY 1"),
)
def quarantine(t):
    base = W.quarantine(W.stage_stream(t.spark, stage(t)))
    sides = [t.spark.read.parquet(f"{base}/{s}").select(F.lit(s).alias("side")) for s in ("ready", "broken")]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count("*").alias("n"))


LIVE_SQL = CAPPED_SQL.replace(
    "SELECT device_id, segment_id, first_us AS session_start_us, first_id AS session_first FROM f",
    """SELECT f.device_id, f.segment_id, ('0x' || substr(sha256(first_id), 1, 12))::BIGINT AS conversation_id, CASE WHEN no_speech_prob > 0.6 OR avg_logprob < -1.0 THEN 'low_confidence' ELSE 'ok' END AS status
    FROM f JOIN v_segments v ON v.segment_id = f.segment_id""",
)


# Repeats are dropped, rows are assessed, and each joins a capped conversation whose id is the hash
# of its first row.
@query("live_journal", sql("segments", LIVE_SQL, recursive=True))
def live_journal(t):
    from palaver.streaming.journal import live_journal

    s = segment_stream(t)
    twice = s.withColumn("_k", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 2).cast("int")))).drop("_k")
    marks = R.EndMarks(t.spark)
    return t.spark.read.parquet(live_journal(twice, CAP_GAP, CAP_LEN / 60, marks=marks))
