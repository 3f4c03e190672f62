"""Registered queries: filters, pages, lookups, statistics and set operations over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import quality as Q
from palaver.functions import text as X
from palaver.functions.timefmt import in_hour_window, local_hour
from palaver.operators import activity as A
from palaver.operators import lookups as L
from palaver.operators import transcripts as T
from palaver.plans.oracle import sql, time_of
from palaver.plans.registry import query

COLS = ["conversation_id", "date", "start_us", "source_type", "quality"]
PAGE = "ORDER BY date DESC, start_us DESC, conversation_id DESC"
AS_OF = "(SELECT max(date) FROM v_conv)"


def since(days: int) -> str:
    return (
        f"date >= strftime(CAST({AS_OF} AS DATE) - {days}, '%Y-%m-%d') AND date <= {AS_OF}"
    )


def as_of(t) -> str:
    """Latest date of the sample, the ``today`` of the recent-window queries."""
    return t.conv.agg(F.max("date")).first()[0]


def csv(col):
    return F.array_join(col, ",")


C = ", ".join(COLS)


@query("by_date", sql("conv", f"SELECT {C} FROM v_conv WHERE date = '2024-01-03' {PAGE} LIMIT 5"))
def by_date(t):
    return L.by_date(t.conv, "2024-01-03", 5).select(*COLS)


@query("by_id", sql("conv", f"SELECT {C}, transcript FROM v_conv WHERE conversation_id = 7"))
def by_id(t):
    return L.by_id(t.conv, 7).select(*COLS, "transcript")


@query(
    "by_participant",
    sql("conv", f"SELECT {C} FROM v_conv WHERE {since(7)} AND list_contains(participants, 'partner') {PAGE} LIMIT 50"),
)
def by_participant(t):
    return L.by_participant(t.conv, "partner", as_of(t)).select(*COLS)


@query(
    "by_quality",
    sql("conv", f"SELECT {C} FROM v_conv WHERE {since(30)} AND quality = 'good' AND source_type = 'live_conversation' {PAGE} LIMIT 50"),
)
def by_quality(t):
    return L.by_quality(t.conv, "good", as_of(t), days=30).select(*COLS)


@query(
    "like_search",
    sql("conv", f"SELECT {C} FROM v_conv WHERE lower(summary) LIKE '%the%' OR lower(transcript) LIKE '%the%' {PAGE} LIMIT 50"),
)
def like_search(t):
    return L.like_search(t.conv, "The", ["summary", "transcript"], 50).select(*COLS)


@query("recent_window", sql("conv", f"SELECT {C} FROM v_conv WHERE {since(7)}"))
def recent_window(t):
    return L.recent_window(t.conv, as_of(t), 7).select(*COLS)


@query("recent_conversations", sql("conv", f"SELECT {C} FROM v_conv {PAGE} LIMIT 500"))
def recent_conversations(t):
    return L.newest_first(t.conv, 500).select(*COLS)


@query("page", sql("conv", f"SELECT {C} FROM v_conv {PAGE} LIMIT 10 OFFSET 20"))
def page(t):
    return L.newest_first(t.conv, 10, offset=20).select(*COLS)


@query(
    "oldest_pending",
    sql("segments", "SELECT segment_id, captured_us FROM v_segments WHERE processed_us IS NULL ORDER BY captured_us, segment_id LIMIT 25"),
)
def oldest_pending(t):
    return L.oldest_pending(t.segments, 25).select("segment_id", "captured_us")


@query(
    "bounded_batch",
    sql("segments", "SELECT segment_id, captured_us FROM v_segments WHERE processed_us IS NULL ORDER BY captured_us, segment_id LIMIT 180"),
)
def bounded_batch(t):
    return L.oldest_pending(t.segments, L.batch_size(0.5)).select("segment_id", "captured_us")


@query(
    "list_days",
    sql("conv", "SELECT date, count(*) AS n FROM v_conv GROUP BY date ORDER BY date DESC"),
)
def list_days(t):
    return t.conv.groupBy("date").agg(F.count("*").alias("n")).orderBy(F.desc("date"))


@query(
    "in_hour_window",
    sql("segments", """SELECT segment_id, (start_us + 19800000000) % 86400000000 // 3600000000 AS hour,
    ((start_us + 19800000000) % 86400000000 // 3600000000 >= 22 OR (start_us + 19800000000) % 86400000000 // 3600000000 < 6) AS inside
    FROM v_segments"""),
)
def in_hour(t):
    h = local_hour(F.col("start_us"))
    return t.segments.select("segment_id", h.alias("hour"), in_hour_window(h, 22, 6).alias("inside"))


@query(
    "daily_stats",
    sql("conv", """SELECT count(*) AS total, count(*) FILTER (is_pair) AS pair,
    count(*) FILTER (source_type = 'self_talk') AS self_talk,
    count(*) FILTER (source_type = 'media_or_unknown') AS media FROM v_conv WHERE date = '2024-01-03'"""),
)
def daily_stats(t):
    return A.daily_stats(t.conv, "2024-01-03")


@query(
    "weekly_summary",
    sql("conv", f"""SELECT date, count(*) AS total, count(*) FILTER (is_pair) AS pair,
    count(*) FILTER (source_type = 'live_conversation') AS live, round(avg(duration_seconds), 1) AS avg_duration
    FROM v_conv WHERE {since(7)} GROUP BY date"""),
)
def weekly_summary(t):
    return A.weekly_summary(t.conv, as_of(t))


QD = "SELECT quality, count(*) AS n FROM v_conv WHERE source_type = 'live_conversation' AND quality <> 'not_applicable' GROUP BY quality"


@query("quality_distribution", sql("conv", QD))
def quality_distribution(t):
    return A.quality_distribution(t.conv)


@query(
    "percent_of_total",
    sql("conv", f"SELECT quality, n, CAST(floor(n * 100.0 / sum(n) OVER () + 0.5) AS BIGINT) AS percent FROM ({QD})"),
)
def percent_of_total(t):
    return A.percent_of_total(A.quality_distribution(t.conv), "quality")


@query(
    "pair_stats",
    sql("conv", f"""SELECT count(*) AS total, coalesce(round(sum(duration_seconds) / 60.0, 1), 0.0)::DOUBLE AS minutes,
    coalesce(round(avg(duration_seconds), 1), 0.0)::DOUBLE AS avg_seconds, count(*) FILTER (quality = 'good') AS good,
    count(*) FILTER (quality = 'tense') AS tense FROM v_conv WHERE {since(7)} AND is_pair"""),
)
def pair_stats(t):
    return A.pair_stats(t.conv, as_of(t))


@query(
    "recent_stats",
    sql("conv", f"""WITH r AS (SELECT * FROM v_conv WHERE {since(7)})
    SELECT 'total' AS level, '' AS name, count(*) AS n FROM r HAVING count(*) > 0
    UNION ALL SELECT 'pair', '', count(*) FROM r WHERE is_pair HAVING count(*) > 0
    UNION ALL SELECT 'source_type', source_type, count(*) FROM r GROUP BY source_type
    UNION ALL SELECT 'quality', quality, count(*) FROM r WHERE source_type = 'live_conversation' GROUP BY quality"""),
)
def recent_stats(t):
    return A.recent_stats(t.conv, as_of(t))


@query(
    "backlog_status",
    sql("segments", """WITH b AS (SELECT sum((end_us - start_us) / 1e6) / 3600.0 AS h, count(*) AS n, min(captured_us) AS o
    FROM v_segments WHERE processed_us IS NULL)
    SELECT round(h, 6) AS total_hours, n AS segment_count, o AS oldest_captured_us, round(n * 30.0 / 3600.0, 6)::DOUBLE AS cleanup_hours,
    round(h + n * 30.0 / 3600.0, 6) AS processing_hours, round(h * 12.0 * 0.45, 6) AS cache_mb, h >= 8.0 AS is_overflow FROM b"""),
)
def backlog_status(t):
    out = A.backlog_status(backlog_rows(t))
    return out.withColumns({c: F.round(c, 6) for c, k in out.dtypes if k == "double"})


def backlog_rows(t):
    span = F.col("end_us") - F.col("start_us")
    return t.segments.select(
        "device_id",
        "segment_id",
        "captured_us",
        "processed_us",
        (span / 1e6).alias("duration_seconds"),
        (span / 1000).cast("bigint").alias("duration_ms"),
    )


@query(
    "backlog_growth",
    sql("segments", """WITH e AS (
      SELECT device_id, captured_us AS at_us, 0 AS kind, segment_id, (end_us - start_us) // 1000 AS delta FROM v_segments
      UNION ALL SELECT device_id, processed_us, 1, segment_id, -((end_us - start_us) // 1000) FROM v_segments WHERE processed_us IS NOT NULL),
    r AS (SELECT *, CAST(coalesce(sum(delta) OVER (PARTITION BY device_id ORDER BY at_us, kind, segment_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS previous_ms FROM e)
    SELECT segment_id, kind, previous_ms, previous_ms + delta AS balance_ms, previous_ms > 0 AND delta > 0 AS growing FROM r"""),
)
def backlog_growth(t):
    out = A.backlog_growth(backlog_rows(t), "device_id")
    return out.select("segment_id", "kind", "previous_ms", "balance_ms", "growing")


@query(
    "usage_today",
    sql("usage", """SELECT count(*) AS requests, round(coalesce(sum(audio_seconds), 0.0), 4)::DOUBLE AS audio_seconds,
    round(coalesce(sum(billed_seconds), 0.0), 4)::DOUBLE AS billed_seconds FROM v_usage WHERE day = '2024-01-05'"""),
)
def usage_today(t):
    return A.usage_for_day(t.usage, "2024-01-05").select(
        "requests",
        F.round("audio_seconds", 4).alias("audio_seconds"),
        F.round("billed_seconds", 4).alias("billed_seconds"),
    )


@query(
    "latest_conversation",
    sql("conv", f"SELECT conversation_id FROM v_conv {PAGE} LIMIT 1"),
)
def latest_conversation(t):
    return A.latest_conversation(t.conv)


@query(
    "period_change",
    sql("conv", """WITH d AS (SELECT date, count(*) AS total FROM v_conv GROUP BY date),
    p AS (SELECT *, coalesce(lag(total) OVER (ORDER BY date), 0) AS previous FROM d),
    c AS (SELECT *, (total - previous) / nullif(previous, 0) * 100.0 AS pct FROM p)
    SELECT date, total, previous, CASE WHEN previous = 0 THEN CASE WHEN total > 0 THEN 'up' ELSE 'neutral' END
      WHEN abs(pct) < 1 THEN 'neutral' WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction,
      CASE WHEN previous = 0 OR abs(pct) < 1 THEN 0.0 ELSE round(abs(pct), 6) END::DOUBLE AS percent FROM c"""),
)
def period_change(t):
    totals = t.conv.groupBy("date").agg(F.count("*").alias("total"))
    return A.period_change(totals).withColumn("percent", F.round("percent", 6))


@query(
    "conversation_rollup",
    sql("turns", """WITH first AS (SELECT conv_id, speaker, min(start_us) AS s FROM v_turns GROUP BY conv_id, speaker),
    who AS (SELECT conv_id, string_agg(speaker, ',' ORDER BY s) AS participants FROM first GROUP BY conv_id)
    SELECT conv_id, CAST(0 AS BIGINT) AS part, min(start_us) AS start_us, max(end_us) AS end_us, any_value(participants) AS participants,
    array_to_string(list_sort(list_filter(list_distinct(list(language)), lambda x: x <> '')), ',') AS languages,
    CASE WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'needs_review' END AS quality,
    (max(end_us) - min(start_us)) / 1e6 AS duration_seconds,
    string_agg(text, chr(10) ORDER BY start_us, segment_id) AS transcript
    FROM v_turns JOIN who USING (conv_id) GROUP BY conv_id"""),
)
def conversation_rollup(t):
    out = T.conversation_rollup(t.turns)
    return out.withColumn("participants", csv("participants")).withColumn("languages", csv("languages"))


@query(
    "daily_rollup",
    sql("turns", f"""SELECT date, CAST(0 AS BIGINT) AS part, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, count(*) AS segment_count,
    min_by(start_us, (start_us, segment_id)) AS first_us, max_by(end_us, (start_us, segment_id)) AS last_us,
    string_agg('[' || {time_of('start_us')} || '] (' || language || ') ' || text, chr(10) ORDER BY start_us, segment_id) AS transcript
    FROM v_turns GROUP BY date"""),
)
def daily_rollup(t):
    return T.daily_rollup(t.turns)


@query(
    "conversation_language_avg",
    sql("segments", """WITH l AS (SELECT device_id, language, avg(no_speech_prob) AS p FROM v_segments WHERE language <> '' GROUP BY ALL)
    SELECT device_id, string_agg(language || ':' || CAST(CAST(round(p * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY p DESC, language) AS languages FROM l GROUP BY device_id"""),
)
def conversation_language_avg(t):
    # Decimal sums do not depend on the order of the rows, so equal averages are equal and go by language.
    per = (
        t.segments.filter("language <> ''")
        .groupBy("device_id", "language")
        .agg(F.avg(F.col("no_speech_prob").cast("decimal(20,10)")).alias("p"))
    )
    item = F.struct((-F.col("p")).alias("o"), F.col("language").alias("l"), F.round(F.col("p") * 1000000).cast("bigint").alias("m"))
    return per.groupBy("device_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(item)), lambda x: F.concat(x["l"], F.lit(":"), x["m"].cast("string"))
            ),
            ",",
        ).alias("languages")
    )


@query(
    "speaker_confidence_avg",
    sql("segments", "SELECT device_id, speaker, round(avg(1 - no_speech_prob), 6) AS confidence FROM v_segments GROUP BY ALL"),
)
def speaker_confidence_avg(t):
    per = t.segments.groupBy("device_id", "speaker").agg(F.avg(1 - F.col("no_speech_prob")).alias("c"))
    # The map per group is what callers read; exploding it back keeps this result flat.
    maps = per.groupBy("device_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "c"))).alias("m"))
    return maps.select("device_id", F.explode("m").alias("speaker", "confidence")).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query(
    "policy_distinct_languages",
    sql("segments", """SELECT date, array_to_string(list_sort(list_filter(list_distinct(list(language)), lambda x: x <> '')), ',') AS languages
    FROM v_segments GROUP BY date"""),
)
def policy_distinct_languages(t):
    langs = F.collect_set(F.nullif("language", F.lit("")))
    return t.segments.groupBy("date").agg(csv(F.sort_array(langs)).alias("languages"))


@query(
    "conversation_members",
    sql("conv turns", """SELECT conversation_id, CAST(0 AS BIGINT) AS part, string_agg(segment_id || '/' || v_turns.speaker, ' ' ORDER BY v_turns.start_us, segment_id) AS members
    FROM v_conv LEFT JOIN v_turns ON conv_id = conversation_id GROUP BY conversation_id"""),
)
def conversation_members(t):
    m = T.ordered_parts(
        t.turns.withColumnRenamed("conv_id", "conversation_id"),
        ["conversation_id"],
        ["start_us", "segment_id"],
        m=F.concat_ws("/", "segment_id", "speaker"),
    )
    return (
        t.conv.select("conversation_id")
        .join(m, "conversation_id", "left")
        .select("conversation_id", "part", T.joined("m", " ").alias("members"))
    )


@query(
    "members_in_order",
    sql("turns", "SELECT conv_id, segment_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_us, segment_id) - 1 AS position FROM v_turns"),
)
def members_in_order(t):
    return T.with_position(
        t.turns.select("conv_id", "segment_id", "start_us"), ["conv_id"], ["start_us", "segment_id"]
    ).select("conv_id", "segment_id", "position")


ENGINE = "CASE WHEN turn % 2 = 0 THEN 'local' ELSE 'cloud' END"


@query(
    "engine_lookup",
    sql("conv turns", f"""SELECT conversation_id, coalesce(engine, 'legacy') AS engine FROM v_conv LEFT JOIN
    (SELECT conv_id, min_by({ENGINE}, turn) AS engine FROM v_turns WHERE conv_id % 5 <> 0 GROUP BY conv_id) ON conv_id = conversation_id"""),
)
def engine_lookup(t):
    first = (
        t.turns.filter("conv_id % 5 <> 0")
        .groupBy(F.col("conv_id").alias("conversation_id"))
        .agg(F.min_by(F.expr(ENGINE), F.struct("start_us", "segment_id")).alias("engine"))
    )
    return (
        t.conv.select("conversation_id")
        .join(first, "conversation_id", "left")
        .select("conversation_id", F.coalesce("engine", F.lit("legacy")).alias("engine"))
    )


@query(
    "segment_conversation",
    sql("conv turns", """SELECT segment_id, v_turns.end_us, v_conv.date, conversation_id FROM v_turns JOIN v_conv ON conv_id = conversation_id
    WHERE turn % 3 <> 2 ORDER BY v_turns.end_us DESC, segment_id DESC LIMIT 1"""),
)
def segment_conversation(t):
    live = t.turns.filter("turn % 3 <> 2").agg(
        F.max_by(F.struct("segment_id", "end_us", "conv_id"), F.struct("end_us", "segment_id")).alias("s")
    )
    return live.select("s.*").join(
        t.conv.select("conversation_id", "date"), F.col("conv_id") == F.col("conversation_id")
    ).select("segment_id", "end_us", "date", "conversation_id")


@query(
    "anti_existing",
    sql("segments", "SELECT segment_id FROM v_segments WHERE processed_us IS NULL"),
)
def anti_existing(t):
    done = t.segments.filter(F.col("processed_us").isNotNull()).select("segment_id")
    return t.segments.select("segment_id").join(done, "segment_id", "left_anti")


@query(
    "conversation_payload",
    sql("conv turns", """SELECT conversation_id, CAST(0 AS BIGINT) AS part, v_conv.transcript AS raw, 'local' AS engine,
    min_by(status, turn) AS status, min_by(segment_id, turn) AS segment_id,
    string_agg(v_turns.start_us || '|' || speaker || '|' || status, ';' ORDER BY turn) AS turns,
    CASE WHEN bool_or(status <> 'ok') THEN 'low_confidence' ELSE '' END AS review_flags
    FROM v_conv JOIN v_turns ON conv_id = conversation_id GROUP BY conversation_id, v_conv.transcript"""),
)
def conversation_payload(t):
    conv = t.conv.select("conversation_id", "transcript").withColumn("raw_transcript", F.lit(""))
    members = t.turns.withColumn("engine", F.expr(ENGINE))
    out = T.conversation_payload(conv, members)
    turn = lambda x: F.concat_ws("|", x["start_us"].cast("string"), x["speaker"], x["status"])
    return out.select(
        "conversation_id",
        "part",
        "raw",
        "engine",
        "status",
        "segment_id",
        F.array_join(F.transform("turns", turn), ";").alias("turns"),
        csv("review_flags").alias("review_flags"),
    )


FLAGS_VIEW = """SELECT doc_id // 3 AS conv_id, text, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'imported' WHEN 2 THEN 'low_confidence' ELSE 'ok' END AS status,
 CASE WHEN lang = 'en' THEN 'en' ELSE CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END END AS language, doc_id % 4 = 1 AS imported FROM v_texts WHERE doc_id >= 0"""


def flag_members(t):
    d = F.col("doc_id")
    return t.texts.filter("doc_id >= 0").select(
        F.expr("doc_id div 3").alias("conv_id"),
        "text",
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'imported' WHEN 2 THEN 'low_confidence' ELSE 'ok' END").alias("status"),
        F.when(F.col("lang") == "en", "en").when(d % 2 == 0, F.col("lang")).otherwise("").alias("language"),
        (d % 4 == 1).alias("imported"),
    )


LATIN = r"[\p{Latin}\x{0900}-\x{097F}\x{200C}\x{200D}]"
SIG = "({c} LIKE '%thanks for watching%' OR {c} LIKE '%amara.org%' OR {c} LIKE '%use only hindi and english%' OR {c} LIKE '%do not output any other language%')"


def policy_sql(text: str, lang: str) -> str:
    return (
        f"CASE WHEN lower(coalesce({lang}, '')) NOT IN ('hi','hindi','en','english','') THEN 'unexpected_language' "
        f"WHEN regexp_matches(regexp_replace({text}, '{LATIN}', '', 'g'), '[\\p{{L}}\\p{{M}}]') THEN 'unexpected_script' END"
    )


def echo_sql(text: str) -> str:
    c = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return f"(contains({c}, 'hindiandenglish') AND (contains({c}, 'owner') OR contains({c}, 'partner')))"


FLAGS_SQL = f"""WITH m AS ({FLAGS_VIEW}),
f AS (SELECT conv_id, CASE WHEN status NOT IN ('ok','imported') THEN status END AS f1,
        CASE WHEN NOT imported THEN {policy_sql('text', 'language')} END AS f2,
        {SIG.format(c='lower(text)')} AS sig, {echo_sql('text')} AS echo FROM m),
g AS (SELECT conv_id, list_distinct(list_filter(list(f1) || list(f2), lambda x: x IS NOT NULL)) AS own, bool_or(sig) AS sig, bool_or(echo) AS echo FROM f GROUP BY conv_id)
SELECT conv_id, array_to_string(list_sort((CASE WHEN len(own) > 0 THEN own WHEN sig THEN ['suspected_hallucination'] ELSE [] END)
  || (CASE WHEN echo THEN ['suspected_prompt_echo'] ELSE [] END)), ',') AS review_flags FROM g"""


@query("review_flags", sql("texts", FLAGS_SQL))
def review_flags(t):
    out = T.review_flags(flag_members(t), imported="imported")
    return out.select("conv_id", csv("review_flags").alias("review_flags"))


@query(
    "flag_union",
    sql("texts", f"""WITH m AS ({FLAGS_VIEW}), f AS (
    SELECT conv_id, unnest([CASE WHEN status NOT IN ('ok','imported') THEN status END, {policy_sql('text', 'language')}]) AS flag FROM m)
    SELECT conv_id, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS flags FROM f GROUP BY conv_id"""),
)
def flag_union(t):
    m = flag_members(t)
    a = F.collect_set(F.when(~F.col("status").isin("ok", "imported"), F.col("status")))
    b = F.collect_set(Q.language_policy(F.col("text"), F.col("language")))
    g = m.groupBy("conv_id").agg(a.alias("a"), b.alias("b"))
    return g.select("conv_id", csv(F.sort_array(F.array_union("a", "b"))).alias("flags"))


@query(
    "sync_ids",
    sql("conv turns", "SELECT conversation_id FROM v_conv EXCEPT SELECT conv_id FROM v_turns WHERE turn >= 4"),
)
def sync_ids(t):
    return t.conv.select("conversation_id").subtract(
        t.turns.filter("turn >= 4").select(F.col("conv_id").alias("conversation_id"))
    )


@query(
    "lineage_union",
    sql("turns segments", """SELECT segment_id, 'imported' AS engine, start_us FROM v_turns
    UNION ALL SELECT segment_id, '' AS engine, start_us FROM v_segments"""),
)
def lineage_union(t):
    new = t.turns.select("segment_id", F.lit("imported").alias("engine"), "start_us")
    both = t.segments.select("segment_id", "start_us").unionByName(new, allowMissingColumns=True)
    return both.withColumn("engine", F.coalesce("engine", F.lit("")))


@query(
    "notes_by_day",
    sql("conv", "SELECT date, CAST(0 AS BIGINT) AS part, string_agg(CAST(conversation_id AS VARCHAR), ',' ORDER BY start_us, conversation_id) AS notes FROM v_conv GROUP BY date"),
)
def notes_by_day(t):
    parts = T.ordered_parts(
        t.conv.select("date", "start_us", "conversation_id"),
        ["date"],
        ["start_us", "conversation_id"],
        n=F.col("conversation_id").cast("string"),
    )
    return parts.select("date", "part", T.joined("n", ",").alias("notes"))


@query(
    "health_counts",
    sql("conv segments", "SELECT (SELECT count(*) FROM v_conv) AS conversations, (SELECT count(*) FROM v_segments WHERE processed_us IS NULL) AS staged"),
)
def health_counts(t):
    a = t.conv.agg(F.count("*").alias("conversations"))
    b = t.segments.filter("processed_us IS NULL").agg(F.count("*").alias("staged"))
    return a.join(F.broadcast(b))  # two rows of one


@query(
    "status_report",
    sql("conv segments", f"""WITH b AS (SELECT sum((end_us - start_us) / 1e6) / 3600.0 AS h, count(*) AS n FROM v_segments WHERE processed_us IS NULL),
    c AS (SELECT count(*) AS week_total, count(*) FILTER (is_pair) AS week_pair FROM v_conv WHERE {since(7)})
    SELECT round(h, 6) AS backlog_hours, n AS segment_count, week_total, week_pair, round(h * 2.0, 6) AS catch_up_hours,
    CASE WHEN h >= 8 THEN 'overflow' WHEN h > 2 THEN 'growing' ELSE 'normal' END AS level FROM b, c"""),
)
def status_report(t):
    b = A.backlog_status(backlog_rows(t)).select("total_hours", "segment_count")
    c = L.recent_window(t.conv, as_of(t), 7).agg(
        F.count("*").alias("week_total"), F.count_if("is_pair").alias("week_pair")
    )
    h = F.col("total_hours")
    return b.join(F.broadcast(c)).select(
        F.round(h, 6).alias("backlog_hours"),
        "segment_count",
        "week_total",
        "week_pair",
        F.round(h * 2.0, 6).alias("catch_up_hours"),
        F.when(h >= 8, "overflow").when(h > 2, "growing").otherwise("normal").alias("level"),
    )


@query(
    "update_by_key",
    sql("profiles", "SELECT profile_id, name, CASE WHEN profile_id % 4 = 0 THEN false ELSE enabled END AS enabled FROM v_profiles"),
)
def update_by_key(t):
    changes = t.profiles.filter("profile_id % 4 = 0").select("profile_id", F.lit(False).alias("enabled"))
    return L.update_by_key(t.profiles, changes, "profile_id", "enabled").select("profile_id", "name", "enabled")


@query(
    "enabled_profiles",
    sql("profiles", "SELECT profile_id, name FROM v_profiles WHERE enabled AND model = 'ecapa'"),
)
def enabled_profiles(t):
    return t.profiles.filter("enabled AND model = 'ecapa'").select("profile_id", "name")


@query(
    "preview",
    sql("texts", """SELECT doc_id, substring(text, 1, 100) AS preview,
    substring(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS one_liner,
    CASE WHEN length(text) <= 40 THEN text ELSE substring(text, 1, 37) || '...' END AS cut,
    CASE WHEN word_count = 1 THEN 'word' ELSE 'words' END AS noun FROM v_texts"""),
)
def preview(t):
    return t.texts.select(
        "doc_id",
        X.preview(F.col("text")).alias("preview"),
        X.one_liner(F.col("text")).alias("one_liner"),
        X.truncate(F.col("text"), 40).alias("cut"),
        X.pluralize(F.col("word_count"), "word").alias("noun"),
    )


@query(
    "strip_tags",
    sql("", "SELECT page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g')) AS plain, trim(url) <> '' AS non_empty, page_id > 0 AS positive FROM pages"),
)
def strip_tags(t):
    return t.raw("pages").select(
        "page_id",
        X.strip_tags(F.col("html")).alias("plain"),
        (F.trim("url") != "").alias("non_empty"),
        (F.col("page_id") > 0).alias("positive"),
    )
