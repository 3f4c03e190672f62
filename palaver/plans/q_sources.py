"""Registered queries: sources, sinks, notes and end-to-end jobs.

Files are written from the given tables into the scratch folder of the session and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions.timefmt import local_time
from palaver.operators import accuracy as C
from palaver.operators import notes as M
from palaver.operators import transcripts as T
from palaver.plans import jobs, views
from palaver.plans.oracle import sql, time_of, trim_of, words_of
from palaver.plans.q_corpus import OCC, WER, recent
from palaver.plans.q_dashboard import QD, as_of, backlog_rows, since
from palaver.plans.q_sessions import GROUP
from palaver.plans.q_text import LOOP_SQL, SLUG
from palaver.plans.registry import query
from palaver.session import scratch_dir
from palaver.sources import files, journal_csv, tables
from palaver.sources.stored import StoredTable


@query(
    "scan_segments_jsonl",
    sql("turns", "SELECT segment_id AS audio_path, date, text, language, round(words / 300.0, 6)::DOUBLE AS confidence FROM v_turns"),
)
def scan_segments_jsonl(t):
    path = scratch_dir(t.spark, "jsonl")
    rows = t.turns.select(
        F.col("date").alias("day"),
        F.col("date"),
        local_time(F.col("start_us")).alias("start_time"),
        local_time(F.col("end_us")).alias("end_time"),
        "text",
        "language",
        (F.col("words") / 300.0).alias("confidence"),
        F.col("segment_id").alias("audio_path"),
    ).drop("date")
    rows.write.partitionBy("day").json(f"{path}/out")
    out = files.scan_segments_jsonl(t.spark, f"{path}/out", "day=*")
    return out.select("audio_path", "date", "text", "language", F.round("confidence", 6).alias("confidence"))


BROKEN = "event_id % 37 = 5"
NEGATIVE = "event_id % 41 = 7"


def stage(t) -> str:
    """Staged metadata of the segments as JSON lines, some cut off and some with bad durations."""
    path = scratch_dir(t.spark, "staged") + "/in"
    s = t.segments
    dur = F.when(F.expr(NEGATIVE), -1.0).otherwise((F.col("end_us") - F.col("start_us")) / 1e6)
    line = F.to_json(
        F.struct(
            "segment_id",
            F.col("start_us").cast("string").alias("start_time"),
            F.col("end_us").cast("string").alias("end_time"),
            F.lit(16000).alias("sample_rate"),
            dur.alias("duration_seconds"),
            F.lpad(F.col("captured_us").cast("string"), 20, "0").alias("captured_at"),
            F.when(F.col("event_id") % 2 == 0, 800).alias("core_start_samples"),
        )
    )
    cut = F.when(F.expr(BROKEN), F.substring(line, 1, 40)).otherwise(line)
    s.select(cut.alias("value")).write.text(path)
    return path


@query(
    "scan_staged",
    sql("segments", f"""SELECT segment_id, CAST(CASE WHEN event_id % 2 = 0 THEN 800 ELSE 0 END AS BIGINT) AS core_start, CAST(round((end_us - start_us) / 1e6 * 16000) AS BIGINT) AS core_end
    FROM v_segments WHERE NOT ({BROKEN}) AND NOT ({NEGATIVE}) ORDER BY captured_us, segment_id LIMIT 500"""),
)
def scan_staged(t):
    p = files.pending(files.scan_staged(t.spark, stage(t)), 500)
    return p.select("segment_id", F.col("core_start_samples").alias("core_start"), F.col("core_end_samples").alias("core_end"))


@query(
    "corrupt_report",
    sql("segments", f"""SELECT count(*) FILTER (NOT ({BROKEN}) AND NOT ({NEGATIVE})) AS valid, count(*) FILTER (({BROKEN}) OR ({NEGATIVE})) AS invalid,
    round(sum((end_us - start_us) / 1e6) FILTER (NOT ({BROKEN}) AND NOT ({NEGATIVE})) / 3600, 6) AS hours, 'needs_attention' AS status FROM v_segments"""),
)
def corrupt_report(t):
    r = files.corrupt_report(files.scan_staged(t.spark, stage(t)))
    return r.withColumn("hours", F.round("hours", 6))


def csv_rows(t):
    """Import rows from the turns, those that cross local midnight among them."""
    return t.turns.select(
        "date",
        local_time(F.col("start_us")).alias("start_time"),
        local_time(F.col("end_us")).alias("end_time"),
        "text",
        "language",
        "speaker",
        F.lit("").alias("engine"),
    )


@query(
    "import_csv",
    sql("turns", f"""WITH r AS (SELECT DISTINCT conv_id, date, {time_of('start_us')} AS s, {time_of('end_us')} AS e, text, language, speaker FROM v_turns)
    SELECT count(*) FILTER (language = 'hi') AS duplicates, count(*) FILTER (language <> 'hi') AS imported FROM r WHERE e >= s"""),
)
def import_csv(t):
    path = scratch_dir(t.spark, "import")
    # An import takes all rows or none, so only rows without a violation go into the file.
    good = journal_csv.checked(csv_rows(t)).filter(F.size("violations") == 0)
    good.select(*csv_rows(t).columns).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{path}/in")
    ready = journal_csv.prepare(journal_csv.read_csv(t.spark, f"{path}/in"), max_rows=None)
    stored = ready.filter("language = 'hi'")  # what an earlier import left behind
    new = journal_csv.split_new(ready, stored)
    n = ready.select("id", F.lit(0).alias("new")).unionByName(new.select("id", F.lit(1).alias("new")))
    counts = n.agg(F.count_if(F.col("new") == 1).alias("imported"), F.count_if(F.col("new") == 0).alias("total"))
    return counts.select("imported", (F.col("total") - F.col("imported")).alias("duplicates"))


BAD = "CASE conv_id % 5 WHEN 1 THEN 'x' || date WHEN 2 THEN date WHEN 3 THEN date ELSE date END"


@query(
    "import_csv_violations",
    sql("turns", f"""WITH r AS (SELECT segment_id, conv_id, {BAD} AS d, {time_of('start_us')} AS s, {time_of('end_us')} AS e, text FROM v_turns)
    SELECT segment_id, CASE conv_id % 5 WHEN 1 THEN 'date,start_time,end_time' WHEN 2 THEN CASE WHEN e > s THEN 'order' ELSE '' END
      WHEN 3 THEN concat_ws(',', CASE WHEN e < s THEN 'order' END, 'blank_text') WHEN 4 THEN 'start_time'
      ELSE concat_ws(',', CASE WHEN e < s THEN 'order' END,
        CASE WHEN conv_id % 2 = 0 AND (s >= '06:30:00' OR e >= '06:30:00') THEN 'other_day' END) END AS violations FROM r"""),
)
def import_csv_violations(t):
    s, e = local_time(F.col("start_us")), local_time(F.col("end_us"))
    k = F.col("conv_id") % 5
    # Times of another zone, whose local day may be the next one.
    zone = F.when((k == 0) & (F.col("conv_id") % 2 == 0), "-12:00").otherwise("")
    rows = t.turns.select(
        "segment_id",
        F.expr(BAD).alias("date"),
        F.when(k == 2, e).when(k == 4, "25:00").otherwise(F.concat(s, zone)).alias("start_time"),
        F.when(k == 2, s).otherwise(F.concat(e, zone)).alias("end_time"),
        F.when(k == 3, " \n").otherwise(F.col("text")).alias("text"),
    )
    out = journal_csv.checked(rows)
    return out.select("segment_id", F.array_join("violations", ",").alias("violations"))


def conv_rows(t):
    return t.conv.select(
        "*",
        local_time(F.col("start_us")).alias("start_time"),
        local_time(F.col("end_us")).alias("end_time"),
        F.lit("").alias("raw_transcript"),
    )


@query(
    "export_csv",
    sql("conv", f"""SELECT date, {time_of('start_us')} AS start_time, {time_of('end_us')} AS end_time, transcript AS text, array_to_string(languages, ',') AS language,
    array_to_string(participants, ',') AS speaker, CASE WHEN conversation_id % 5 = 0 THEN 'legacy' ELSE 'local' END AS engine FROM v_conv"""),
)
def export_csv(t):
    path = scratch_dir(t.spark, "export") + "/out"
    members = t.turns.filter("conv_id % 5 <> 0").select(
        F.col("conv_id").alias("conversation_id"), "segment_id", "start_us", F.lit("local").alias("engine")
    )
    journal_csv.write_csv(journal_csv.export_rows(conv_rows(t), members), path)
    out = journal_csv.read_csv(t.spark, path)
    return out.select(*[F.coalesce(c, F.lit("")).alias(c) for c in out.columns])


@query(
    "write_conversations",
    sql("conv", "SELECT conversation_id, date, CASE WHEN conversation_id % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM v_conv"),
)
def write_conversations(t):
    path = scratch_dir(t.spark, "conversations") + "/table"
    schema = "conversation_id bigint, batch string, date string"
    rows = t.conv.select("conversation_id", "date")
    even = rows.filter("conversation_id % 2 = 0").withColumn("batch", F.lit("first"))
    tables.insert_new(t.spark, path, even, "conversation_id", schema)
    return tables.insert_new(t.spark, path, rows.withColumn("batch", F.lit("second")), "conversation_id", schema)


@query(
    "upsert_daily",
    sql("segments", """SELECT date, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, count(*) AS segment_count, min(start_us) AS first_us,
    max_by(end_us, (start_us, segment_id)) AS last_us FROM v_segments GROUP BY date"""),
)
def upsert_daily(t):
    path = scratch_dir(t.spark, "daily") + "/table"
    tables.upsert_daily(t.spark, path, t.segments.filter("event_id % 3 = 0"))
    return tables.upsert_daily(t.spark, path, t.segments.filter("event_id % 3 <> 0"))


@query(
    "mark_processed",
    sql("segments", "SELECT segment_id, coalesce(processed_us, CASE WHEN event_id % 2 = 0 THEN 1 END, -1) AS processed_us FROM v_segments"),
)
def mark_processed(t):
    out = tables.mark_processed(t.segments, t.segments.filter("event_id % 2 = 0"), F.lit(1))
    return out.select("segment_id", F.coalesce("processed_us", F.lit(-1)).alias("processed_us"))


HM = f"substring({time_of('start_us')}, 1, 5)"
STEM = f"replace({HM}, ':', '') || '-' || coalesce(nullif({SLUG.replace('lower(text)', 'lower(summary)')}, ''), 'conversation')"
LF = "chr(10)"
NOTE = f"""WITH ln AS (SELECT conv_id, turn, '[' || {time_of('start_us')} || '] ' || upper(speaker[1]) || lower(speaker[2:]) || ': ' || text AS line, status = 'low_confidence' AS low FROM v_turns),
fu AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS full_text, list_filter(list(CASE WHEN low THEN turn END ORDER BY turn), lambda x: x IS NOT NULL) AS low FROM ln GROUP BY conv_id),
nn AS (SELECT *, string_split(full_text, chr(10)) AS ls FROM fu JOIN v_conv ON conversation_id = conv_id),
mk AS (SELECT *, [least(x, len(ls) - 1) FOR x IN low] AS tg FROM nn),
tx AS (SELECT *, array_to_string([ls[i] || CASE WHEN list_contains(tg, i - 1) THEN ' ⚠️' ELSE '' END FOR i IN range(1, len(ls) + 1)], chr(10)) AS marked FROM mk)
SELECT conversation_id, CAST(0 AS BIGINT) AS part, date, {STEM} AS stem,
 '---' || {LF} || 'date: ''' || date || '''' || {LF} || 'duration_seconds: ' || duration_seconds || {LF} || 'end_time: ''' || substring({time_of('end_us')}, 1, 5) || '''' || {LF}
 || 'is_pair_conversation: ' || is_pair || {LF} || 'languages:' || {LF} || array_to_string(['- ' || x || {LF} FOR x IN languages], '')
 || CASE WHEN len(low) > 0 THEN 'needs_review: true' || {LF} ELSE '' END || 'participants:' || {LF} || array_to_string(['- ' || x || {LF} FOR x IN participants], '')
 || 'quality: ' || quality || {LF} || 'source_type: ' || source_type || {LF} || 'start_time: ''' || {HM} || '''' || {LF} || 'tags:' || {LF} || '- journal' || {LF} || '- conversation' || {LF}
 || CASE WHEN len(low) > 0 THEN '- needs-review' || {LF} ELSE '' END || '---' || {LF} || {LF} || '## Summary' || {LF} || {LF} || summary || {LF}
 || CASE WHEN len(low) > 0 THEN '> ⚠️ **Low confidence segments detected.** Some transcript lines may need review. Flagged lines are marked with ⚠️' || {LF} ELSE '' END
 || '## Cleaned Transcript' || {LF} || {LF} || '```transcript' || {LF} || marked || {LF} || '```' || {LF} || {LF} || '<details>' || {LF} || '<summary>Raw Transcript</summary>' || {LF} || {LF}
 || '```transcript' || {LF} || full_text || {LF} || '```' || {LF} || {LF} || '</details>' || {LF} || {LF} || '---' || {LF} || '*' || words || ' words, ' || duration_seconds || 's*' AS note FROM tx"""


@query("render_note", sql("conv turns", NOTE))
def render_note(t):
    members = t.turns.select(
        F.col("conv_id").alias("conversation_id"),
        "segment_id",
        "start_us",
        "speaker",
        "text",
        (F.col("status") == "low_confidence").alias("low_confidence"),
    )
    return M.render_notes(t.conv, members)


@query(
    "render_daily_note",
    sql("conv", f"""WITH l AS (SELECT *, '- [[Conversations/' || date || '/' || {STEM} || '|' || replace({HM}, ':', '') || ']] — ' || substring(summary, 1, 80) || CASE WHEN length(summary) > 80 THEN '...' ELSE '' END || chr(10) AS link FROM v_conv)
    SELECT date, CAST(0 AS BIGINT) AS part, '---' || {LF} || 'date: ''' || date || '''' || {LF} || 'media_flagged: ' || count(*) FILTER (source_type = 'media_or_unknown') || {LF} || 'self_talk: ' || count(*) FILTER (source_type = 'self_talk')
    || {LF} || 'tags:' || {LF} || '- journal' || {LF} || '- daily' || {LF} || 'total_conversations: ' || count(*) || {LF} || 'with_partner: ' || count(*) FILTER (is_pair) || {LF} || '---' || {LF} || {LF} || '# Journal: ' || date || {LF} || {LF}
    || '## Summary' || {LF} || {LF} || '*Daily summary will be updated as conversations are recorded.*' || {LF} || {LF} || '## Conversations' || {LF} || {LF} || string_agg(link, '' ORDER BY start_us DESC, conversation_id DESC) AS note FROM l GROUP BY date"""),
)
def render_daily_note(t):
    return M.render_daily_notes(t.conv)


PATHS = "CASE WHEN event_id % 4 = 3 THEN 'in/2024-13-45/clip-' ELSE 'in/' || date || '/raw/clip-' END || (event_id % 5) || '.flac'"


@query(
    "layout_paths",
    sql("segments", f"""WITH p AS (SELECT event_id, {PATHS} AS path, CASE WHEN event_id % 4 = 3 THEN 'undated' ELSE date END AS dir, 'clip-' || (event_id % 5) AS stem FROM v_segments),
    n AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY event_id) - 1 AS k FROM p)
    SELECT path, dir, event_id, stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.flac' AS name FROM n"""),
)
def layout_paths(t):
    rows = t.segments.select("event_id", F.expr(PATHS).alias("path"))
    return files.layout_paths(rows, "path", "event_id", "undated").select("path", "dir", "event_id", "name")


@query(
    "full_day_text",
    sql("turns", f"""WITH l AS (SELECT date, start_us, segment_id, '[' || {time_of('start_us')} || '] (' || language || ') ' || text AS line FROM v_turns WHERE {trim_of('text')} <> ''),
    d AS (SELECT date, string_agg(line, chr(10) ORDER BY start_us, segment_id) AS txt FROM l GROUP BY date)
    SELECT date, unnest(string_split(txt, chr(10))) AS line FROM d"""),
)
def full_day_text(t):
    path = scratch_dir(t.spark, "days") + "/out"
    files.write_day_texts(T.daily_rollup(t.turns), path)
    back = t.spark.read.schema("value string, date string").text(path)
    return back.select("date", F.col("value").alias("line"))


@query(
    "source_decision",
    sql("turns", """SELECT conv_id AS conversation_id, 'src-' || conv_id // 2 || '-' || role AS source_id, min(start_us) AS start_us, CASE WHEN conv_id // 2 % 2 = 0 THEN 'accepted' ELSE 'excluded' END AS status FROM v_turns GROUP BY ALL"""),
)
def source_decision(t):
    src = F.concat(F.lit("src-"), F.expr("conv_id div 2").cast("string"), F.lit("-"), F.col("role"))
    rows = t.turns.withColumn("src", src)
    members = rows.select(
        F.col("conv_id").alias("conversation_id"),
        F.concat("src", F.lit("__"), F.col("turn").cast("string")).alias("segment_id"),
        "start_us",
    )
    decisions = rows.select(
        F.col("src").alias("source_id"),
        F.expr("CASE WHEN conv_id div 2 % 2 = 0 THEN 'accepted' ELSE 'excluded' END").alias("status"),
    ).distinct()
    return tables.source_decision(members, decisions).select("conversation_id", "source_id", "start_us", "status")


@query(
    "legacy_asset_lookup",
    sql("conv", "SELECT conversation_id, date, CASE WHEN conversation_id % 3 = 0 THEN 'a-clip-' || conversation_id || '.ogg' ELSE '' END AS name FROM v_conv"),
)
def legacy_asset_lookup(t):
    assets = t.conv.filter("conversation_id % 3 <> 1").select(
        "date", F.expr("CASE WHEN conversation_id % 3 = 0 THEN 'a-clip-' || conversation_id || '.ogg' ELSE 'x-y.ogg' END").alias("name")
    )
    out = tables.legacy_asset(t.conv.select("conversation_id", "date"), assets)
    return out.select("conversation_id", "date", F.coalesce("name", F.lit("")).alias("name"))


REPORT_SQL = WER + f""", sg AS (SELECT scenario, system, doc_id, i, array_to_string(list_slice(h, i * {views.SEGMENT} + 1, i * {views.SEGMENT} + {views.SEGMENT}), ' ') AS text, ((doc_id + i) % 29) / 10.0 AS ratio
  FROM (SELECT scenario, system, doc_id, h, unnest(range(0, (len(h) - 1) // {views.SEGMENT} + 1)) AS i FROM n JOIN (SELECT DISTINCT scenario, doc_id FROM v_pairs) USING (scenario))),
v_texts AS (SELECT scenario || ' ' || system || ' ' || i AS doc_id, text FROM sg),
lp AS ({LOOP_SQL.format(w=words_of("text"), th=0.3)}),
sc AS (SELECT scenario, system, count(*) AS num_segments, count(*) FILTER (loop OR ratio > 2.4) AS repetition_segments,
  CAST(sum(CASE WHEN scenario = 'doc-7' THEN len({words_of("text")}) ELSE 0 END) AS BIGINT) AS hallucinated_words
  FROM sg JOIN lp ON lp.doc_id = scenario || ' ' || system || ' ' || i GROUP BY ALL)
SELECT scenario, system, printf('%.4f', dist / ref_words) AS wer, printf('%.4f', chars / ref_chars) AS cer,
  CASE WHEN system = 'dup11' THEN dist ELSE 0 END AS insertions, CASE WHEN system = 'drop7' THEN dist ELSE 0 END AS deletions,
  CASE WHEN system = 'sub13' THEN dist ELSE 0 END AS substitutions, ref_words, hyp_words, printf('%.3f', hyp_words / 4.0::DOUBLE / (ref_words / 2.5::DOUBLE)) AS rtf,
  printf('%.2f', hyp_words / 4.0::DOUBLE) AS processing_time, printf('%.2f', ref_words / 2.5::DOUBLE) AS audio_duration, repetition_segments, hallucinated_words, num_segments
FROM d JOIN sc USING (scenario, system)"""


@query("eval_report_csv", sql("pairs", REPORT_SQL))
def eval_report_csv(t):
    path = scratch_dir(t.spark, "report") + "/out"
    rows = C.full_report(C.score_pairs(t.pairs), views.pair_segments(t.pairs), views.pair_times(t.pairs), silent="doc-7")
    files.write_report(rows, path)
    back = t.spark.read.option("header", True).csv(path)
    counts = [c for c, digits in C.REPORT.items() if digits is None and c not in ("scenario", "system")]
    return back.withColumns({c: F.col(c).cast("bigint") for c in counts})


# Half of the segments are stored, the rest replaces some of them; then languages are set and rows removed.
@query(
    "stored_updates",
    sql("segments", """SELECT segment_id, CASE WHEN event_id % 3 = 0 OR event_id % 2 = 1 THEN speaker ELSE 'before' END AS speaker,
      CASE WHEN event_id % 11 = 0 THEN 'xx' ELSE language END AS language, end_us, (SELECT count(*) FROM v_segments WHERE event_id % 11 = 0) AS absent
      FROM v_segments WHERE event_id % 7 <> 0"""),
)
def stored_updates(t):
    rows = t.segments.select("segment_id", "speaker", "language", "end_us", "event_id")
    kept = ["segment_id", "speaker", "language", "end_us"]
    table = StoredTable(t.spark, scratch_dir(t.spark, "stored"), "segment_id string, speaker string, language string, end_us bigint", "segment_id")
    even = F.col("event_id") % 2 == 0
    table.replace(rows.where(even).withColumn("speaker", F.lit("before")).select(kept))
    table.replace(rows.where(~even | (F.col("event_id") % 3 == 0)).select(kept))
    some = rows.where("event_id % 11 = 0").select("segment_id", F.lit("xx").alias("language"))
    unknown = some.withColumn("segment_id", F.concat(F.lit("no-"), "segment_id"))
    _, absent = table.update(some.unionByName(unknown))
    table.remove(rows.where("event_id % 7 = 0").select("segment_id"))
    return table.read().crossJoin(F.broadcast(absent.agg(F.count("*").alias("absent"))))


@query(
    "batch_conversations",
    sql("segments", f"""WITH p AS (SELECT *, lag(end_us) OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS pe FROM v_segments WHERE processed_us IS NULL),
    s AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_us - pe > {int(GROUP * 1e6)} THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS sid FROM p),
    c AS (SELECT device_id, sid, count(*) AS n, ('0x' || substr(sha256(min_by(segment_id, (start_us, segment_id))), 1, 12))::BIGINT AS id FROM s GROUP BY ALL)
    SELECT id AS conversation_id, n AS n_segments, device_id, 0 AS still_pending FROM c"""),
)
def batch_conversations(t):
    path = scratch_dir(t.spark, "batch") + "/table"
    stored, acked = jobs.batch_conversations(t.spark, t.segments, path, 1, GROUP)
    left = acked.filter("processed_us IS NULL").agg(F.count("*").cast("int").alias("still_pending"))
    return stored.select("conversation_id", "n_segments", "device_id").join(F.broadcast(left))


@query(
    "batch_job_stats",
    sql("segments", f"""WITH p AS (SELECT *, lag(end_us) OVER (PARTITION BY device_id ORDER BY start_us, segment_id) AS pe FROM v_segments WHERE processed_us IS NULL)
    SELECT device_id, count(*) AS pending, CAST(sum(CASE WHEN pe IS NULL OR start_us - pe > {int(GROUP * 1e6)} THEN 1 ELSE 0 END) AS BIGINT) AS conversations, round(sum((end_us - start_us) / 1e6), 4) AS seconds FROM p GROUP BY device_id"""),
)
def batch_job_stats(t):
    from palaver.operators.sessions import group_conversations

    c = group_conversations(t.segments.filter("processed_us IS NULL"), max_gap_s=GROUP)
    return c.groupBy("device_id").agg(
        F.sum("n_segments").alias("pending"),
        F.count("*").alias("conversations"),
        F.round(F.sum("speech_us") / 1e6, 4).alias("seconds"),
    )


WEEKLY = OCC + """, rc AS (SELECT * FROM cd WHERE occurrences >= 3 AND days >= 2), gl AS (SELECT term_key, CAST(1 AS BIGINT) AS occurrences FROM (SELECT DISTINCT term_key FROM oo WHERE conversation_id % 9 = 0))
SELECT coalesce(gl.term_key, rc.term_key) AS term_key, coalesce(gl.occurrences, 0) + coalesce(rc.occurrences, 0) AS occurrences FROM gl FULL JOIN rc ON rc.term_key = gl.term_key"""


@query("glossary_weekly", sql("conv", WEEKLY))
def glossary_weekly(t):
    from palaver.operators.glossary import term_occurrences

    conv = recent(t)
    known = term_occurrences(conv.filter("conversation_id % 9 = 0")).select("term_key").distinct()
    glossary = known.select("term_key", F.lit(1).cast("bigint").alias("occurrences"), F.lit("2024-01-01").alias("last_seen"))
    out, _ = jobs.glossary_weekly(conv, glossary)
    return out.select("term_key", "occurrences")


@query("asr_eval")
def asr_eval(t):
    return jobs.accuracy_report(t.pairs)


@query(
    "dashboard",
    sql("conv segments", f"""WITH d AS (SELECT * FROM v_conv WHERE date = '2024-01-03'), p AS (SELECT * FROM v_conv WHERE {since(7)} AND is_pair), q AS ({QD}),
    b AS (SELECT round(sum((end_us - start_us) / 1e6) / 3600.0, 6) AS h, count(*) AS n FROM v_segments WHERE processed_us IS NULL)
    SELECT 'day' AS panel, 'total' AS metric, count(*)::DOUBLE AS value FROM d UNION ALL SELECT 'day', 'pair', count(*) FROM d WHERE is_pair
    UNION ALL SELECT 'day', 'self_talk', count(*) FROM d WHERE source_type = 'self_talk' UNION ALL SELECT 'day', 'media', count(*) FROM d WHERE source_type = 'media_or_unknown'
    UNION ALL SELECT 'pair', 'total', count(*) FROM p UNION ALL SELECT 'pair', 'minutes', coalesce(round(sum(duration_seconds) / 60.0, 1), 0) FROM p
    UNION ALL SELECT 'pair', 'avg_seconds', coalesce(round(avg(duration_seconds), 1), 0) FROM p UNION ALL SELECT 'pair', 'good', count(*) FROM p WHERE quality = 'good'
    UNION ALL SELECT 'pair', 'tense', count(*) FROM p WHERE quality = 'tense' UNION ALL SELECT 'quality', quality, n FROM q
    UNION ALL SELECT 'backlog', 'total_hours', h FROM b UNION ALL SELECT 'backlog', 'segment_count', n FROM b"""),
)
def dashboard(t):
    out = jobs.dashboard(t.conv, backlog_rows(t), "2024-01-03", as_of(t))
    return out.withColumn("value", F.round("value", 6))
