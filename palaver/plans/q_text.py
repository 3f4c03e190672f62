"""Registered queries: text, language, term, label and time functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palaver.functions import idents as I
from palaver.functions import labels as B
from palaver.functions import quality as Q
from palaver.functions import romanize as R
from palaver.functions import text as X
from palaver.functions import timefmt as D
from palaver.operators.scoring import filter_conversations, score_texts
from palaver.operators.scoring import filter_stats as count_filtered
from palaver.plans.oracle import sql, time_of, trim_of, words_of
from palaver.plans.q_dashboard import SIG, echo_sql, policy_sql
from palaver.plans.registry import query

LOW = f"lower({trim_of('text')})"
LEAK = "(" + " OR ".join(f"contains({{c}}, '{p}')" for p in Q.PROMPT_PATTERNS) + ")"
MEDIA = "(" + " OR ".join(f"ends_with({{c}}, '{s}')" for s in dict.fromkeys(Q.MEDIA_SIGNATURES)) + ")"
FILLER_LIST = "[" + ", ".join(f"'{f}'" for f in Q.FILLERS) + "]"


@query("word_count", sql("texts", "SELECT doc_id, word_count FROM v_texts"))
def word_count(t):
    return t.texts.select("doc_id", "word_count")


@query("prompt_leak", sql("texts", f"SELECT doc_id, {LEAK.format(c=LOW)} AS leak FROM v_texts"))
def prompt_leak(t):
    return t.texts.select("doc_id", Q.prompt_leak(F.col("text")).alias("leak"))


@query(
    "media_artifact",
    sql("texts", f"SELECT doc_id, {MEDIA.format(c=LOW)} AS artifact FROM v_texts"),
)
def media_artifact(t):
    return t.texts.select("doc_id", Q.media_artifact(F.col("text")).alias("artifact"))


REPEATED = f"""w AS (SELECT doc_id, unnest({words_of(LOW)}) AS w, generate_subscripts({words_of(LOW)}, 1) AS p FROM v_texts),
c AS (SELECT doc_id, w, count(*) AS n, min(p) AS p FROM w WHERE length(w) > 2 GROUP BY doc_id, w HAVING count(*) >= 3),
r AS (SELECT doc_id, min_by(w, p) AS w, min_by(n, p) AS n FROM c GROUP BY doc_id)"""


@query(
    "repetitive_words",
    sql("texts", f"WITH {REPEATED} SELECT doc_id, coalesce(w, '') AS word FROM v_texts LEFT JOIN r USING (doc_id)"),
)
def repetitive_words(t):
    return t.texts.select("doc_id", F.coalesce(Q.repetitive_word(F.col("text")), F.lit("")).alias("word"))


PHRASES = f"""ph AS (SELECT doc_id, text, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws) - 2)]) AS p,
  unnest(range(1, len(ws) - 2)) AS i FROM (SELECT doc_id, {LOW} AS text, {words_of(LOW)} AS ws FROM v_texts @where)),
pc AS (SELECT doc_id, p, i, (length(text) - length(replace(text, p, ''))) // length(p) AS n FROM ph),
pr AS (SELECT doc_id, min_by(p, i) AS p, min_by(n, i) AS n FROM pc WHERE n >= 3 GROUP BY doc_id)"""


@query(
    "repetitive_phrase",
    sql("texts", f"WITH {REPEATED}, {PHRASES.replace('@where', '')} SELECT doc_id, coalesce(pr.p, '') AS phrase FROM v_texts LEFT JOIN pr USING (doc_id)"),
)
def repetitive_phrase(t):
    return t.texts.select("doc_id", F.coalesce(Q.repetitive_phrase(F.col("text")), F.lit("")).alias("phrase"))


SHORT = f"(word_count < 3 AND (len(list_filter({words_of(LOW)}, lambda x: NOT list_contains({FILLER_LIST}, x))) = 0 OR word_count = 0))"


@query("too_short_filler", sql("texts", f"SELECT doc_id, {SHORT} AS short FROM v_texts"))
def too_short_filler(t):
    return t.texts.select("doc_id", Q.too_short_filler(F.col("text"), F.col("word_count")).alias("short"))


@query(
    "subset_fillers",
    sql("texts", f"SELECT doc_id, len(list_filter({words_of(LOW)}, lambda x: NOT list_contains({FILLER_LIST}, x))) = 0 AS fillers_only FROM v_texts"),
)
def subset_fillers(t):
    f = F.array(*[F.lit(x) for x in Q.FILLERS])
    only = F.size(F.array_except(X.words(Q.normal(F.col("text"))), f)) == 0
    return t.texts.select("doc_id", only.alias("fillers_only"))


SCORED = f"""WITH {REPEATED}, {PHRASES.replace('@where', 'WHERE doc_id NOT IN (SELECT doc_id FROM r)')},
fl AS (SELECT v_texts.doc_id, low_confidence, confidence, word_count, {LOW} AS low, {SHORT} AS fill,
         {LEAK.format(c=LOW)} AS leak, {MEDIA.format(c=LOW)} AS ends, r.w, r.n AS wn, pr.p AS ph, pr.n AS pn
       FROM v_texts LEFT JOIN r USING (doc_id) LEFT JOIN pr USING (doc_id)),
fb AS (SELECT *, NOT leak AND ends AS media, NOT leak AND NOT ends AND word_count >= 3 AS clean,
         low_confidence AND word_count < 5 AS low_short FROM fl),
fc AS (SELECT *, clean AND w IS NOT NULL AS rw, clean AND w IS NULL AND ph IS NOT NULL AS rp,
         media AND word_count <= 2 AND low IN ({', '.join(f"'{s}'" for s in dict.fromkeys(Q.MEDIA_SIGNATURES))}) AS short_media FROM fb),
fd AS (SELECT *, NOT leak AND NOT ends AND NOT rw AND NOT rp AND fill AS too_short FROM fc),
sc AS (SELECT doc_id, leak OR media OR rw OR rp OR too_short OR low_short AS is_garbage, media AS is_media_artifact, leak AS is_prompt_leak,
  rw OR rp AS is_repetitive, too_short AS is_too_short,
  CASE WHEN leak OR media OR rw OR rp OR too_short OR low_short THEN 0.0 ELSE round(1.0
    - CASE WHEN low_confidence THEN 0.3 ELSE 0.0 END - CASE WHEN word_count < 3 THEN 0.2 ELSE 0.0 END
    - CASE WHEN confidence < 0.8 THEN 0.2 ELSE 0.0 END, 6) END::DOUBLE AS score,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN leak THEN 'prompt_leak' END, CASE WHEN media THEN 'media_artifact' END,
    CASE WHEN short_media THEN 'short_media_phrase' END, CASE WHEN rw THEN 'repetitive(' || w || 'x' || wn || ')' END,
    CASE WHEN rp THEN 'phrase_repetition(' || ph || 'x' || pn || ')' END, CASE WHEN too_short THEN 'too_short_filler' END,
    CASE WHEN low_short THEN 'low_confidence_short' END], lambda x: x IS NOT NULL), '; '), ''), 'ok') AS reason FROM fd)
"""


def scored(t):
    cols = ["is_garbage", "is_media_artifact", "is_prompt_leak", "is_repetitive", "is_too_short"]
    return score_texts(t.texts).select("doc_id", *cols, F.round("score", 6).alias("score"), "reason")


@query("quality_score", sql("texts", SCORED + "SELECT * FROM sc"))
def quality_score(t):
    return scored(t)


@query(
    "conversation_filter",
    sql("texts", SCORED + """SELECT doc_id // 5 AS conversation, round(avg(CASE WHEN is_garbage THEN 1.0 ELSE 0.0 END), 6) AS garbage_fraction,
    round(1 - avg(CASE WHEN is_garbage THEN 1.0 ELSE 0.0 END), 6) AS score,
    avg(CASE WHEN is_garbage THEN 1.0 ELSE 0.0 END) >= 0.7 AS discard, bool_or(is_media_artifact) AS any_media FROM sc WHERE doc_id >= 0 GROUP BY 1"""),
)
def conversation_filter(t):
    rows = scored(t).filter("doc_id >= 0").withColumn("conversation", F.expr("doc_id div 5"))
    return filter_conversations(rows, "conversation").withColumns(
        {"garbage_fraction": F.round("garbage_fraction", 6), "score": F.round("score", 6)}
    )


@query(
    "filter_stats",
    sql("texts", SCORED + """SELECT count(*) AS segments_processed, count(*) FILTER (is_garbage) AS segments_filtered,
    count(*) FILTER (is_media_artifact) AS media_artifacts, count(*) FILTER (is_prompt_leak) AS prompt_leaks,
    count(*) FILTER (is_repetitive) AS repetitive FROM sc"""),
)
def filter_stats(t):
    return count_filtered(scored(t))


LOOP_SQL = """WITH c AS (SELECT doc_id, array_to_string({w}, '') AS s FROM v_texts),
ch AS (SELECT doc_id, len, unnest(cs) AS c, generate_subscripts(cs, 1) AS p FROM (SELECT doc_id, length(s) AS len, string_split(s, '') AS cs FROM c WHERE length(s) >= 12)),
w AS (SELECT doc_id, len, c AS g1, c || lead(c, 1) OVER o AS g2, c || lead(c, 1) OVER o || lead(c, 2) OVER o AS g3,
  c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o AS g4 FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
m AS (SELECT doc_id, len, 1 AS n, count(*) AS k FROM w GROUP BY doc_id, len, g1
  UNION ALL SELECT doc_id, len, 2, count(*) FROM w WHERE g2 IS NOT NULL GROUP BY doc_id, len, g2
  UNION ALL SELECT doc_id, len, 3, count(*) FROM w WHERE g3 IS NOT NULL GROUP BY doc_id, len, g3
  UNION ALL SELECT doc_id, len, 4, count(*) FROM w WHERE g4 IS NOT NULL GROUP BY doc_id, len, g4),
h AS (SELECT doc_id, bool_or(k >= CASE WHEN n = 1 THEN 8 ELSE 5 END AND k * n / len > {th}) AS hit FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(hit, false) AS loop FROM v_texts LEFT JOIN h USING (doc_id)"""


@query("repetition_loop", sql("texts", LOOP_SQL.format(w=words_of("text"), th=0.4)))
def repetition_loop(t):
    return t.texts.select("doc_id", Q.repetition_loop(F.col("text")).alias("loop"))


@query("language_policy", sql("texts", f"SELECT doc_id, coalesce({policy_sql('text', 'lang')}, '') AS violation FROM v_texts"))
def language_policy(t):
    return t.texts.select(
        "doc_id", F.coalesce(Q.language_policy(F.col("text"), F.col("lang")), F.lit("")).alias("violation")
    )


@query("prompt_echo", sql("texts", f"SELECT doc_id, {echo_sql('text')} AS echo FROM v_texts"))
def prompt_echo(t):
    return t.texts.select("doc_id", Q.prompt_echo(F.col("text")).alias("echo"))


@query("signature_flag", sql("texts", f"SELECT doc_id, {SIG.format(c='lower(text)')} AS flag FROM v_texts"))
def signature_flag(t):
    return t.texts.select("doc_id", Q.signature_flag(F.col("text")).alias("flag"))


@query(
    "assess_status",
    sql("texts", "WITH lp AS (" + LOOP_SQL.format(w=words_of("text"), th=0.4) + f""")
    SELECT doc_id, CASE WHEN {echo_sql('text')} THEN 'suspected_prompt_echo'
      WHEN {policy_sql('text', "CASE WHEN lang = 'en' THEN 'en' ELSE '' END")} IS NOT NULL THEN {policy_sql('text', "CASE WHEN lang = 'en' THEN 'en' ELSE '' END")}
      WHEN {trim_of('text')} = '' THEN 'rejected_silence'
      WHEN loop OR ({SIG.format(c='lower(text)')} AND low_confidence) THEN 'suspected_hallucination'
      WHEN low_confidence THEN 'low_confidence' ELSE 'ok' END AS status
    FROM v_texts JOIN lp USING (doc_id)"""),
)
def assess_status(t):
    lang = F.when(F.col("lang") == "en", "en").otherwise("")
    # One recognition segment per text carries its log probability.
    segs = F.array(
        F.struct(
            F.lit(0.1).alias("no_speech_prob"),
            F.when(F.col("low_confidence"), -2.0).otherwise(-0.1).alias("avg_logprob"),
            F.lit(1.0).alias("compression_ratio"),
        )
    )
    rows = t.texts.withColumn("_loop", Q.repetition_loop(F.col("text")))
    status = Q.assess_status(F.col("text"), lang, Q.any_low_segment(segs), F.col("_loop"))
    return rows.select("doc_id", status.alias("status"))


@query(
    "low_confidence",
    sql("segments", "SELECT segment_id, no_speech_prob > 0.6 OR avg_logprob < -1.0 AS low FROM v_segments"),
)
def low_confidence(t):
    return t.segments.select(
        "segment_id", Q.low_confidence(F.col("no_speech_prob"), F.col("avg_logprob")).alias("low")
    )


TOK = "[" + ", ".join(f"'{x}'" for x in Q.HINDI_TOKENS) + "]"
LIVE_TOK = " OR ".join(f"contains(lower(text), '{x}')" for x in Q.HINDI_TOKENS if x not in ("ye", "thi"))


@query(
    "correct_language",
    sql("texts", rf"""WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'ru' ELSE lang END AS det FROM v_texts)
    SELECT doc_id, CASE WHEN det = 'ru' AND NOT regexp_matches(text, '[\x{{0400}}-\x{{04FF}}]') THEN
      CASE WHEN regexp_matches(text, '[\x{{0900}}-\x{{097F}}]') OR list_has_any({words_of('lower(text)')}, {TOK}) THEN 'hi' ELSE 'en' END ELSE det END AS batch_language,
      CASE WHEN det = 'ru' AND NOT regexp_matches(text, '[\x{{0400}}-\x{{04FF}}]') THEN
      CASE WHEN regexp_matches(text, '[\x{{0900}}-\x{{097F}}]') OR {LIVE_TOK} THEN 'hi' ELSE 'en' END ELSE det END AS live_language FROM d"""),
)
def correct_language(t):
    det = F.when(F.col("doc_id") % 3 == 0, "ru").otherwise(F.col("lang"))
    text = F.col("text")
    return t.texts.select(
        "doc_id",
        Q.correct_language(text, det).alias("batch_language"),
        Q.correct_language(text, det, substring=True).alias("live_language"),
    )


@query(
    "contains_devanagari",
    sql("texts", r"SELECT doc_id, regexp_matches(text, '[\x{0900}-\x{097F}]') AS hit FROM v_texts"),
)
def contains_devanagari(t):
    return t.texts.select("doc_id", Q.contains_devanagari(F.col("text")).alias("hit"))


# Splitting at everything that is no letter, mark, digit or underscore is the boundary rule itself.
TERMS_SQL = r"""list_concat(regexp_extract_all(text, '[\x{0900}-\x{097F}]+'),
  list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{2,6}')))"""


@query(
    "devanagari_terms",
    sql("texts", f"SELECT doc_id, array_to_string({TERMS_SQL}, ' ') AS terms, CAST(len({TERMS_SQL}) AS BIGINT) AS n FROM v_texts"),
)
def devanagari_terms(t):
    terms = R.potential_terms(F.col("text"))
    return t.texts.select(
        "doc_id", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("bigint").alias("n")
    )


def roman_sql(text: str) -> str:
    one = {k: v for k, v in R.ROMAN.items() if len(v) == 1}
    gone = [k for k, v in R.ROMAN.items() if not v]
    out = f"translate({text}, '{''.join(one) + ''.join(gone)}', '{''.join(one.values())}')"
    for k, v in R.ROMAN.items():
        if len(v) > 1:
            out = f"replace({out}, '{k}', '{v}')"
    return out


def key_sql(text: str) -> str:
    one = {k: v for k, v in R.PLAIN.items() if len(v) == 1}
    out = trim_of(f"lower({roman_sql(text)})")
    out = f"translate({out}, '{''.join(one)}', '{''.join(one.values())}')"
    for k, v in R.PLAIN.items():
        if len(v) > 1:
            out = f"replace({out}, '{k}', '{v}')"
    return f"array_to_string({words_of(out)}, ' ')"


@query("transliterate_simple", sql("texts", f"SELECT doc_id, {roman_sql('text')} AS roman FROM v_texts"))
def transliterate_simple(t):
    return t.texts.select("doc_id", R.romanize(F.col("text")).alias("roman"))


@query("normalize_for_matching", sql("texts", f"SELECT doc_id, {key_sql('text')} AS key FROM v_texts"))
def normalize_for_matching(t):
    return t.texts.select("doc_id", R.match_key(F.col("text")).alias("key"))


WORD_ROWS = "wd AS (SELECT DISTINCT unnest({w}) AS term FROM v_texts)".format(w=words_of("lower(text)"))


def word_rows(t):
    return t.texts.select(F.explode(X.words(F.lower("text"))).alias("term")).distinct()


COMMON_IN = ", ".join(f"'{w}'" for w in R.COMMON_WORDS)


@query(
    "is_common_word",
    sql("texts", f"WITH {WORD_ROWS} SELECT term, {trim_of('lower(term)')} IN ({COMMON_IN}) OR {key_sql('term')} IN ({COMMON_IN}) AS common FROM wd"),
)
def is_common_word(t):
    return word_rows(t).select("term", R.is_common(F.col("term")).alias("common"))


VALID_SQL = """(length(term) >= 2 AND list_max([len(list_filter(string_split(term, ''), lambda d: d = c)) FOR c IN list_distinct(string_split(term, ''))]) <= length(term) * 0.5
  AND NOT len([i FOR i IN range(1, length(term) - 1) IF substring(term, i, 1) = substring(term, i + 1, 1) AND substring(term, i, 1) = substring(term, i + 2, 1)]) > 0)"""


@query("is_valid_term", sql("texts", f"WITH {WORD_ROWS} SELECT term, {VALID_SQL} AS valid FROM wd"))
def is_valid_term(t):
    return word_rows(t).select("term", R.is_valid_term(F.col("term")).alias("valid"))


CONTEXT = """WITH a AS (SELECT doc_id, text, instr(lower(text), 'the') AS pos FROM v_texts),
b AS (SELECT *, greatest(pos - 51, 0) AS s, least(pos - 1 + 3 + 50, length(text)) AS e FROM a),
c AS (SELECT *, substring(text, s + 1, e - s) AS raw FROM b),
d AS (SELECT *, CASE WHEN s > 0 THEN substring(raw, instr(raw, ' ') + 1) ELSE raw END AS l FROM c),
f AS (SELECT *, CASE WHEN e < length(text) THEN substring(l, 1, length(l) - CASE WHEN instr(reverse(l), ' ') > 0 THEN instr(reverse(l), ' ') ELSE 1 END) ELSE l END AS r FROM d)
SELECT doc_id, CASE WHEN pos > 0 THEN {r} ELSE '' END AS context FROM f"""


@query("extract_context", sql("texts", CONTEXT.format(r=trim_of("r"))))
def extract_context(t):
    return t.texts.select("doc_id", X.extract_context(F.col("text"), F.lit("the")).alias("context"))


CMD = [
    ("note", r"^note[:\s]+(.+)$"), ("note", r"^quick note[:\s]+(.+)$"), ("note", r"^add note[:\s]+(.+)$"),
    ("reminder", r"^reminder[:\s]+(.+)$"), ("reminder", r"^remind me (?:to )?(.+)$"),
    ("todo", r"^todo[:\s]+(.+)$"), ("todo", r"^to.do[:\s]+(.+)$"), ("todo", r"^add (?:a )?todo[:\s]+(.+)$"),
]
CMD_TAG = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in CMD) + " ELSE '' END"
CMD_TXT = "CASE " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN {trim_of(f'''regexp_extract(low, '{p}', 1)''')}" for _, p in CMD) + " ELSE '' END"


@query(
    "voice_command",
    sql("texts", f"SELECT doc_id, {CMD_TAG} AS tag, {CMD_TXT} AS note FROM (SELECT doc_id, {LOW} AS low FROM v_texts)"),
)
def voice_command(t):
    tag, note = X.voice_command(F.col("text"))
    return t.texts.select(
        "doc_id", F.coalesce(tag, F.lit("")).alias("tag"), F.coalesce(note, F.lit("")).alias("note")
    )


SLUG = f"regexp_replace(substring(regexp_replace(regexp_replace(translate(lower(text), '{X.FOLD_FROM}', '{X.FOLD_TO}'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '')"


@query("slug", sql("texts", f"SELECT doc_id, coalesce(nullif({SLUG}, ''), 'conversation') AS slug FROM v_texts"))
def slug(t):
    return t.texts.select("doc_id", X.slug(F.col("text")).alias("slug"))


@query(
    "format_turn",
    sql("turns", f"SELECT segment_id, '[' || {time_of('start_us')} || '] ' || upper(speaker[1]) || lower(speaker[2:]) || ': ' || text AS line FROM v_turns"),
)
def format_turn(t):
    return t.turns.select(
        "segment_id", X.format_turn(F.col("start_us"), F.col("speaker"), F.col("text")).alias("line")
    )


@query(
    "plausible_cleanup",
    sql("texts", f"""WITH c AS (SELECT doc_id, text, substring(text, 1, length(text) * (doc_id % 7) // 6) AS cleaned FROM v_texts WHERE doc_id >= 0)
    SELECT doc_id, CASE WHEN {trim_of('cleaned')} <> '' AND length({trim_of('cleaned')}) / greatest(length({trim_of('text')}), 1) BETWEEN 0.25 AND 2.5 THEN {trim_of('cleaned')} ELSE text END AS kept FROM c"""),
)
def plausible_cleanup(t):
    n = F.expr("CAST(length(text) * (doc_id % 7) div 6 AS INT)")
    rows = t.texts.filter("doc_id >= 0").withColumn("cleaned", F.substring(F.col("text"), F.lit(1), n))
    return rows.select("doc_id", Q.plausible_cleanup(F.col("text"), F.col("cleaned")).alias("kept"))


# A model answer made from the row: prose around an object, a broken one, or none.
ANSWER = """CASE conversation_id % 4 WHEN 0 THEN 'Sure: {"source_type": "self_talk", "is_pair": true, "quality": "good", "summary": "s' || conversation_id || '"} done'
  WHEN 1 THEN '{"quality": "tense"}' WHEN 2 THEN 'no idea' ELSE 'x {"summary": "only"} y' END"""


@query(
    "extract_json_object",
    sql("conv", f"""WITH a AS (SELECT *, regexp_extract({ANSWER}, '\\{{.*\\}}', 0, 's') AS j FROM v_conv)
    SELECT conversation_id, CASE WHEN j = '' THEN source_type ELSE coalesce(json_extract_string(nullif(j, ''), '$.source_type'), source_type) END AS source_type,
    CASE WHEN j = '' THEN is_pair ELSE coalesce(json_extract_string(nullif(j, ''), '$.is_pair') = 'true', false) END AS is_pair,
    CASE WHEN j = '' THEN 'not_applicable' ELSE coalesce(json_extract_string(nullif(j, ''), '$.quality'), 'neutral') END AS quality,
    CASE WHEN j = '' THEN '' ELSE coalesce(json_extract_string(nullif(j, ''), '$.summary'), '') END AS summary FROM a"""),
)
def extract_json_object(t):
    label = F.coalesce(
        B.parse_label(F.expr(ANSWER), F.col("source_type")),
        B.fallback_label(F.col("source_type"), F.col("participants")),
    )
    return t.conv.select("conversation_id", label.alias("l")).select("conversation_id", "l.*")


@query(
    "fallback_classify",
    sql("conv", "SELECT conversation_id, source_type, is_pair, 'not_applicable' AS quality, '' AS summary FROM v_conv"),
)
def fallback_classify(t):
    label = B.fallback_label(F.col("source_type"), F.col("participants"))
    return t.conv.select("conversation_id", label.alias("l")).select("conversation_id", "l.*")


@query(
    "json_decode",
    sql("", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS high FROM events"""),
)
def json_decode(t):
    j = F.from_json("props", "k bigint")
    return t.raw("events").select("event_id", j["k"].alias("k"), (j["k"] > 50).alias("high"))


@query(
    "schema_align",
    sql("conv", "SELECT conversation_id, transcript AS raw_transcript, transcript AS cleaned_transcript, '' AS slug FROM v_conv"),
)
def schema_align(t):
    from palaver.schemas import CONVERSATIONS, align

    old = t.conv.select("conversation_id", "date", "transcript")
    full = align(old, CONVERSATIONS, {"raw_transcript": "transcript", "cleaned_transcript": "transcript"})
    return full.select("conversation_id", "raw_transcript", "cleaned_transcript", F.coalesce("slug", F.lit("")).alias("slug"))


@query(
    "strip_unintelligible",
    sql("turns", "SELECT conv_id, string_agg(CASE WHEN turn % 3 <> 1 THEN replace(text, chr(10), ' ') END, ' ' ORDER BY turn) AS reference FROM v_turns GROUP BY conv_id"),
)
def strip_unintelligible(t):
    from palaver.operators.transcripts import joined, ordered_parts

    line = F.when(F.col("turn") % 3 == 1, "[[UNINTELLIGIBLE]]").otherwise(F.replace("text", F.lit("\n"), F.lit(" ")))
    parts = ordered_parts(t.turns, ["conv_id"], ["start_us", "segment_id"], line=line)
    return parts.select("conv_id", X.strip_unintelligible(joined("line")).alias("reference"))


@query(
    "speaker_name_valid",
    sql("", r"""WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT replace(regexp_replace(c_name, '[#0-9]+', '  '), 'C', ' o''C') FROM customer),
    s AS (SELECT name, trim(regexp_replace(name, ' +', ' ', 'g')) AS n FROM n)
    SELECT name, n <> '' AND length(n) <= 48 AND regexp_full_match(n, '[\p{L}\p{M} ''-]+') AS valid, lower(n) AS canonical FROM s"""),
)
def speaker_name_valid(t):
    c = t.raw("customer").select(F.col("c_name").alias("name"))
    odd = c.select(
        F.replace(F.regexp_replace("name", "[#0-9]+", "  "), F.lit("C"), F.lit(" o'C")).alias("name")
    )
    return c.unionByName(odd).select(
        "name",
        X.speaker_name_valid(F.col("name")).alias("valid"),
        X.canonical_name(F.col("name")).alias("canonical"),
    )


@query(
    "hash_id48",
    sql("segments", "SELECT segment_id, ('0x' || substr(sha256(segment_id), 1, 12))::BIGINT AS id FROM v_segments"),
)
def hash_id48(t):
    return t.segments.select("segment_id", I.hash_id48(F.col("segment_id")).alias("id"))


@query(
    "csv_row_id",
    sql("turns", r"""SELECT segment_id, 'csv-' || sha256('["' || start_us || '", "' || end_us || '", "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '", "' || speaker || '", "' || language || '"]') AS id FROM v_turns"""),
)
def csv_row_id(t):
    return t.turns.select(
        "segment_id",
        I.csv_row_id(
            F.col("start_us").cast("string"), F.col("end_us").cast("string"), F.col("text"), F.col("speaker"), F.col("language")
        ).alias("id"),
    )


@query(
    "local_date",
    sql("segments", f"SELECT segment_id, date, {time_of('start_us')} AS time FROM v_segments"),
)
def local_date(t):
    return t.segments.select("segment_id", "date", D.local_time(F.col("start_us")).alias("time"))


@query(
    "parse_canonical_date",
    sql("segments", """WITH d AS (SELECT segment_id, CASE event_id % 4 WHEN 0 THEN date WHEN 1 THEN replace(date, '-0', '-') WHEN 2 THEN replace(date, '2024-01', '2024-13') ELSE replace(date, '-', '/') END AS raw FROM v_segments)
    SELECT segment_id, raw, coalesce(CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(raw AS DATE) IS NOT NULL THEN raw END, '') AS parsed FROM d""".replace("\\\\d", "\\d")),
)
def parse_canonical_date(t):
    raw = F.expr(
        "CASE event_id % 4 WHEN 0 THEN date WHEN 1 THEN replace(date, '-0', '-') "
        "WHEN 2 THEN replace(date, '2024-01', '2024-13') ELSE replace(date, '-', '/') END"
    )
    d = D.parse_canonical_date(F.col("raw")).cast("string")
    return t.segments.select("segment_id", raw.alias("raw")).withColumn("parsed", F.coalesce(d, F.lit("")))


@query(
    "duration",
    sql("segments", "SELECT segment_id, (end_us - start_us) / 1e6 AS seconds, (end_us - start_us) // 1000 AS millis FROM v_segments"),
)
def duration(t):
    s, e = F.col("start_us"), F.col("end_us")
    return t.segments.select("segment_id", D.duration_s(s, e).alias("seconds"), D.duration_ms(s, e).alias("millis"))


@query(
    "format_duration",
    sql("segments", """WITH s AS (SELECT segment_id, CAST(floor(value * 60 + 0.5) AS BIGINT) AS s FROM v_segments)
    SELECT segment_id, CASE WHEN s < 60 THEN s || 's' WHEN s % 60 > 0 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 60 || 'm' END AS short,
    CASE WHEN s // 3600 > 0 AND s % 3600 // 60 > 0 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s // 3600 > 0 THEN s // 3600 || 'h'
      WHEN s % 3600 // 60 > 0 THEN s % 3600 // 60 || 'm' ELSE s || 's' END AS hm FROM s"""),
)
def format_duration(t):
    s = F.col("value") * 60
    return t.segments.select(
        "segment_id",
        D.format_duration(s).alias("short"),
        D.format_hours_minutes(F.floor(s + 0.5)).alias("hm"),
    )


@query(
    "format_time_12h",
    sql("segments", f"""WITH x AS (SELECT segment_id, {time_of('start_us')} AS hms FROM v_segments)
    SELECT segment_id, CASE WHEN CAST(hms[1:2] AS INT) % 12 = 0 THEN 12 ELSE CAST(hms[1:2] AS INT) % 12 END || ':' || hms[4:5] || CASE WHEN CAST(hms[1:2] AS INT) >= 12 THEN ' PM' ELSE ' AM' END AS t FROM x"""),
)
def format_time_12h(t):
    return t.segments.select("segment_id", D.format_time_12h(D.local_time(F.col("start_us"))).alias("t"))


@query(
    "relative_day",
    sql("conv", """WITH x AS (SELECT conversation_id, CAST(date AS DATE) AS d, (SELECT CAST(max(date) AS DATE) FROM v_conv) - CAST(date AS DATE) AS n FROM v_conv)
    SELECT conversation_id, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN n || ' days ago' ELSE strftime(d, '%a, %b %-d') END AS label FROM x"""),
)
def relative_day(t):
    from palaver.plans.q_dashboard import as_of

    return t.conv.select("conversation_id", D.relative_day(F.col("date"), F.lit(as_of(t))).alias("label"))


@query(
    "shift_offset",
    sql("segments", "SELECT segment_id, start_us + 500000 AS core_start_us, start_us + CAST(round((event_id % 16000) * 1e6 / 16000) AS BIGINT) AS word_us FROM v_segments"),
)
def shift_offset(t):
    s = F.col("start_us")
    return t.segments.select(
        "segment_id",
        D.shift_offset(s, F.lit(8000), 16000).alias("core_start_us"),
        D.shift_offset(s, F.col("event_id") % 16000, 16000).alias("word_us"),
    )


@query(
    "midpoint_time",
    sql("segments", "SELECT segment_id, start_us + (end_us - start_us) // 2 AS mid_us FROM v_segments"),
)
def midpoint_time(t):
    return t.segments.select("segment_id", D.midpoint_us(F.col("start_us"), F.col("end_us")).alias("mid_us"))


@query(
    "distance_to_now",
    sql("segments", """WITH x AS (SELECT segment_id, ((SELECT max(start_us) FROM v_segments) - start_us) // 1000000 AS s FROM v_segments)
    SELECT segment_id, CASE WHEN s // 86400 > 0 THEN s // 86400 || 'd ago' WHEN s // 3600 > 0 THEN s // 3600 || 'h ago' WHEN s // 60 > 0 THEN s // 60 || 'm ago' ELSE 'just now' END AS label FROM x"""),
)
def distance_to_now(t):
    now = t.segments.agg(F.max("start_us").alias("now"))
    return t.segments.join(F.broadcast(now)).select(
        "segment_id", D.distance_to_now(F.col("start_us"), F.col("now")).alias("label")
    )


@query(
    "compact_number",
    sql("", "SELECT o_orderkey, CASE WHEN v >= 1000000 THEN (v + 50000) // 1000000 || '.' || (v + 50000) // 100000 % 10 || 'M' WHEN v >= 1000 THEN (v + 50) // 1000 || '.' || (v + 50) // 100 % 10 || 'K' ELSE CAST(v AS VARCHAR) END AS label FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 9) AS v FROM orders)"),
)
def compact_number(t):
    v = F.floor("o_totalprice").cast("bigint") * (F.col("o_orderkey") % 9)
    return t.raw("orders").select("o_orderkey", X.compact_number(v).alias("label"))
