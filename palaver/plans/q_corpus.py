"""Registered queries: glossary, search, accuracy scoring and quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.functions import evaltext as E
from palaver.functions.text import FOLD_FROM, FOLD_TO, word_count, words
from palaver.operators import accuracy as C
from palaver.operators import activity as A
from palaver.operators import glossary as G
from palaver.operators import lookups as L
from palaver.operators import search as R
from palaver.operators.quota import rolling_quota
from palaver.operators.textindex import TextIndex
from palaver.plans.oracle import sql, words_of
from palaver.plans.q_dashboard import as_of, since
from palaver.plans.q_text import COMMON_IN, TERMS_SQL, VALID_SQL, key_sql, roman_sql
from palaver.plans.registry import query
from palaver.session import scratch_dir

SOURCES = "source_type IN ('live_conversation', 'self_talk')"
LIST = TERMS_SQL.replace("text", "transcript")
OCC = f"""WITH tr AS (SELECT conversation_id, date, transcript, {LIST} AS ts FROM v_conv WHERE {since(30)} AND {SOURCES}),
tx AS (SELECT conversation_id, date, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM tr),
oc AS (SELECT conversation_id, date, term, count(*) AS n, min(pos) AS pos, {key_sql('term')} AS term_key FROM tx WHERE length(term) >= 2 GROUP BY ALL),
oo AS (SELECT *, (-(CAST(date AS DATE) - DATE '1970-01-01'), conversation_id, pos) AS o FROM oc
  WHERE {VALID_SQL} AND NOT (lower(term) IN ({COMMON_IN}) OR term_key IN ({COMMON_IN}))),
cd AS (SELECT term_key, min_by(term, o) AS term, CAST(sum(n) AS BIGINT) AS occurrences, count(DISTINCT conversation_id) AS conversations, count(DISTINCT date) AS days,
  min(date) AS first_seen, max(date) AS last_seen FROM oo GROUP BY term_key HAVING sum(n) >= 2)
"""
OUT = "SELECT term_key, term, occurrences, conversations, days, first_seen, last_seen FROM cd"
OUT_COLS = ["term_key", "term", "occurrences", "conversations", "days", "first_seen", "last_seen"]


def recent(t):
    return L.recent_window(t.conv, as_of(t), 30).filter(SOURCES)


def candidates(t):
    return G.candidate_terms(G.term_occurrences(recent(t)))


@query("candidate_terms", sql("conv", OCC + OUT))
def candidate_terms(t):
    return candidates(t).select(*OUT_COLS)


@query(
    "candidate_links",
    sql("conv", OCC + "SELECT term_key, conversation_id, CAST(sum(n) AS BIGINT) AS n FROM oo GROUP BY ALL"),
)
def candidate_links(t):
    return G.candidate_links(G.term_occurrences(recent(t)))


@query(
    "top3_examples",
    sql("conv", OCC + """, rk AS (SELECT term_key, conversation_id, term, n, row_number() OVER (PARTITION BY term_key ORDER BY date DESC, conversation_id, pos) AS rn FROM oo),
    us AS (SELECT *, unnest(range(1, least(n, 3) + 1)) AS u FROM rk WHERE rn <= 3)
    SELECT term_key, conversation_id, rank FROM (SELECT term_key, conversation_id, row_number() OVER (PARTITION BY term_key ORDER BY rn, u) AS rank FROM us) WHERE rank <= 3"""),
)
def top3_examples(t):
    conv = recent(t)
    out = G.top_examples(G.term_occurrences(conv), conv)
    return out.select("term_key", "conversation_id", F.col("rank").cast("bigint").alias("rank"))


@query("recurrence_filter", sql("conv", OCC + OUT + " WHERE occurrences >= 3 AND days >= 2"))
def recurrence_filter(t):
    return G.recurrent(candidates(t)).select(*OUT_COLS)


MERGED = OCC[: OCC.index("cd AS (")] + """hv AS (SELECT term_key, conversation_id % 2 AS h, min_by(term, o) AS term, CAST(sum(n) AS BIGINT) AS occurrences, min(date) AS first_seen, max(date) AS last_seen
  FROM oo GROUP BY ALL HAVING sum(n) >= 2)
SELECT term_key, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(first_seen) AS first_seen, max(last_seen) AS last_seen, '' AS term_devanagari, min(""" + roman_sql("term") + ") AS term_romanized FROM hv GROUP BY term_key"


def halves(t):
    occ = G.term_occurrences(recent(t))
    even = G.candidate_terms(occ.filter("conversation_id % 2 = 0"))
    return even, G.candidate_terms(occ.filter("conversation_id % 2 = 1"))


@query("dedupe_candidates", sql("conv", MERGED))
def dedupe_candidates(t):
    a, b = halves(t)
    return G.merge_candidates(a.unionByName(b))


@query(
    "day_union",
    sql("conv", OCC + "SELECT term_key, string_agg(DISTINCT date, ',' ORDER BY date) AS days FROM oo GROUP BY term_key"),
)
def day_union(t):
    # A term has at most one entry per calendar day, which bounds the list.
    days = G.term_occurrences(recent(t)).select("term_key", "date").distinct()
    return days.groupBy("term_key").agg(F.array_join(F.sort_array(F.collect_list("date")), ",").alias("days"))


@query(
    "id_merge",
    sql("conv", OCC + "SELECT DISTINCT term_key, conversation_id FROM oo"),
)
def id_merge(t):
    links = G.candidate_links(G.term_occurrences(recent(t)))
    old = links.filter("conversation_id % 2 = 0").select("term_key", "conversation_id")
    return old.union(links.select("term_key", "conversation_id")).distinct()


HALF_OLD = OCC[: OCC.index("cd AS (")] + """ol AS (SELECT term_key, CAST(sum(n) AS BIGINT) AS occurrences, max(date) AS last_seen FROM oo WHERE conversation_id % 2 = 0 GROUP BY term_key HAVING sum(n) >= 2),
nw AS (SELECT term_key, CAST(sum(n) AS BIGINT) AS occurrences, max(date) AS last_seen FROM oo WHERE conversation_id % 2 = 1 GROUP BY term_key HAVING sum(n) >= 2)
"""


@query(
    "semi_existing",
    sql("conv", HALF_OLD + "SELECT term_key, ol.occurrences + coalesce(nw.occurrences, 0) AS occurrences, greatest(ol.last_seen, coalesce(nw.last_seen, ol.last_seen)) AS last_seen FROM ol LEFT JOIN nw USING (term_key)"),
)
def semi_existing(t):
    old, new = halves(t)
    return G.update_counts(old.select("term_key", "occurrences", "last_seen"), new)


@query(
    "replace_by_key",
    sql("conv", HALF_OLD + "SELECT coalesce(nw.term_key, ol.term_key) AS term_key, coalesce(nw.occurrences, ol.occurrences) AS occurrences, CASE WHEN ol.term_key IS NULL THEN 'n' ELSE 'o' END AS id FROM ol FULL JOIN nw ON nw.term_key = ol.term_key"),
)
def replace_by_key(t):
    old, new = halves(t)
    cols = ["term_key", "occurrences", "id"]
    return G.replace_by_key(
        old.withColumn("id", F.lit("o")).select(*cols), new.withColumn("id", F.lit("n")).select(*cols), "term_key", "id"
    )


@query(
    "job_funnel",
    sql("conv", OCC + """SELECT 'extracted' AS step, count(*) AS n FROM cd UNION ALL SELECT 'recurrent', count(*) FROM cd WHERE occurrences >= 3 AND days >= 2
    UNION ALL SELECT 'new', count(*) FROM cd WHERE occurrences >= 3 AND days >= 2 AND term_key NOT IN (SELECT term_key FROM oo WHERE conversation_id % 2 = 0)"""),
)
def job_funnel(t):
    occ = G.term_occurrences(recent(t))
    c = G.candidate_terms(occ)
    known = occ.filter("conversation_id % 2 = 0").select("term_key").distinct().withColumn("known", F.lit(True))
    r = (F.col("occurrences") >= 3) & (F.col("days") >= 2)
    n = c.join(known, "term_key", "left").agg(
        F.count("*").alias("extracted"),
        F.count_if(r).alias("recurrent"),
        F.count_if(r & F.col("known").isNull()).alias("new"),
    )
    return n.unpivot([], ["extracted", "recurrent", "new"], "step", "n")


@query("top_terms", sql("conv", OCC + "SELECT term_key, occurrences FROM cd ORDER BY occurrences DESC, term_key LIMIT 20"))
def top_terms(t):
    return candidates(t).orderBy(F.desc("occurrences"), "term_key").limit(20).select("term_key", "occurrences")


@query(
    "glossary_stats",
    sql("conv", OCC + "SELECT count(*) AS terms, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) FILTER (days >= 2) AS validated, count(*) FILTER (days < 2) AS pending FROM cd"),
)
def glossary_stats(t):
    return G.glossary_stats(candidates(t).withColumn("validated", F.col("days") >= 2))


ENTRY = """'## ' || ' (' || upper(term[1]) || term[2:] || ')' || chr(10) || '**Romanized:** ' || term || chr(10) || '**First seen:** ' || first_seen || chr(10) || '**Occurrences:** ' || occurrences
 || chr(10) || '**Meaning:** (meaning not yet inferred)' || chr(10) || '**Example:** "(no example available)"' || chr(10) || chr(10) || '---' || chr(10)"""


@query(
    "render_glossary",
    sql("conv", OCC + f"SELECT term_key, {ENTRY} AS entry FROM cd WHERE occurrences >= 3 AND days >= 2"),
)
def render_glossary(t):
    rows = G.recurrent(candidates(t)).withColumns({"meaning": F.lit(None).cast("string"), "example": F.lit("")})
    return rows.orderBy(F.desc("occurrences"), "term_romanized").select("term_key", G.glossary_entry().alias("entry"))


def toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({c}), '{FOLD_FROM}', '{FOLD_TO}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(view: str, key: str, columns: list[str], tf: list[str], cond: str, limit: str) -> str:
    """``tf`` are expressions over token lists named a0, a1, ..., one per column, summed."""
    lists = ", ".join(f"{toks(c)} AS a{i}" for i, c in enumerate(columns))
    size = " + ".join(f"len(a{i})" for i in range(len(columns)))
    tfs = ", ".join(
        "(" + " + ".join(x.replace("@", f"a{i}") for i in range(len(columns))) + f") AS tf{j}" for j, x in enumerate(tf)
    )
    df = ", ".join(f"count(*) FILTER (tf{j} > 0) AS d{j}" for j in range(len(tf)))
    score = " + ".join(
        f"greatest(ln((n - d{j} + 0.5) / (d{j} + 0.5)), 1e-6) * tf{j} * 2.2 / (tf{j} + 1.2 * (0.25 + 0.75 * dl / av))" for j in range(len(tf))
    )
    return f"""WITH tk AS (SELECT {key}, {lists} FROM {view}), ct AS (SELECT {key}, {size} AS dl, {tfs} FROM tk),
    tt AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM ct),
    hits AS (SELECT {key}, round(-({score}), 6) AS rank, -({score}) AS raw FROM ct, tt WHERE {cond} ORDER BY raw, {key} {limit})"""


ONE = "len(list_filter(@, lambda x: x = '{w}'))"


@query(
    "bm25_search",
    sql("texts", bm25_sql("v_texts", "doc_id", ["text"], [ONE.format(w="thed"), ONE.format(w="anre")], "tf0 > 0 OR tf1 > 0", "LIMIT 50") + " SELECT doc_id, rank FROM hits"),
)
def bm25_search(t):
    return R.bm25_search(t.texts, "Thed anre", ["text"], "doc_id", mode="any").withColumn("rank", F.round("rank", 6))


@query(
    "bm25_phrase",
    sql("texts", bm25_sql("v_texts", "doc_id", ["text"], ["len([i FOR i IN range(1, len(@)) IF @[i] = 'of' AND @[i + 1] = 'the'])"], "tf0 > 0", "LIMIT 50 OFFSET 5") + " SELECT doc_id, rank FROM hits"),
)
def bm25_phrase(t):
    out = R.bm25_search(t.texts, "of the", ["text"], "doc_id", mode="phrase", offset=5)
    return out.withColumn("rank", F.round("rank", 6))


@query(
    "bm25_prefix",
    sql("texts", bm25_sql("v_texts", "doc_id", ["text"], [ONE.format(w="the"), "len(list_filter(@, lambda x: starts_with(x, 'hein')))"], "tf0 > 0 AND tf1 > 0", "LIMIT 50") + " SELECT doc_id, rank FROM hits"),
)
def bm25_prefix(t):
    return R.bm25_search(t.texts, "the hein", ["text"], "doc_id", mode="prefix").withColumn("rank", F.round("rank", 6))


_SEARCHES = {
    "any": ("Thed anre", [ONE.format(w="thed"), ONE.format(w="anre")], "tf0 > 0 OR tf1 > 0", "LIMIT 50"),
    "all": ("the anre", [ONE.format(w="the"), ONE.format(w="anre")], "tf0 > 0 AND tf1 > 0", "LIMIT 20"),
    "phrase": ("of the", ["len([i FOR i IN range(1, len(@)) IF @[i] = 'of' AND @[i + 1] = 'the'])"], "tf0 > 0", "LIMIT 50"),
    "prefix": ("the hein", [ONE.format(w="the"), "len(list_filter(@, lambda x: starts_with(x, 'hein')))"], "tf0 > 0 AND tf1 > 0", "LIMIT 50"),
}
INDEX_SQL = " UNION ALL ".join(
    f"SELECT '{mode}' AS mode, doc_id, rank FROM ({bm25_sql('v_texts', 'doc_id', ['text'], tf, cond, end)} SELECT doc_id, rank FROM hits)"
    for mode, (_, tf, cond, end) in _SEARCHES.items()
)


# All texts are indexed, some with another text at first, which a second segment replaces.
@query("index_search", sql("texts", INDEX_SQL))
def index_search(t):
    texts = t.texts.select("doc_id", "text")
    changed = F.col("doc_id") % 7 == 0
    index = TextIndex(t.spark, scratch_dir(t.spark, "index"), ["text"], "doc_id")
    index.add(texts.withColumn("text", F.when(changed, F.concat(F.lit("of the hein the "), F.reverse("text"))).otherwise(F.col("text"))), 0)
    index.add(texts.where(changed), 1)
    found = [index.search(q, mode, limit=20 if mode == "all" else 50).withColumn("mode", F.lit(mode)) for mode, (q, *_) in _SEARCHES.items()]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("mode", "doc_id", F.round("rank", 6).alias("rank"))


@query(
    "fts_join",
    sql("conv", bm25_sql("v_conv", "conversation_id", ["summary", "transcript"], [ONE.format(w="the"), ONE.format(w="and")], "tf0 > 0 AND tf1 > 0", "LIMIT 20") + " SELECT conversation_id, rank, date, source_type FROM hits JOIN v_conv USING (conversation_id)"),
)
def fts_join(t):
    hits = R.bm25_search(t.conv, "the and", ["summary", "transcript"], "conversation_id", limit=20)
    return hits.join(t.conv.select("conversation_id", "date", "source_type"), "conversation_id").select(
        "conversation_id", F.round("rank", 6).alias("rank"), "date", "source_type"
    )


VMAP = E.variant_map()
NUM = "MAP {" + ", ".join(f"'{i}': '{w}'" for i, w in enumerate(E.NUMBERS)) + "}"
VAR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in VMAP.items()) + "}"
PUNCT = E.PUNCTUATION.replace("'", "''")
NORM = f"""WITH a AS (SELECT doc_id, lower({roman_sql('nfc_normalize(text)')}) AS s FROM v_texts),
b AS (SELECT doc_id, array_to_string([coalesce({NUM}[r], r) FOR r IN regexp_extract_all(s, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')], '') AS s FROM a),
c AS (SELECT doc_id, {words_of("regexp_replace(s, '" + PUNCT + "', ' ', 'g')")} AS ws FROM b)
SELECT doc_id, array_to_string([coalesce({VAR}[w], w) FOR w IN ws], ' ') AS normal FROM c"""


@query("text_normalize", sql("texts", NORM))
def text_normalize(t):
    return t.texts.select("doc_id", E.normalize_text(F.col("text")).alias("normal"))


# The damage of each system fixes the edits: of dropped or doubled words one text lies in the other in order,
# and replaced words have letters that stand nowhere else.
WER = """WITH n AS (SELECT scenario, system, reference, hypothesis, string_split(reference, ' ') AS r, string_split(hypothesis, ' ') AS h FROM v_pairs),
d AS (SELECT scenario, system, len(r) AS ref_words, len(h) AS hyp_words, CASE system WHEN 'drop7' THEN len(r) // 7 WHEN 'dup11' THEN len(r) // 11
  ELSE len(r) // 13 END AS dist, CASE WHEN system = 'sub13' THEN length(hypothesis) - length(replace(hypothesis, chr(57344), ''))
  ELSE abs(length(reference) - length(hypothesis)) END AS chars, length(reference) AS ref_chars FROM n)
"""


@query("wer", sql("pairs", WER + "SELECT scenario, system, round(dist / ref_words, 6) AS wer FROM d"))
def wer(t):
    return C.score_pairs(t.pairs).select("scenario", "system", F.round("wer", 6).alias("wer"))


@query(
    "edit_ops",
    sql("pairs", WER + """SELECT scenario, system, ref_words, hyp_words, CASE WHEN system = 'sub13' THEN dist ELSE 0 END AS substitutions,
    CASE WHEN system = 'drop7' THEN dist ELSE 0 END AS deletions, CASE WHEN system = 'dup11' THEN dist ELSE 0 END AS insertions FROM d"""),
)
def edit_ops(t):
    s = C.score_pairs(t.pairs)
    return s.select("scenario", "system", "ref_words", "hyp_words", "substitutions", "deletions", "insertions")


# DuckDB compares bytes, so each letter beyond ASCII becomes one unused control character.
LETTERS = "áéíóúñüöäßèêçÁÉÍÓÚÑÜÖÄÈÊÇ"


def one_byte(text: str) -> str:
    codes = [c for c in range(1, 32) if c not in (9, 10, 11, 12, 13)][: len(LETTERS)]
    return f"translate({text}, '{LETTERS}', {' || '.join(f'chr({c})' for c in codes)})"


LINES = f""", l AS (SELECT scenario, system, string_split(reference, ' ') AS r, levenshtein({one_byte('reference')}, {one_byte('hypothesis')}) / length(reference) AS cer FROM v_line_pairs),
lm AS (SELECT scenario, system, CASE system WHEN 'drop7' THEN len(r) // 7 WHEN 'dup11' THEN len(r) // 11
  ELSE len([i FOR i IN range(1, len(r) + 1) IF i % 13 = 0 AND r[i] <> 'um']) END / len(r) AS wer, cer FROM l)
"""


def scenarios(t):
    """Whole documents and their lines."""
    return t.pairs.unionByName(t.line_pairs)


@query(
    "cer",
    sql("pairs line_pairs", WER + LINES + "SELECT scenario, system, round(chars / ref_chars, 6) AS cer FROM d UNION ALL SELECT scenario, system, round(cer, 6) FROM lm"),
)
def cer(t):
    return C.score_pairs(scenarios(t)).select("scenario", "system", F.round("cer", 6).alias("cer"))


RANK = WER + ", m AS (SELECT scenario, system, dist / ref_words AS wer, chars / ref_chars AS cer FROM d)"


@query(
    "eval_ranking",
    sql("pairs line_pairs", RANK + LINES + "SELECT system, round(avg(wer), 6) AS mean_wer, round(avg(cer), 6) AS mean_cer, count(*) AS scenarios FROM (FROM m UNION ALL FROM lm) GROUP BY system"),
)
def eval_ranking(t):
    r = C.ranking(C.score_pairs(scenarios(t)))
    return r.select("system", F.round("mean_wer", 6).alias("mean_wer"), F.round("mean_cer", 6).alias("mean_cer"), "scenarios")


@query(
    "best_per_scenario",
    sql("pairs", RANK + "SELECT scenario, min_by(system, (wer, system)) AS system, round(min(wer), 6) AS wer FROM m GROUP BY scenario"),
)
def best_per_scenario(t):
    b = C.best_per_scenario(C.score_pairs(t.pairs))
    return b.select("scenario", "system", F.round("wer", 6).alias("wer"))


@query(
    "system_scenario_cross",
    sql("", f"""SELECT system, 'doc-' || doc_id AS scenario FROM documents, (VALUES ('drop7'), ('dup11'), ('sub13')) s(system) WHERE len({words_of('text')}) > 0 UNION ALL
    SELECT system, 'doc-' || doc_id || '-' || n AS scenario FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents), (VALUES ('drop7'), ('dup11'), ('sub13')) s(system) WHERE len({words_of('line')}) > 0"""),
)
def system_scenario_cross(t):
    # The systems are a fixed short list, so each scenario names them itself.
    docs = t.raw("documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    refs = docs.filter(F.size(words(F.col("text"))) > 0).select(F.concat_ws("-", F.lit("doc"), "doc_id").alias("scenario")).unionByName(
        lines.filter(F.size(words(F.col("line"))) > 0).select(F.concat_ws("-", F.lit("doc"), "doc_id", "n").alias("scenario"))
    )
    systems = F.array(*[F.lit(s) for s in ("drop7", "dup11", "sub13")])
    return refs.select(F.explode(systems).alias("system"), "scenario")


@query(
    "rtf",
    sql("segments", "SELECT segment_id, round(CASE WHEN value > 0 THEN no_speech_prob * 60 / value ELSE 0.0 END, 6)::DOUBLE AS rtf FROM v_segments"),
)
def rtf(t):
    r = C.rtf(F.col("no_speech_prob") * 60, F.col("value"))
    return t.segments.select("segment_id", F.round(r, 6).alias("rtf"))


@query(
    "bench_extrapolate",
    sql("segments", "SELECT speaker AS model, round(avg(no_speech_prob * 4), 6) AS mean_rtf, round(avg(no_speech_prob * 4) * 4.5, 6) AS hours, avg(no_speech_prob * 4) * 4.5 <= 8.0 AS fits FROM v_segments GROUP BY speaker"),
)
def bench_extrapolate(t):
    rows = t.segments.select(F.col("speaker").alias("model"), (F.col("no_speech_prob") * 4).alias("rtf"))
    out = A.extrapolate_bench(rows)
    return out.withColumns({"mean_rtf": F.round("mean_rtf", 6), "hours": F.round("hours", 6)})


@query(
    "hallucinated_words",
    sql("turns", "SELECT conv_id, CAST(sum(CASE WHEN role = 'system' THEN words ELSE 0 END) AS BIGINT) AS hallucinated_words FROM v_turns GROUP BY conv_id"),
)
def hallucinated_words(t):
    return C.hallucinated_words(t.turns, ["conv_id"], "text", F.col("role") == "system")


@query(
    "asr_stats",
    sql("texts", "SELECT count(*) AS transcribed, count(*) FILTER (low_confidence) AS low_confidence, CAST(sum(word_count) AS BIGINT) AS total_words FROM v_texts"),
)
def asr_stats(t):
    return t.texts.agg(
        F.count("*").alias("transcribed"),
        F.count_if("low_confidence").alias("low_confidence"),
        F.sum(word_count(F.col("text"))).alias("total_words"),
    )


@query(
    "model_compare",
    sql("turns", """SELECT conv_id, coalesce(string_agg(text, ' | ' ORDER BY turn) FILTER (speaker = 'owner'), '') AS owner,
    coalesce(string_agg(text, ' | ' ORDER BY turn) FILTER (speaker = 'partner'), '') AS partner FROM v_turns GROUP BY conv_id"""),
)
def model_compare(t):
    rows = t.turns.select("conv_id", "speaker", "turn", "text")
    out = C.compare_models(rows, "conv_id", "speaker", "text", ["owner", "partner"], "turn")
    return out.select("conv_id", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("partner", F.lit("")).alias("partner"))


QUOTA = """WITH w AS (SELECT request_id, account, day, start_us, billed_seconds,
  count(*) OVER (PARTITION BY account ORDER BY start_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - 1 AS minute_count,
  sum(billed_seconds) OVER (PARTITION BY account ORDER BY start_us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - billed_seconds AS hour_seconds,
  min(start_us) OVER (PARTITION BY account ORDER BY start_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS oldest_us,
  row_number() OVER (PARTITION BY account, day ORDER BY start_us, request_id) - 1 AS day_count,
  coalesce(sum(billed_seconds) OVER (PARTITION BY account, day ORDER BY start_us, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_seconds FROM v_usage),
v AS (SELECT *, CASE WHEN day_count + 1 > 2000 * 0.9 OR day_seconds + billed_seconds > 28800 * 0.9 OR hour_seconds + billed_seconds > 1500 * 0.9 THEN 'budget'
  WHEN minute_count + 1 > 2 * 0.9 THEN 'paced' ELSE 'admit' END AS verdict FROM w)
SELECT request_id, minute_count, round(hour_seconds, 4)::DOUBLE AS hour_seconds, day_count, round(day_seconds, 4)::DOUBLE AS day_seconds, verdict,
  round(CASE WHEN verdict = 'paced' THEN greatest(1.0, 61 - (start_us - oldest_us) / 1e6) ELSE 0.0 END, 6)::DOUBLE AS retry_after FROM v"""


@query("rolling_quota", sql("usage", QUOTA))
def rolling_quota_q(t):
    out = rolling_quota(t.usage, per_minute=2, hourly_seconds=1500)
    return out.select(
        "request_id",
        "minute_count",
        F.round("hour_seconds", 4).alias("hour_seconds"),
        "day_count",
        F.round("day_seconds", 4).alias("day_seconds"),
        "verdict",
        F.round("retry_after", 6).alias("retry_after"),
    )
