"""DuckDB twins of the input views, as common table expressions."""

from __future__ import annotations

from palaver.functions.text import WS
from palaver.plans.views import LITERAL_TEXTS

DATE = "CAST(DATE '1970-01-01' + CAST(({us} + 19800000000) // 86400000000 AS INTEGER) AS VARCHAR)"


def date_of(us: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST((({us}) + 19800000000) // 86400000000 AS INTEGER), '%Y-%m-%d')"


def time_of(us: str) -> str:
    sec = f"(((({us}) + 19800000000) % 86400000000) // 1000000)"
    return (
        f"(lpad(CAST({sec} // 3600 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST(({sec} // 60) % 60 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST({sec} % 60 AS VARCHAR), 2, '0'))"
    )


def words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


def trim_of(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


_VALUES = ", ".join(f"({i}, '{t}', 'en')" for i, t in LITERAL_TEXTS)

VIEWS = {
    "v_segments": (
        (),
        f"""
SELECT *, end_us + 5000000 AS captured_us,
       CASE WHEN event_id % 5 <> 0 THEN end_us + 65000000 END AS processed_us,
       {date_of('start_us')} AS date
FROM (
  SELECT event_id,
         'seg-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS segment_id,
         'dev-' || CAST(user_id // 20 AS VARCHAR) AS device_id,
         epoch_us(ts) AS start_us,
         epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000 AS end_us,
         CASE WHEN event_type IN ('click', 'purchase') THEN 'owner'
              WHEN event_type IN ('view', 'signup') THEN 'partner' ELSE 'unknown' END AS speaker,
         CASE event_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' ELSE '' END AS language,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS no_speech_prob,
         -CAST(json_extract_string(props, '$.k') AS INTEGER) / 50.0::DOUBLE AS avg_logprob,
         value
  FROM events)""",
    ),
    "v_turns": (
        (),
        f"""
SELECT *, {date_of('start_us')} AS date, start_us + least(words * 400000, 15000000) AS end_us
FROM (
  SELECT conv_id, turn, role, text,
         1704096000000000 + conv_id * 10800000000 + turn * 20000000 AS start_us,
         CAST(len({words_of('text')}) AS BIGINT) AS words,
         CASE role WHEN 'user' THEN 'owner' WHEN 'assistant' THEN 'partner' ELSE 'unknown' END AS speaker,
         CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE '' END AS language,
         CASE WHEN (conv_id + turn) % 7 = 0 THEN 'low_confidence' ELSE 'ok' END AS status,
         'turn-' || conv_id || '-' || turn AS segment_id
  FROM conversations)""",
    ),
    "v_conv": (
        ("v_turns",),
        f"""
SELECT conv_id AS conversation_id, {date_of('start_us')} AS date, start_us, end_us,
       (end_us - start_us) // 1000000 AS duration_seconds, n_turns, words, participants,
       list_sort(list_filter(languages, lambda x: x <> '')) AS languages, transcript, summary,
       CASE WHEN conv_id % 10 = 9 THEN 'self_talk'
            WHEN unknown_ratio >= 0.7 OR (n_turns >= 3 AND changes / n_turns > 0.5 AND unknown_ratio > 0.3)
                 OR participants = ['unknown'] THEN 'media_or_unknown'
            ELSE 'live_conversation' END AS source_type,
       list_contains(participants, 'owner') AND list_contains(participants, 'partner') AS is_pair,
       CASE conv_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'neutral' WHEN 2 THEN 'tense' ELSE 'not_applicable' END AS quality
FROM (
  SELECT conv_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_turns,
         CAST(sum(words) AS BIGINT) AS words,
         avg(CASE WHEN speaker = 'unknown' THEN 1.0 ELSE 0.0 END) AS unknown_ratio,
         sum(CASE WHEN prev <> speaker THEN 1 ELSE 0 END) AS changes,
         list_sort(list_distinct(list(speaker))) AS participants,
         list_distinct(list(language)) AS languages,
         string_agg(text, chr(10) ORDER BY turn) AS transcript,
         substring(min_by(text, turn), 1, 100) AS summary
  FROM (SELECT *, lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM v_turns)
  GROUP BY conv_id)""",
    ),
    "v_texts": (
        (),
        f"""
SELECT doc_id, text, lang, CAST(len({words_of('text')}) AS BIGINT) AS word_count,
       CASE WHEN doc_id % 10 = 0 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence,
       doc_id % 10 = 0 AS low_confidence
FROM (SELECT doc_id, text, lang FROM documents
      UNION ALL SELECT * FROM (VALUES {_VALUES}) AS x(doc_id, text, lang))""",
    ),
    "v_profiles": (
        (),
        """
SELECT vec_id AS profile_id, 'spk-' || label AS name, embedding::DOUBLE[] AS embedding,
       vec_id % 10 <> 7 AS enabled, 'ecapa' AS model
FROM embeddings WHERE vec_id % 17 = 3""",
    ),
    "v_vectors": (
        (),
        """
SELECT vec_id, vec_id // 10 AS source_id, vec_id % 10 AS window_no, embedding::DOUBLE[] AS embedding
FROM embeddings WHERE vec_id % 17 <> 3""",
    ),
    "v_pairs": (
        (),
        f"""
SELECT scenario, doc_id, array_to_string(tok, ' ') AS reference, system,
       CASE system
         WHEN 'drop7' THEN array_to_string([tok[i] FOR i IN range(1, len(tok) + 1) IF i % 7 <> 0], ' ')
         WHEN 'dup11' THEN array_to_string([CASE WHEN i % 11 = 0 THEN tok[i] || ' ' || tok[i] ELSE tok[i] END FOR i IN range(1, len(tok) + 1)], ' ')
         ELSE array_to_string([CASE WHEN i % 13 = 0 THEN repeat(chr(57344), length(tok[i])) ELSE tok[i] END FOR i IN range(1, len(tok) + 1)], ' ')
       END AS hypothesis
FROM (SELECT 'doc-' || doc_id AS scenario, doc_id, {words_of('text')} AS tok
      FROM documents WHERE len({words_of('text')}) > 0),
     (VALUES ('drop7'), ('dup11'), ('sub13')) AS s(system)""",
    ),
    "v_line_pairs": (
        (),
        f"""
SELECT scenario, doc_id, array_to_string(tok, ' ') AS reference, system,
       CASE system
         WHEN 'drop7' THEN array_to_string([tok[i] FOR i IN range(1, len(tok) + 1) IF i % 7 <> 0], ' ')
         WHEN 'dup11' THEN array_to_string([CASE WHEN i % 11 = 0 THEN tok[i] || ' ' || tok[i] ELSE tok[i] END FOR i IN range(1, len(tok) + 1)], ' ')
         ELSE array_to_string([CASE WHEN i % 13 = 0 THEN 'um' ELSE tok[i] END FOR i IN range(1, len(tok) + 1)], ' ')
       END AS hypothesis
FROM (SELECT 'doc-' || doc_id || '-' || n AS scenario, doc_id, {words_of('line')} AS tok
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
              unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)
      WHERE len({words_of('line')}) > 0),
     (VALUES ('drop7'), ('dup11'), ('sub13')) AS s(system)""",
    ),
    "v_usage": (
        ("v_segments",),
        """
SELECT event_id AS request_id, device_id AS account, start_us, date AS day, value AS audio_seconds,
       greatest(10.0, value) AS billed_seconds
FROM v_segments""",
    ),
}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views, and what they depend on, in front."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for d in VIEWS[name][0]:
            need(d)
        if name not in wanted:
            wanted.append(name)

    for v in views.split():
        need(f"v_{v}")
    ctes = [f"{v} AS ({VIEWS[v][1]})" for v in wanted]
    body = body.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("WITH "):
        body = body[5:]
        return f"{word} " + ",\n".join([*ctes, body]) if ctes else f"{word} {body}"
    return (f"{word} " + ",\n".join(ctes) + "\n" + body) if ctes else body
