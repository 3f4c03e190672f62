"""Input views: the sample tables as segments, turns, conversations, texts, vectors and usage.

All times are integer microseconds since the epoch, so no view depends on a session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import NON_SPACES, let, trim_ws, word_count, words
from palaver.functions.timefmt import local_date
from palaver.operators.ordered import running
from palaver.operators.sessions import preflag_source

# Lines no sample document ends with; both engines add them to the text view.
LITERAL_TEXTS = [
    (-1, "thank you"),
    (-2, "um uh"),
    (-3, "haan haan haan"),
    (-4, "see you"),
    (-5, "यार तुम कहाँ हो"),
    (-6, "привет как дела"),
    (-7, "please read the book"),
    (-8, "use only hindi and english please"),
    (-9, "go home now go home now go home now"),
    (-10, ""),
    (-11, "hahahahahahahahahahahaha"),
    (-12, "note: buy some milk"),
    (-13, "Remind me to call the office"),
    (-14, "add a todo: fix the build"),
    (-15, "Hindi and English owner partner"),
]


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def segments(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    start = micros(F.col("ts"))
    return (
        events.select(
            "event_id",
            F.concat(F.lit("seg-"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias(
                "segment_id"
            ),
            F.concat(F.lit("dev-"), F.expr("user_id div 20").cast("string")).alias("device_id"),
            start.alias("start_us"),
            (start + F.round(F.col("value") * 100).cast("bigint") * 6000).alias("end_us"),
            F.when(F.col("event_type").isin("click", "purchase"), "owner")
            .when(F.col("event_type").isin("view", "signup"), "partner")
            .otherwise("unknown")
            .alias("speaker"),
            F.expr("CASE event_id % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'en' ELSE '' END").alias(
                "language"
            ),
            (k / F.lit(100.0)).alias("no_speech_prob"),
            (-k / F.lit(50.0)).alias("avg_logprob"),
            "value",
        )
        .withColumn("captured_us", F.col("end_us") + 5_000_000)
        .withColumn(
            "processed_us",
            F.when(F.col("event_id") % 5 != 0, F.col("captured_us") + 60_000_000),
        )
        .withColumn("date", local_date(F.col("start_us")))
    )


def turns(conversations: DataFrame) -> DataFrame:
    return (
        conversations.withColumn(
            "start_us",
            F.lit(1704096000000000)
            + F.col("conv_id") * 10_800_000_000
            + F.col("turn") * 20_000_000,
        )
        .withColumn("words", word_count(F.col("text")))
        .withColumn(
            "end_us", F.col("start_us") + F.least(F.col("words") * 400_000, F.lit(15_000_000))
        )
        .withColumn(
            "speaker",
            F.when(F.col("role") == "user", "owner")
            .when(F.col("role") == "assistant", "partner")
            .otherwise("unknown"),
        )
        .withColumn(
            "language",
            F.expr("CASE conv_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE '' END"),
        )
        .withColumn(
            "status",
            F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "low_confidence").otherwise("ok"),
        )
        .withColumn(
            "segment_id",
            F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")),
        )
        .withColumn("date", local_date(F.col("start_us")))
    )


def conv(t: DataFrame) -> DataFrame:
    """One row per conversation.

    All but the transcript merges map-side, and the speaker changes come from a slot-wise scan. The
    transcript is a single value by the data model; plans that do not use it do not build it, and
    ``operators.transcripts`` gives it in parts of bounded length.
    """
    rows = running(
        t, ["conv_id"], ["start_us", "turn"], {"_before": ("last", F.col("speaker"))}
    )
    g = rows.groupBy("conv_id").agg(
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.count("*").alias("n_turns"),
        F.sum("words").alias("words"),
        F.avg((F.col("speaker") == "unknown").cast("double")).alias("unknown_ratio"),
        F.count_if(F.col("speaker") != F.col("_before")).alias("_changes"),
        F.sort_array(F.collect_set("speaker")).alias("participants"),
        F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias(
            "languages"
        ),
        F.min_by(F.substring("text", 1, 100), F.struct("start_us", "turn")).alias("summary"),
        F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_texts"),
    )
    changes = F.col("_changes")
    flag = preflag_source(F.col("unknown_ratio"), changes, F.col("n_turns"), F.col("participants"))
    return g.select(
        F.col("conv_id").alias("conversation_id"),
        local_date(F.col("start_us")).alias("date"),
        "start_us",
        "end_us",
        F.expr("(end_us - start_us) div 1000000").alias("duration_seconds"),
        "n_turns",
        "words",
        "participants",
        "languages",
        F.array_join(F.transform("_texts", lambda x: x["text"]), "\n").alias("transcript"),
        "summary",
        F.when(F.col("conv_id") % 10 == 9, "self_talk").otherwise(flag).alias("source_type"),
        (F.array_contains("participants", "owner") & F.array_contains("participants", "partner")).alias(
            "is_pair"
        ),
        F.expr(
            "CASE conv_id % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'neutral' "
            "WHEN 2 THEN 'tense' ELSE 'not_applicable' END"
        ).alias("quality"),
    )


def texts(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    rows = ", ".join(f"({i}, '{text}')" for i, text in LITERAL_TEXTS)
    extra = spark.sql(
        f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, 'en' AS lang FROM VALUES {rows} AS x(doc_id, text)"
    )
    both = documents.select("doc_id", "text", "lang").unionByName(extra)
    low = F.pmod(F.col("doc_id"), F.lit(10)) == 0
    return both.select(
        "doc_id",
        "text",
        "lang",
        word_count(F.col("text")).alias("word_count"),
        F.when(low, 0.5).otherwise(0.95).alias("confidence"),
        low.alias("low_confidence"),
    )


#: The share of the vectors that are enrolled voices; it grows with the table.
ENROLLED = "vec_id % 17 = 3"


def profiles(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(ENROLLED).select(
        F.col("vec_id").alias("profile_id"),
        F.concat(F.lit("spk-"), F.col("label").cast("string")).alias("name"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("vec_id") % 10 != 7).alias("enabled"),
        F.lit("ecapa").alias("model"),
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.filter(~F.expr(ENROLLED)).select(
        "vec_id",
        F.expr("vec_id div 10").alias("source_id"),
        (F.col("vec_id") % 10).alias("window_no"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


#: Stands for a letter that was not understood; it occurs in no text.
UNHEARD = "\ue000"


def pairs(documents: DataFrame) -> DataFrame:
    """Reference and hypothesis texts for three systems that damage the text by position.

    A scenario is a whole document that has a word, so damage goes on across line ends.
    """
    # The filter looks for the first word only, and does not make all words again.
    base = documents.filter(F.col("text").rlike(NON_SPACES)).select(
        F.concat_ws("-", F.lit("doc"), "doc_id").alias("scenario"),
        F.col("doc_id"),
        F.array_join(words(F.col("text")), " ").alias("reference"),
    )
    return _damaged(base, lambda w: F.repeat(F.lit(UNHEARD), F.length(w)))


def line_pairs(documents: DataFrame) -> DataFrame:
    """The same of each line that has a word, with a word that texts may hold in place of others."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    base = lines.filter(F.col("line").rlike(NON_SPACES)).select(
        F.concat_ws("-", F.lit("doc"), "doc_id", "n").alias("scenario"),
        F.col("doc_id"),
        F.array_join(words(F.col("line")), " ").alias("reference"),
    )
    return _damaged(base, lambda w: F.lit("um"))


def _damaged(base: DataFrame, other) -> DataFrame:
    """Each reference with what the three systems make of it; ``other`` is what the last one puts for a word."""

    def systems(tok):
        every = lambda step, hit: F.transform(tok, lambda w, i: F.when((i + 1) % step == 0, hit(w)).otherwise(w))
        heard = {
            "drop7": F.filter(tok, lambda w, i: (i + 1) % 7 != 0),
            "dup11": every(11, lambda w: F.concat(w, F.lit(" "), w)),
            "sub13": every(13, other),
        }
        return F.array(*(F.struct(F.lit(s).alias("system"), F.array_join(t, " ").alias("hypothesis")) for s, t in heard.items()))

    return base.select(
        "scenario", "doc_id", "reference", F.explode(let(F.split("reference", " "), systems)).alias("_s")
    ).select("scenario", "doc_id", "reference", "_s.system", "_s.hypothesis")


#: Words of one segment of a hypothesis.
SEGMENT = 40


def pair_segments(pairs: DataFrame) -> DataFrame:
    """Each hypothesis in segments of a fixed number of words, with a compression ratio made from its place."""

    def parts(tok):
        last = F.floor((F.size(tok) - 1) / SEGMENT).cast("int")
        text = lambda i: F.array_join(F.slice(tok, i * SEGMENT + 1, SEGMENT), " ")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), text(i).alias("text")))

    # The words of a hypothesis are cut here, so no row of a segment carries all of them.
    rows = pairs.select("scenario", "system", "doc_id", F.explode(let(F.split("hypothesis", " "), parts)).alias("s"))
    ratio = F.pmod(F.col("doc_id") + F.col("s.i"), F.lit(29)) / 10.0
    return rows.select("scenario", "system", "s.text", ratio.alias("compression_ratio"))


def pair_times(pairs: DataFrame) -> DataFrame:
    """Seconds of work and of speech, made from the words of both sides."""
    return pairs.select(
        "scenario", "system", (word_count(F.col("hypothesis")) / 4.0).alias("processing_time"),
        (word_count(F.col("reference")) / 2.5).alias("audio_duration"),
    )


def usage(seg: DataFrame) -> DataFrame:
    return seg.select(
        F.col("event_id").alias("request_id"),
        F.col("device_id").alias("account"),
        "start_us",
        F.col("date").alias("day"),
        F.col("value").alias("audio_seconds"),
        F.greatest(F.lit(10.0), F.col("value")).alias("billed_seconds"),
    )


__all__ = ["conv", "pairs", "profiles", "segments", "texts", "trim_ws", "turns", "usage", "vectors"]
