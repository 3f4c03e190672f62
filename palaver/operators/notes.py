"""Markdown notes of conversations and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.functions.text import format_turn, let, one_liner, preview, slug
from palaver.functions.timefmt import local_time
from palaver.operators.transcripts import PART_ROWS, ordered_parts

WARN = "⚠️"


def yaml_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")


def note_stem(start_us: Column, summary: Column) -> Column:
    """``HHMM-slug`` of a conversation note."""
    hhmm = F.replace(F.substring(local_time(start_us), 1, 5), F.lit(":"), F.lit(""))
    return F.concat(hhmm, F.lit("-"), slug(summary))


def _marked(lines: Column, low: Column) -> Column:
    """Add the warning sign to the line of each flagged segment, the last line at most."""

    def all_lines(targets):
        def mark(line, i):
            own = F.array_contains(targets, i) & ~F.contains(line, F.lit(WARN))
            return F.when(own, F.concat(line, F.lit(" " + WARN))).otherwise(line)

        return F.transform(lines, mark)

    return let(F.transform(low, lambda p: F.least(p, F.size(lines) - 1)), all_lines)


def render_notes(
    conv: DataFrame, members: DataFrame, part_rows: int = PART_ROWS, tag: str = "journal"
) -> DataFrame:
    """Note text per conversation: front matter, summary, marked transcript, raw transcript, words.

    ``members`` has conversation_id, segment_id, start_us, speaker, text and low_confidence.
    """
    parts = ordered_parts(
        members,
        ["conversation_id"],
        ["start_us", "segment_id"],
        part_rows,
        line=format_turn(F.col("start_us"), F.col("speaker"), F.col("text")),
        low=F.col("low_confidence"),
    )
    own = parts.select(
        "conversation_id",
        "part",
        F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("full"),
        F.array_compact(
            F.transform("items", lambda x, i: F.when(x["low"], i))
        ).alias("low"),
    )
    rows = conv.join(own, "conversation_id")
    if "cleaned_transcript" in conv.columns:
        cleaned = F.coalesce(F.nullif("cleaned_transcript", F.lit("")), F.col("full"))
    else:
        cleaned = F.col("full")
    rows = rows.withColumn("_lines", F.split(cleaned, "\n"))
    rows = rows.withColumn("_marked", _marked(F.col("_lines"), F.col("low")))
    flagged = F.size("low") > 0

    def clock(us: str) -> Column:
        return F.substring(local_time(F.col(us)), 1, 5)

    dur = F.col("duration_seconds").cast("bigint").cast("string")
    tags = f"- {tag}\n- conversation\n"
    front = F.concat(
        F.lit("---\ndate: '"), F.col("date"), F.lit("'\nduration_seconds: "), dur,
        F.lit("\nend_time: '"), clock("end_us"), F.lit("'\nis_pair_conversation: "),
        F.col("is_pair").cast("string"), F.lit("\nlanguages:\n"), yaml_list(F.col("languages")),
        F.when(flagged, "needs_review: true\n").otherwise(""), F.lit("participants:\n"),
        yaml_list(F.col("participants")), F.lit("quality: "), F.col("quality"),
        F.lit("\nsource_type: "), F.col("source_type"), F.lit("\nstart_time: '"), clock("start_us"),
        F.lit("'\ntags:\n" + tags), F.when(flagged, "- needs-review\n").otherwise(""), F.lit("---\n\n"),
    )
    warning = (
        f"> {WARN} **Low confidence segments detected.** "
        f"Some transcript lines may need review. Flagged lines are marked with {WARN}\n"
    )
    body = F.concat(
        F.lit("## Summary\n\n"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("*No summary available*")), F.lit("\n"),
        F.when(flagged, warning).otherwise(""),
        F.lit("## Cleaned Transcript\n\n```transcript\n"), F.array_join("_marked", "\n"),
        F.lit("\n```\n\n<details>\n<summary>Raw Transcript</summary>\n\n```transcript\n"),
        F.col("full"), F.lit("\n```\n\n</details>\n\n---\n*"), F.col("words").cast("string"),
        F.lit(" words, "), dur, F.lit("s*"),
    )
    return rows.select(
        "conversation_id",
        "part",
        "date",
        note_stem(F.col("start_us"), F.col("summary")).alias("stem"),
        F.concat(front, body).alias("note"),
    )


def render_daily_notes(
    conv: DataFrame, part_rows: int = PART_ROWS, tag: str = "journal", heading: str = "Journal"
) -> DataFrame:
    """Note per day: counters, and a link with a short preview per conversation, newest first."""
    stem = note_stem(F.col("start_us"), F.col("summary"))
    link = F.concat(
        F.lit("- [[Conversations/"), F.col("date"), F.lit("/"), stem, F.lit("|"),
        F.split_part(stem, F.lit("-"), F.lit(1)), F.lit("]] — "),
        one_liner(preview(F.col("summary"))), F.lit("\n"),
    )
    counts = conv.groupBy("date").agg(
        F.count("*").alias("total"),
        F.count_if("is_pair").alias("pair"),
        F.count_if(F.col("source_type") == "self_talk").alias("self_talk"),
        F.count_if(F.col("source_type") == "media_or_unknown").alias("media"),
    )
    back = conv.select("date", (-F.col("start_us")).alias("_b"), (-F.col("conversation_id")).alias("_i"), link.alias("link"))
    links = ordered_parts(back, ["date"], ["_b", "_i"], part_rows, link=F.col("link"))
    n = lambda c: F.col(c).cast("string")
    text = F.concat(
        F.lit("---\ndate: '"), F.col("date"), F.lit("'\nmedia_flagged: "), n("media"),
        F.lit("\nself_talk: "), n("self_talk"), F.lit(f"\ntags:\n- {tag}\n- daily\ntotal_conversations: "),
        n("total"), F.lit("\nwith_partner: "), n("pair"), F.lit(f"\n---\n\n# {heading}: "), F.col("date"),
        F.lit("\n\n## Summary\n\n*Daily summary will be updated as conversations are recorded.*\n\n## Conversations\n\n"),
        F.array_join(F.transform("items", lambda x: x["link"]), ""),
    )
    return counts.join(links, "date").select("date", "part", text.alias("note"))
