"""Secret scan with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. Only pairs of a blob and a rule version that the
ledger does not hold are scanned; findings are joined back to every path that has the blob. All work is
SQL functions: places follow from the lengths of the matches and of the text between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least``
    characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The three base patterns, in the order in which they are listed.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    # A run of hexadecimal digits is matched whole, so the length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


@dataclass(frozen=True)
class Ledger:
    """What earlier scans did: ``scanned`` (blob, rule), and ``findings`` (blob, rule, kind, start, end)."""

    scanned: DataFrame
    findings: DataFrame


def versions(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their ``blob`` address; a null text is the empty blob."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)))


def scan_blobs(docs: DataFrame, *, text: str = "text", rules=RULES, ledger: Ledger | None = None) -> Ledger:
    """Scan what the ledger lacks; the result holds only the new pairs and their findings.

    ``start`` and ``end`` are code points, ``end`` exclusive. Each distinct text is scanned once, whatever
    the number of its copies, and copies in one task are merged before the shuffle. Null texts count as
    empty. Empty tables give empty results. Other columns than ``text`` are not read.
    """
    blobs = (
        versions(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
        .dropDuplicates(["blob"])
        .withColumn("todo", F.array(*(F.lit(r.key) for r in rules)))
    )
    if ledger is not None:
        seen = ledger.scanned.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        none = F.array().cast("array<string>")
        blobs = (
            blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except("todo", F.coalesce("seen", none)))
            .where(F.size("todo") > 0)
            .drop("seen")
        )
    scanned = blobs.select("blob", F.explode("todo").alias("rule"))
    return Ledger(scanned, _spans(blobs, rules))


def _spans(blobs: DataFrame, rules) -> DataFrame:
    def found(number: int, r: Rule):
        pattern = F.lit(r.pattern)
        sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
        value = F.transform(F.regexp_extract_all("text", pattern, F.lit(r.group)), F.length)
        # The text before each match; the piece after the last one stands alone and is ignored.
        gaps = F.transform(F.split("text", r.pattern, -1), F.length)
        hit = F.struct(
            F.lit(r.key).alias("rule"),
            F.lit(r.kind).alias("kind"),
            F.lit(r.least).alias("least"),
            F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), value.alias("value")).alias("parts"),
        )
        wanted = F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern)
        return F.when(wanted, hit)

    hits = F.array(*(found(n, r) for n, r in enumerate(rules)))
    each = (
        blobs.select("blob", F.explode(hits).alias("hit"))
        .where("hit is not null")
        .select("blob", "hit.rule", "hit.kind", "hit.least", F.posexplode("hit.parts").alias("n", "part"))
        .select("blob", "rule", "kind", "least", "n", "part.gap", "part.size", "part.value")
        .where("size is not null")
    )
    before = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (
        each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
        .where(F.col("value") >= F.col("least"))
        .select("blob", "rule", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def findings_by_path(docs: DataFrame, found: DataFrame, *, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """One row per input row with all findings of its blob, ordered by start and then by rule.

    ``spans`` is an array of (start, place, kind, end), empty where nothing was found. ``place`` is the
    number of the kind in ``RULES`` order. Rows with null or repeated ids stay as they are.
    """
    order = F.create_map(*(x for n, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(n))))
    by_blob = found.groupBy("blob").agg(
        F.sort_array(
            F.collect_list(F.struct("start", F.coalesce(order[F.col("kind")], F.lit(99)).alias("place"), "kind", "end"))
        ).alias("spans")
    )
    paths = versions(docs.select(*keep, F.col(text).alias("blob_text")), "blob_text").drop("blob_text")
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return paths.join(by_blob, "blob", "left").select(*keep, "blob", F.coalesce("spans", none).alias("spans"))


def written(spans) -> F.Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
