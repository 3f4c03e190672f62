"""Benchmark decontamination by spaced-seed hashing, in SQL functions only.

A fixed mask picks some of a few consecutive words and ignores the others, so a place keeps its hash if
only ignored words were replaced. Hashes of all places of the training texts are joined with those of the
benchmark; each hit gives an alignment, along which the words of both are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.scratch import staged

#: Fixed masks of five words over at most ten. Any quarter of the words of 10, 12 or 16 neighbouring words may be
#: replaced and some mask still hits one place; longer stretches hold one of 10 to 19 words that lost no more.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 6, 7), (0, 3, 4, 5, 6), (0, 1, 2, 3, 4))
#: Share of equal words along an alignment, and the least number of aligned words, that make a leak.
LEAST_SHARE = 0.75
LEAST_WORDS = 10
#: Hashed benchmark places up to which they and the items' words are broadcast, at most about 100 bytes for
#: each place; more are shuffled.
BROADCAST_PLACES = 1_000_000


def word_hashes(text) -> F.Column:
    """Hashes of the words of a text: runs of letters and digits, without regard to case."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _places(texts: DataFrame, keep: list[str], least: int) -> DataFrame:
    """One row per mask and place of a text of ``least`` words or more: hash, place, and the columns ``keep``.

    ``w`` must be there. The offsets are looked up by the number of the mask, so that one short hash expression
    serves all.
    """
    masks, picks = len(MASKS), len(MASKS[0])
    rows = texts.where(F.size("w") >= max(least, picks)).select(
        *keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") * masks - 1)).alias("k")
    )
    offsets = F.array(*(F.lit(i) for mask in MASKS for i in mask))
    mask, place = F.expr(f"k % {masks}"), F.expr(f"cast(k div {masks} as int)")
    inside = place + F.get(offsets, mask * picks + picks - 1) < F.size("w")
    words = [F.get(F.col("w"), place + F.get(offsets, mask * picks + j)) for j in range(picks)]
    return rows.where(inside).select(*keep, "w", F.xxhash64(mask, *words).alias("hash"), place.alias("place"))


def _any_stretch(same: str, share: float, least: int) -> F.Column:
    """Whether any ``least`` or more neighbouring values of a column of 0 and 1 have a mean of ``share``.

    Running sums of value less share: the end of a stretch against the least sum ``least`` or more before it.
    """
    start = F.struct(F.lit(0.0).alias("end"), F.lit(0.0).alias("begin"), F.lit(0.0).alias("low"), F.lit(False).alias("ok"))

    def step(s, k):
        end = s.end + F.get(F.col(same), k) - share
        begin = F.when(k >= least, s.begin + F.get(F.col(same), F.greatest(k - least, F.lit(0))) - share).otherwise(F.lit(0.0))
        low = F.least(s.low, begin)
        return F.struct(
            end.alias("end"), begin.alias("begin"), low.alias("low"), (s.ok | ((k >= least - 1) & (end - low >= -1e-9))).alias("ok")
        )

    places = F.sequence(F.lit(0), F.size(same) - 1)
    return (F.size(same) >= least) & F.aggregate(places, start, step, lambda s: s.ok)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    least_share: float = LEAST_SHARE,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(row, *keep, item, first_word, n_aligned, n_equal): the best alignment of each leaking pair.

    ``row`` numbers the rows of ``docs`` in one run of the plan. An alignment covers the words of the item
    that fall inside the text; it is a leak if at least ``least_words`` of them
    are aligned and ``least_share`` of those are equal, or, for a part of an item, if any stretch of the
    alignment is. Null texts and items count as empty; texts and items under ``least_words``
    words leak nothing. Repeated rows and rows with null ids are texts of their own; a null item id is kept.
    Other columns are not read. The benchmark is counted first: up to ``BROADCAST_PLACES`` places it is
    broadcast, beyond that both sides are shuffled by hash.
    """
    items = staged(
        benchmark.select(
            F.monotonically_increasing_id().alias("item_row"),
            F.col(f"`{item_id}`").alias("item"),
            word_hashes(F.col(f"`{item_text}`")).alias("w"),
        )
    )
    test = _places(items, ["item_row"], least_words).select("hash", F.col("place").alias("item_place"), "item_row")
    items = items.select("item_row", "item", F.col("w").alias("item_w"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), *keep, word_hashes(F.col(f"`{text}`")).alias("w"))
    train = _places(texts, ["row", *keep], least_words)
    small = test.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES
    hits = train.join(F.broadcast(test) if small else test, "hash").join(
        F.broadcast(items) if small else items, "item_row"
    )
    shift = F.col("place") - F.col("item_place")
    low = F.greatest(shift, F.lit(0))
    high = F.least(shift + F.size("item_w"), F.size("w"))
    lines = (
        hits.withColumn("shift", shift)
        .withColumn("low", low)
        .select(
            "row",
            *keep,
            "item_row",
            "item",
            "shift",
            "low",
            F.slice("w", F.col("low") + 1, high - F.col("low")).alias("a"),
            F.slice("item_w", F.col("low") - F.col("shift") + 1, high - F.col("low")).alias("b"),
        )
        .groupBy("row", *keep, "item_row", "item", "shift", "low")
        .agg(F.first("a").alias("a"), F.first("b").alias("b"))
    )
    same = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1).otherwise(0))
    checked = lines.select("row", *keep, "item_row", "item", F.col("low").alias("first_word"), same.alias("same")).select(
        "row",
        *keep,
        "item_row",
        "item",
        "first_word",
        F.size("same").alias("n_aligned"),
        F.aggregate("same", F.lit(0), lambda s, x: s + x).alias("n_equal"),
        _any_stretch("same", least_share, least_words).alias("part"),
    )
    whole = (F.col("n_aligned") >= least_words) & (F.col("n_equal") >= F.col("n_aligned") * least_share)
    best = F.max_by(F.struct("first_word", "n_aligned", "n_equal"), F.struct("n_equal", -F.col("first_word"))).alias("best")
    return (
        checked.where(whole | F.col("part"))
        .groupBy("row", *keep, "item_row", "item")
        .agg(best)
        .select("row", *keep, "item", "best.*")
    )
