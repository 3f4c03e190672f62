"""Source divergence audit: how the term shares of a source differ from those of others in its language.

The terms kept of a language are numbered in byte order by minimal acyclic transducers, built from the sorted
terms in shards. Texts are streamed through them for counting, and the numbers break ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.llm.ranks import bounded, numbered
from palaver.llm.scratch import staged
from palaver.llm.transducer import Transducer
from palaver.llm.words import Words, byte_table, steps

#: Letters A-Z and a-z and every character beyond ASCII belong to a term.
TERM = byte_table("".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
#: Terms of one transducer.
SHARD = 1 << 16
#: Bytes of transducers up to which they are broadcast; beyond it terms are shuffled to their numbers.
BROADCAST_BYTES = 64_000_000
#: Terms and sources of one cell in which pairs of sources are compared.
BLOCK, SOURCES = 4096, 256
#: Parts of one share.
UNIT = 1_000_000_000
_STEP_BYTES = 4_000_000


class _Terms:
    """Terms of a batch: the distinct ones, and for each occurrence its number there and its row."""

    def __init__(self, column: pa.Array):
        words = Words(column, TERM, lower=True)
        self.data = words.data[TERM[words.data]]
        ends = np.cumsum(words.ends - words.starts)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)])
        coded = found.dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = words.owners()

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, at, data = self.distinct.buffers()
        offsets = np.frombuffer(at, np.int64)[self.distinct.offset : self.distinct.offset + len(self.distinct) + 1]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def _codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _unique(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of keys, and how often each occurs."""
    sizes = [int(k.max(initial=-1)) + 1 for k in keys]
    joined = np.zeros(len(keys[0]), np.int64)
    for k, n in zip(keys, sizes, strict=True):
        joined = joined * n + k
    values, counts = np.unique(joined, return_counts=True)
    out = []
    for n in reversed(sizes):
        out.append(values % n if n else values)
        values = values // n if n else values
    return out[::-1], counts


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a step in which a term occurs."""
    for batch in steps(batches, "text", _STEP_BYTES):
        terms = _Terms(batch.column("text"))
        langs, lang = _codes(batch.column("lang"))
        (row, code), _ = _unique(terms.rows, terms.codes)
        (l, c), n = _unique(lang[row], code)
        term = terms.distinct.take(pa.array(c)).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(l)).cast(pa.string()), term, pa.array(n)], names=["lang", "term", "n"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n): occurrences of every term of a step."""
    for batch in steps(batches, "text", _STEP_BYTES):
        terms = _Terms(batch.column("text"))
        (langs, lang), (sources, source) = _codes(batch.column("lang")), _codes(batch.column("source"))
        (l, s, c), n = _unique(lang[terms.rows], source[terms.rows], terms.codes)
        term = terms.distinct.take(pa.array(c)).cast(pa.string())
        own = [langs.take(pa.array(l)).cast(pa.string()), sources.take(pa.array(s)).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*own, term, pa.array(n)], names=["lang", "source", "term", "n"])


def _recount(batches: Iterator[pa.RecordBatch], shards) -> Iterator[pa.RecordBatch]:
    """(lang, source, ordinal, n): occurrences of kept terms, found by the transducers of the language."""
    loaded: dict[str, list[tuple[int, Transducer]]] = {}

    def of(lang: str) -> list[tuple[int, Transducer]]:
        if lang not in loaded:
            loaded[lang] = [(first, Transducer.of_parts(*parts)) for first, parts in shards.value.get(lang, [])]
        return loaded[lang]

    for batch in steps(batches, "text", _STEP_BYTES):
        terms = _Terms(batch.column("text"))
        (langs, lang), (sources, source) = _codes(batch.column("lang")), _codes(batch.column("source"))
        data, starts, ends = terms.spans()
        ordinal = np.full(len(terms.codes), -1, np.int64)
        for i, name in enumerate(langs.to_pylist()):
            mine = np.flatnonzero(lang[terms.rows] == i)
            if not len(mine) or not of(name):
                continue
            used, back = np.unique(terms.codes[mine], return_inverse=True)
            number = np.full(len(used), -1, np.int64)
            for first, transducer in of(name):
                open_ = np.flatnonzero(number < 0)
                found = transducer.find(data, starts[used[open_]], ends[used[open_]])
                number[open_] = np.where(found < 0, -1, found + first)
            ordinal[mine] = number[back]
        kept = np.flatnonzero(ordinal >= 0)
        row = terms.rows[kept]
        (l, s, o), n = _unique(lang[row], source[row], ordinal[kept])
        own = [langs.take(pa.array(l)).cast(pa.string()), sources.take(pa.array(s)).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*own, pa.array(o), pa.array(n)], names=["lang", "source", "ordinal", "n"])


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, ordinal, size): terms in at least ``least`` documents of a language, numbered in byte order."""
    found = docs.select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n bigint")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")
    return staged(numbered(kept, ["lang"], ["term"]).withColumnRenamed("pos", "ordinal"))


def transducers(terms: DataFrame) -> DataFrame:
    """(lang, first, keys, targets, skips, final, root): one transducer for each shard of sorted terms."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        parts = Transducer.build(t.encode() for t in pdf["term"]).parts()
        return pd.DataFrame([[pdf["lang"].iloc[0], int(pdf["ordinal"].iloc[0]), *parts]])

    shard = F.expr(f"ordinal div {SHARD}").alias("shard")
    schema = "lang string, first bigint, keys binary, targets binary, skips binary, final binary, root int"
    return staged(terms.select("lang", "term", "ordinal", shard).groupBy("lang", "shard").applyInPandas(build, schema))


def count_kept(docs: DataFrame, terms: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of each kept term by language and source, without zeros.

    The transducers travel to the texts if they are measured to be small; else counted terms travel to them.
    """
    built = transducers(terms)
    size = F.sum(sum(F.length(c) for c in ("keys", "targets", "skips", "final")))
    if (built.agg(size.alias("n")).first().n or 0) <= most_bytes:
        shards: dict[str, list] = {}
        for r in built.collect():
            shards.setdefault(r.lang, []).append((r.first, tuple(bytes(b) for b in r[2:6]) + (r.root,)))
        sent = docs.sparkSession.sparkContext.broadcast(shards)
        found = docs.mapInArrow(lambda b: _recount(b, sent), "lang string, source string, ordinal bigint, n bigint")
    else:
        found = docs.mapInArrow(_occurrences, "lang string, source string, term string, n bigint")
        found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(terms, ["lang", "term"])
    return staged(found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly."""
    big = F.lit(UNIT).cast("decimal(38,0)") * (n + 2)
    whole = F.call_function("div", big, (total + 2 * terms).cast("decimal(38,0)"))
    return F.when(terms > 0, whole.cast("bigint") + 1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b, value) of all pairs of sources that meet in this cell, summed over its terms."""
    head = pdf["place"].to_numpy() < 0
    owners, at = np.unique(pdf["gid"].to_numpy(), return_inverse=True)
    share, width = pdf["p"].to_numpy(), int(pdf["width"].iloc[0])
    base = np.ones(len(owners), np.int64)
    base[at[head]] = share[head]
    table = np.repeat(base[:, None], width, axis=1)
    table[at[~head], pdf["place"].to_numpy()[~head]] = share[~head]
    part = np.zeros(len(owners), np.int64)
    part[at] = pdf["own"].to_numpy()
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    left = np.flatnonzero(part == i)
    out = []
    for x in left:
        right = left[left > x] if i == j else np.flatnonzero(part == j)
        d = table[right] - table[x]
        out.append(pd.DataFrame({"a": owners[x], "b": owners[right], "value": (d * d // (table[right] + table[x])).sum(axis=1)}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []}, dtype=np.int64)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, other, value) of all ordered pairs of sources of a language, as that many rows are asked for.

    A cell has the shares of up to about ``SOURCES`` times two sources for ``BLOCK`` terms, and a head for each
    source, so that sources without any of these terms are there as well.
    """
    parts = F.ceil(F.count("*").over(Window.partitionBy("lang")) / SOURCES).cast("int")
    groups = staged(groups.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("gid"), "parts").cast("int")))
    last = F.greatest(F.expr(f"(terms - 1) div {BLOCK}"), F.lit(0))
    none = F.when(F.col("terms") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))).otherwise(1)
    heads = groups.select("gid", "lang", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), F.lit(-1).cast("bigint").alias("place"), none.alias("p"))
    rows = shares.select("gid", "lang", F.expr(f"ordinal div {BLOCK}").alias("block"), F.expr(f"ordinal % {BLOCK}").alias("place"), "p")
    sizes = groups.select("gid", "parts", "own", "terms")
    placed = heads.unionByName(rows).join(bounded(sizes), "gid")
    every = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")),
    )
    width = F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).alias("width")
    cells = placed.select("lang", "gid", "block", "place", "p", "own", width, F.explode(every).alias("c")).select("*", "c.i", "c.j").drop("c")
    found = cells.groupBy("lang", "block", "i", "j").applyInPandas(_compare, "a bigint, b bigint, value bigint")
    summed = found.groupBy("a", "b").agg(F.sum("value").alias("value"))
    return summed.select(F.col("a").alias("gid"), F.col("b").alias("other"), "value").unionByName(
        summed.select(F.col("b").alias("gid"), F.col("a").alias("other"), "value")
    )


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence between sources, and the terms that mark a source.

    Part ``pair`` has every other source of the language; part ``term`` the ``top`` terms with a greater share
    than in the language. Null lang, source and text count as empty. Texts are read whole, a very long one in a
    step of its own. Repeated rows are documents of their own; equal values rank by item in byte order. A
    language without kept terms has pairs of value 0. Other columns take no part. An empty table gives no rows.
    """
    empty = F.lit("")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    terms = vocabulary(docs, least)
    counts = count_kept(docs, terms)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.where("ordinal = 0").select("lang", F.col("size").alias("terms"))
    zero = F.lit(0).cast("bigint")
    groups = (
        docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(bounded(sizes), "lang", "left")
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    )
    groups = staged(groups.withColumn("all", F.sum("total").over(Window.partitionBy("lang"))).withColumn("gid", F.monotonically_increasing_id()))
    in_language = F.sum("n").over(Window.partitionBy("lang", "ordinal"))
    known = bounded(groups.select(*(F.col(c).alias(f"_{c}" if c in ("lang", "source") else c) for c in groups.columns)))
    joined = counts.withColumn("m", in_language).join(known, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    shares = staged(joined.select(
        "gid", "lang", "ordinal", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("m"), F.col("all"), F.col("terms")).alias("q"),
    ))
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"), "ordinal")
    marks = (
        shares.where("p > q").select("gid", "lang", "ordinal", _distance(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
        .join(terms.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
        .select("gid", F.lit("term").alias("part"), "item", "value", "rank")
    )
    names = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = _pairs(shares, groups).join(bounded(names), "other")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item")))
    rows = marks.unionByName(pairs.select("gid", F.lit("pair").alias("part"), "item", "value", "rank"))
    return rows.join(bounded(groups.select("gid", "lang", "source")), "gid").select("lang", "source", "part", "item", "value", "rank")
