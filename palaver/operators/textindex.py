"""A stored inverted index with positions, for ranked search that reads the postings of its terms only.

Rows are added in segments. A segment holds one posting for each term of a row, below the bucket of the term's
first two letters and sorted by term, so a search opens few folders and skips most of their row groups. Rows of
later segments replace those with the same key; the replaced ones are listed, not rewritten. Postings also have
the length class of their row; the best count of each term and class bounds every score in it, so ``any`` and
``all`` searches first score the most promising classes and then read only those that could still matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.operators.search import LETTER, _folded, _query_tokens, _ranked, _term_score

BUCKETS = 256
#: Places of different columns never touch.
COLUMN = 1 << 32
#: Length classes that are scored first.
FIRST = 4


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BUCKETS)).cast("int")


def _length_class(dl: Column) -> Column:
    return F.floor(F.log2(dl + 1) * 4).cast("int")


def _placed(tokens: Column, column: int) -> Column:
    return F.transform(tokens, lambda w, i: F.struct(w.alias("term"), (i + column * COLUMN).alias("place")))


def _shifted(places: Column, back: int) -> Column:
    return F.transform(places, lambda x: x - back)


class TextIndex:
    """An index in ``folder`` over ``columns``; ``kind`` is the type of the key."""

    def __init__(self, spark: SparkSession, folder: str, columns: list[str], key: str, kind: str = "bigint"):
        self.spark, self.folder, self.columns, self.key = spark, folder.rstrip("/"), columns, key
        self.schemas = {
            "postings": f"`{key}` {kind}, term string, tf bigint, dl bigint, class int, places array<bigint>, bucket int, segment int",
            "rows": f"`{key}` {kind}, dl bigint, segment int",
            "gone": f"`{key}` {kind}, dl bigint, segment int, since int",
            "best": "term string, class int, tf bigint, dl bigint, n bigint, bucket int, segment int",
        }

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")
        except Exception as e:  # nothing has been added yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schemas[name])

    def add(self, df: DataFrame, segment: int) -> None:
        """Index the rows as ``segment``, a number above those before. Repeating it writes the same again.

        Keys are distinct within a segment. Null texts have no tokens; a row without any still counts.
        """
        tokens = [F.regexp_extract_all(_folded(F.col(c)), F.lit(f"({LETTER}+)"), F.lit(1)) for c in self.columns]
        placed = [_placed(t, n) for n, t in enumerate(tokens)]
        rows = df.select(self.key, F.concat(*placed).alias("tokens")).withColumn("dl", F.size("tokens").cast("bigint"))
        self._write(rows.select(self.key, "dl"), "rows", segment)
        new = self._read("rows").where(F.col("segment") == segment).select(self.key)
        old = self._read("rows").where(F.col("segment") < segment).join(new, self.key, "left_semi")
        known = self._read("gone").where(F.col("since") < segment).select(self.key, "segment")
        gone = old.join(known, [self.key, "segment"], "left_anti")
        gone.write.mode("overwrite").parquet(f"{self.folder}/gone/since={segment}")
        each = rows.select(self.key, "dl", F.explode("tokens").alias("t")).select(self.key, "dl", "t.term", "t.place")
        each = each.withColumns({"bucket": _bucket(F.col("term")), "class": _length_class(F.col("dl"))})
        # One shuffle: the grouping below is finer than these keys. A bucket is split by the class of its rows.
        dealt = each.repartition("bucket", "class")
        posts = dealt.groupBy("bucket", "class", "term", self.key, "dl").agg(
            F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("places")
        )
        self._write(posts.sortWithinPartitions("bucket", "term", self.key), "postings", segment, "bucket")
        stored = self._read("postings").where(F.col("segment") == segment)
        best = stored.groupBy("bucket", "term", "class").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.count("*").alias("n"))
        self._write(best.repartition("bucket").sortWithinPartitions("bucket", "term"), "best", segment, "bucket")

    def _write(self, df: DataFrame, name: str, segment: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/segment={segment}")

    def _of(self, name: str, terms: list[str], prefix: str | None) -> DataFrame:
        """Rows of the terms: their buckets by name, their places in the files by value."""
        table = self._read(name)
        starts = sorted({t[:2] for t in [*terms, *([prefix] if prefix is not None and len(prefix) > 1 else [])]})
        where = F.col("term").isin(terms) if terms else F.lit(False)
        if prefix is not None:
            where = where | F.col("term").startswith(prefix)
        if prefix is None or len(prefix) > 1:
            named = self.spark.createDataFrame([(x,) for x in starts], "x string").select(_bucket(F.col("x"))).distinct()
            table = table.where(F.col("bucket").isin([r[0] for r in named.collect()]))
        return table.where(where)

    def search(
        self, query: str, mode: str = "all", limit: int = 50, offset: int = 0, k1: float = 1.2, b: float = 0.75
    ) -> DataFrame:
        """Best rows by BM25, as ``bm25_search`` finds them; lower ``rank`` is better."""
        terms = [w for w in _query_tokens(query) if w]
        if not terms:
            return self._read("rows").select(self.key).limit(0).withColumn("rank", F.lit(0.0))
        slots = terms if mode == "phrase" else list(dict.fromkeys(terms))
        prefix = slots[-1] if mode == "prefix" else None
        exact = slots[:-1] if mode == "prefix" else slots
        gone = self._read("gone").drop("since")
        posts = self._of("postings", exact, prefix).join(gone.select(self.key, "segment"), [self.key, "segment"], "left_anti")
        hits = [F.col("term").startswith(s) if s == prefix and i == len(slots) - 1 else F.col("term") == s for i, s in enumerate(slots)]
        names = [f"tf{i}" for i in range(len(slots))]
        live, less = self._read("rows"), gone
        n, tokens = live.agg(F.count("*"), F.sum("dl")).first()
        n_less, less_tokens = less.agg(F.count("*"), F.sum("dl")).first()
        n, tokens = n - n_less, (tokens or 0) - (less_tokens or 0)
        totals = {"_n": F.lit(n), "_avg": F.lit(tokens / n if n else 0.0)}
        if mode == "phrase":
            at = [F.sort_array(F.flatten(F.collect_list(F.when(h, F.col("places"))))) for h in hits]
            grouped = posts.groupBy(self.key).agg(F.first("dl").alias("dl"), *(a.alias(f"p{i}") for i, a in enumerate(at)))
            starts = [_shifted(F.col(f"p{i}"), i) for i in range(len(slots))]
            counted = grouped.select(self.key, "dl", F.size(reduce(F.array_intersect, starts)).alias("tf0"))
            names = ["tf0"]
        else:
            if mode != "prefix" and not n_less:
                posts = self._promising(posts, slots, hits, names, totals, mode, limit + offset, k1, b)
            sums = (F.coalesce(F.sum(F.when(h, F.col("tf"))), F.lit(0)).alias(m) for h, m in zip(hits, names, strict=True))
            counted = posts.groupBy(self.key).agg(F.first("dl").alias("dl"), *sums)
        if "_dtf0" not in totals:
            found = counted.agg(*(F.count_if(F.col(m) > 0) for m in names)).first()
            totals |= {f"_d{m}": F.lit(found[i]) for i, m in enumerate(names)}
        return _ranked(counted.withColumns(totals), self.key, names, mode, limit, offset, k1, b)

    def _promising(self, posts, slots, hits, names, totals, mode, wanted, k1, b) -> DataFrame:
        """Postings of the length classes that can hold one of the best rows; also fills the counts of ``totals``.

        Nothing is lost: a class is left out only if its bound is below the score of the last wanted row among
        those scored so far. Classes are few, as they grow with the logarithm of the length.
        """
        best = self._of("best", slots, None)
        best = best.groupBy("term", "class").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl"), F.sum("n").alias("n"))
        rows = best.collect()
        counts = {s: sum(r.n for r in rows if r.term == s) for s in slots}
        totals |= {f"_d{m}": F.lit(counts[s]) for s, m in zip(slots, names, strict=True)}
        bound = sum(
            F.coalesce(F.max(F.when(h, _term_score(F.col("tf"), F.lit(counts[s]), F.col("dl"), totals["_n"], totals["_avg"], k1, b))), F.lit(0.0))
            for s, h in zip(slots, hits, strict=True)
        )
        bounds = sorted(((r.bound, r["class"]) for r in best.groupBy("class").agg(bound.alias("bound")).collect()), reverse=True)
        if len(bounds) <= FIRST:
            return posts
        first = posts.where(F.col("class").isin([c for _, c in bounds[:FIRST]]))
        sums = (F.coalesce(F.sum(F.when(h, F.col("tf"))), F.lit(0)).alias(m) for h, m in zip(hits, names, strict=True))
        counted = first.groupBy(self.key).agg(F.first("dl").alias("dl"), *sums).withColumns(totals)
        last = _ranked(counted, self.key, names, mode, wanted, 0, k1, b).agg(F.count("*"), F.max("rank")).first()
        if last[0] < wanted:
            return posts
        # A little slack, as sums in another order may differ in the last digit.
        return posts.where(F.col("class").isin([c for x, c in bounds if x >= -last[1] - 1e-9]))
