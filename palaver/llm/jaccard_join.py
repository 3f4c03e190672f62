"""Similarity join of documents by the Jaccard similarity of their word n-grams, by chosen paths.

Each distinct n-gram set has a fixed-length sketch of MinHash values. A run starts with all sets and samples
sketch coordinates; sets that share a sampled value follow the same path. Buckets that are still large are
split again on further coordinates of their own, small ones are compared by brute force on the sketches.
Runs are repeated until the target recall. What a bucket finds alike is linked, and every linked group is
then joined exactly on the n-grams themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.graph import connected_components
from palaver.llm.scratch import staged
from palaver.llm.tokenize import ragged
from palaver.llm.words import NOT_SPACE, SpanHashes, Words, mix, rolling, steps

GRAM = 5
THRESHOLD = 0.8
SKETCH = 128
#: Sets that a bucket may hold for brute force.
BUCKET = 256
#: Splits of a large bucket, and coordinates that each of its sets follows in a split.
DEPTH, BRANCHES = 2, 2
#: Sets of a stuck bucket, and of those of it that are not linked to most others, that one comparison takes.
LOT = 2048
#: Sets of a linked group that one exact comparison takes; larger groups are compared block by block.
BLOCK = 512
#: Sets of linked groups up to which their keys (40 bytes each) are broadcast; more are shuffled with the texts.
BROADCAST_SETS = 1_000_000
_STEP_BYTES = 1_000_000


def _grams(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, and their number.

    A text of one to four words has one gram of all its words.
    """
    start = words.room(GRAM)
    grams = rolling(h, GRAM)[start]
    owner = np.searchsorted(words.first, start, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < GRAM))
    if len(short):
        whole = SpanHashes(h).of(words.first[short], words.first[short + 1])
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=len(words.counts))


def _sketches(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values (sets x SKETCH) of the sets that begin at ``starts``."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 62, SKETCH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), SKETCH), np.uint32)
    for j, f in enumerate(factors):
        out[:, j] = np.minimum.reduceat(((grams * f) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def row_key(text: str = "text", doc_id: str = "doc_id") -> tuple[F.Column, F.Column]:
    """The key (id, null as 0, and a hash of the text) that rows of equal id and text share."""
    number, body = F.col(f"`{doc_id}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.coalesce(number, F.lit(0)), F.xxhash64(number.isNull(), body)


def _documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Ids and texts with their key."""
    key, h = row_key(text, doc_id)
    number, body = F.col(f"`{doc_id}`").cast("bigint"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(number.alias("doc_id"), key.alias("key"), h.alias("h"), body.alias("text"))


def sketch_documents(source: DataFrame) -> DataFrame:
    """(doc_id, key, h, a, b, n, sketch): the 128-bit name (a, b) of each text's n-gram set, its size and sketch.

    A text without words has no set: its name and size are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", _STEP_BYTES):
            words = Words(batch.column("text"), NOT_SPACE)
            grams, counts = _grams(words, words.hashes())
            has = counts > 0
            starts = (np.cumsum(counts) - counts)[has]
            n = batch.num_rows
            a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
            sketch = np.zeros((n, SKETCH), np.uint32)
            if len(starts):
                a[has] = np.add.reduceat(mix(grams), starts).astype(np.int64)
                b[has] = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).astype(np.int64)
                sketch[has] = _sketches(grams, starts)
            data = pa.py_buffer(sketch.astype("<u4"))
            bounds = pa.py_buffer(np.arange(0, 4 * SKETCH * (n + 1), 4 * SKETCH, dtype=np.int32))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, bounds, data])
            null = ~has
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "key", "h")),
                    pa.array(a, mask=null),
                    pa.array(b, mask=null),
                    pa.array(counts.astype(np.int64), mask=null),
                    raw,
                ],
                names=["doc_id", "key", "h", "a", "b", "n", "sketch"],
            )

    return source.mapInArrow(run, "doc_id long, key long, h long, a long, b long, n long, sketch binary")


def _coordinate(at) -> F.Column:
    """Value of the sketch at a coordinate."""
    return F.substring(F.col("sketch"), (at * 4 + 1).cast("int"), F.lit(4))


def _runs(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold is missed in all with at most ``1 - recall``.

    A run samples one coordinate at the root. Below, a pair that stays in large buckets is lost in a split
    only if it shares none of the sampled coordinates.
    """
    kept = threshold * (1 - (1 - threshold) ** BRANCHES) ** DEPTH
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def _leaves(sets: DataFrame, runs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bucket, sid) of the small buckets and of those that never got small, and the sketches of the sets in any."""
    rng = np.random.default_rng(7)
    roots = rng.choice(SKETCH, size=runs, replace=runs > SKETCH)
    starts = F.array(*(F.struct(F.lit(r).alias("run"), F.lit(int(c)).alias("at")) for r, c in enumerate(roots)))
    level = sets.select("sid", "sketch", F.explode(starts).alias("root")).select(
        "sid", F.xxhash64("root.run", _coordinate(F.col("root.at"))).alias("bucket")
    )
    leaves, live, stuck = [], None, None
    for depth in range(DEPTH + 1):
        level = staged(level)
        sizes = level.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        members = level.join(sizes, "bucket")
        if live is None:
            # Most sets are alone in every bucket; their sketches are not moved again.
            members = staged(members)
            live = staged(sets.select("sid", "sketch").join(members.select("sid").distinct(), "sid"))
        leaves.append(members.where(F.col("size") <= BUCKET).select("bucket", "sid"))
        large = members.where(F.col("size") > BUCKET)
        if depth == DEPTH:
            stuck = large.select("bucket", "sid", F.ceil(F.col("size") / BUCKET).cast("int").alias("blocks"))
            break
        chosen = [
            (F.pmod(F.xxhash64("bucket", F.lit(depth), F.lit(j)), F.lit(SKETCH))).alias("at") for j in range(BRANCHES)
        ]
        level = (
            large.join(live, "sid")
            .select("sid", "bucket", "sketch", F.explode(F.array(*chosen)).alias("at"))
            .select("sid", F.xxhash64("bucket", "at", _coordinate(F.col("at"))).alias("bucket"))
            .distinct()
        )
        if not large.limit(1).count():
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out, stuck, live


def _block_pairs(rest: DataFrame) -> DataFrame:
    """(bucket, sid, joined): large buckets as cells in which every two sets meet that may still need a link.

    ``rest`` has (bucket, sid, c), c being the component so far; without it each set is one. The largest component
    of a bucket is joined already; its other sets are dealt into chunks, and each chunk meets each lot of the whole
    bucket. So rows grow with the sets outside that component, and a bucket of one lot is not copied at all. A bucket
    that is one component gives no rows.
    """
    if "c" not in rest.columns:
        rest = rest.withColumn("c", F.col("sid"))
    parts = rest.groupBy("bucket", "c").agg(F.count("*").alias("n")).groupBy("bucket")
    main = parts.agg(F.sum("n").alias("all"), F.max(F.struct("n", "c")).alias("most")).where("all > most.n").select(
        "bucket",
        F.col("most.c").alias("main"),
        F.ceil(F.col("all") / LOT).cast("int").alias("lots"),
        F.ceil((F.col("all") - F.col("most.n")) / LOT).cast("int").alias("chunks"),
    )
    deal = lambda n: F.pmod(F.xxhash64("sid", "bucket"), F.col(n)).cast("int")
    placed = rest.join(main, "bucket").withColumns({"joined": F.col("c") == F.col("main"), "lot": deal("lots"), "chunk": deal("chunks")})
    as_lot = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.xxhash64("bucket", "lot", j))
    as_chunk = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda i: F.xxhash64("bucket", i, "chunk"))
    cells = F.when(F.col("joined"), as_lot).otherwise(F.array_union(as_lot, as_chunk))
    return placed.select(F.explode(cells).alias("bucket"), "sid", "joined")


def _linked(leaves: DataFrame, stuck: DataFrame | None, live: DataFrame, least: float) -> DataFrame:
    """(node, component): sets that the sketches of any bucket link.

    A large bucket is compared in lots first, each with the bucket's least set. If these links do not join all of
    the bucket, every set outside its largest component is compared with all of the bucket.
    """
    if stuck is None:
        return connected_components(_links(leaves.withColumn("joined", F.lit(False)), live, least))
    stuck = staged(stuck)
    dealt = stuck.select("bucket", "sid", F.pmod(F.xxhash64("sid", "bucket"), F.col("blocks")).cast("int").alias("lot"))
    least_sets = stuck.groupBy("bucket", "blocks").agg(F.min("sid").alias("sid"))
    everywhere = least_sets.select("bucket", "sid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("lot"))
    lots = dealt.unionByName(everywhere).distinct().select(F.xxhash64("bucket", "lot").alias("bucket"), "sid")
    links = staged(_links(leaves.unionByName(lots).withColumn("joined", F.lit(False)), live, least))
    groups = staged(connected_components(links))
    where = stuck.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("component", "sid"))
    cells = staged(_block_pairs(staged(where.select("bucket", "sid", "c"))))
    if not cells.limit(1).count():
        return groups
    return connected_components(links.unionByName(_links(cells, live, least)).distinct())


def _links(leaves: DataFrame, live: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that span what the sketches of a bucket find alike; at most one per set and bucket.

    Sets of a bucket that are ``joined`` are in one component already.
    """

    def forest(sid: np.ndarray, sketch: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
        edges, open_ = [], np.flatnonzero(~joined)
        known = np.flatnonzero(joined)
        while len(open_) + len(known) > 1:
            # The group of the known sets, or of the first one, grows from its newest members until no other is alike.
            group, rest = (known, open_) if len(known) else (open_[:1], open_[1:])
            newest, known = group, known[:0]
            while len(newest) and len(rest):
                near = np.zeros(len(rest), bool)
                for i in newest:
                    near |= (sketch[rest] == sketch[i]).mean(axis=1) >= least
                newest, rest = rest[near], rest[~near]
                group = np.concatenate([group, newest])
            root = sid[group[0]] if joined[group[0]] else sid[group].min()
            group = group[~joined[group]]
            edges.extend((int(s), int(root)) for s in sid[group] if s != root)
            open_ = rest
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = rows.column("bucket").to_numpy()
            cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            stop = len(bucket) if last else (int(cut[-1]) if len(cut) else 0)
            held = rows.slice(stop).combine_chunks().to_batches()
            if not stop:
                return
            sid, joined = rows.column("sid").to_numpy(), rows.column("joined").to_numpy()
            raw = rows.column("sketch").combine_chunks()
            sketch = np.frombuffer(b"".join(raw.to_pylist()), "<u4").reshape(-1, SKETCH)
            bounds = [0, *cut[cut < stop].tolist(), stop]
            edges = [e for i, j in zip(bounds, bounds[1:], strict=False) for e in forest(sid[i:j], sketch[i:j], joined[i:j])]
            if edges:
                u, v = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for row in range(0, batch.num_rows, 2048):
                held.append(batch.slice(row, 2048))
                yield from flush(False)
        yield from flush(True)

    rows = leaves.join(live, "sid").repartition("bucket").sortWithinPartitions("bucket", "sid")
    return rows.select("bucket", "sid", "joined", "sketch").mapInArrow(run, "u long, v long").distinct()


def _compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
    """Pairs of numbers (i, j) at the threshold, row by row: yields i and the numbers j.

    Without ``right`` the sets are compared among themselves, each pair once (i < j).
    """
    other = left if right is None else right
    sizes = np.array([len(x) for x in other])
    pool = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    for i, x in enumerate(left):
        low, high = np.searchsorted(pool, x), np.searchsorted(pool, x, "right")
        common = np.bincount(owner[ragged(low, high - low)], minlength=len(other))
        alike = common >= threshold * (len(x) + sizes - common)
        if right is None:
            alike[: i + 1] = False
        yield i, np.flatnonzero(alike)


def _exact(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (sid, other, links): edges of a spanning forest with ``links`` 0, and counts with ``other`` null.

    ``members`` has (cell, side, sid, grams). A cell holds one block of a group (side 0), or two (0 and 1).
    """

    def solve(side: np.ndarray, sid: np.ndarray, sets: list[np.ndarray]):
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = np.zeros(len(sid), np.int64)
        parent = np.arange(len(sid))
        edges = []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        pairs = _compare([sets[k] for k in a], [sets[k] for k in b] if len(b) else None, threshold)
        for i, found in pairs:
            where = b[found] if len(b) else a[found]
            links[a[i]] += len(where)
            links[where] += 1
            for j in where.tolist():
                x, y = root(int(a[i])), root(j)
                if x != y:
                    parent[x] = y
                    edges.append((int(sid[a[i]]), int(sid[j])))
        return edges, links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            cell = rows.column("cell").to_numpy()
            cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            stop = len(cell) if last else (int(cut[-1]) if len(cut) else 0)
            held = rows.slice(stop).combine_chunks().to_batches()
            if not stop:
                return
            sid, side = rows.column("sid").to_numpy(), rows.column("side").to_numpy()
            grams = rows.column("grams").combine_chunks()
            flat, at = grams.flatten().to_numpy(), grams.offsets.to_numpy() - grams.offsets[0].as_py()
            bounds = [0, *cut[cut < stop].tolist(), stop]
            for i, j in zip(bounds, bounds[1:], strict=False):
                edges, links = solve(side[i:j], sid[i:j], [flat[at[k] : at[k + 1]] for k in range(i, j)])
                counted = np.flatnonzero(links)
                u = [e[0] for e in edges] + sid[i:j][counted].tolist()
                v = [e[1] for e in edges] + [None] * len(counted)
                n = [0] * len(edges) + links[counted].tolist()
                if u:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())],
                        names=["sid", "other", "links"],
                    )

        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                held.append(batch.slice(row, 256))
                yield from flush(False)
        yield from flush(True)

    rows = members.repartition("cell").sortWithinPartitions("cell", "side", "sid")
    return rows.select("cell", "side", "sid", "grams").mapInArrow(run, "sid long, other long, links long")


def _with_grams(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (sid, component and the key of a row of the set) with the set's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", _STEP_BYTES):
            words = Words(batch.column("text"), NOT_SPACE)
            grams, counts = _grams(words, words.hashes())
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(grams.view(np.int64)))
            a = np.zeros(batch.num_rows, np.int64)
            has = counts > 0
            if has.any():
                a[has] = np.add.reduceat(mix(grams), bounds[:-1][has]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), batch.column("component"), pa.array(a), batch.column("a"), lists],
                names=["sid", "component", "own", "a", "grams"],
            )

    keys = wanted.select("key", "h", "a", "sid", "component")
    small = keys.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    texts = source.join(F.broadcast(keys) if small else keys, ["key", "h"])
    found = texts.select("text", "a", "sid", "component").mapInArrow(
        run, "sid long, component long, own long, a long, grams array<long>"
    )
    return found.where("own = a").select("sid", "component", "grams").dropDuplicates(["sid"])


def jaccard_join(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = THRESHOLD,
    recall: float = 0.9999,
) -> DataFrame:
    """(doc_id, class_id, set_id, n_copies, n_links): one row per input row.

    Words are runs of anything but ASCII white space, and a set holds a text's runs of five words; one to four
    words are one run. ``set_id`` is the least id with the same set and ``n_copies`` their number.
    ``n_links`` counts the other sets whose Jaccard similarity is ``threshold`` or more, and ``class_id`` is
    the least id of the connected sets. Pairs are counted where they are compared and never written out.
    A text that is null or has no words has no set: it is its own class with no copies and no links.
    Rows with null ids take part; their ids in the result are null unless a row with an id is in the class.
    Repeated rows are copies. Other columns are not read. An empty
    table gives no rows. Links found are exact; the share of links found is ``recall`` at the threshold and
    higher above it, as any chain of links joins a group before the exact comparison.
    """
    return classes(docs, text=text, doc_id=doc_id, threshold=threshold, recall=recall).drop("key", "h", "class")


def classes(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    threshold: float = THRESHOLD,
    recall: float = 0.9999,
) -> DataFrame:
    """The rows of ``jaccard_join`` with (key, h) of ``row_key`` and the number of their ``class``.

    Classes that share an id, or have none, have numbers of their own; a text without words has none.
    """
    source = _documents(docs, text, doc_id)
    sketched = staged(sketch_documents(source))
    sets = staged(
        sketched.where("a is not null")
        .groupBy("a", "b")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct("key", "h")).alias("row"),
            F.count("*").alias("n_copies"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("sid", F.monotonically_increasing_id())
    )
    # Sketches estimate a similarity with a deviation of at most 0.045, so three deviations are allowed.
    spread = math.sqrt(threshold * (1 - threshold) / SKETCH)
    leaves, stuck, live = _leaves(sets, _runs(recall, threshold))
    groups = _linked(leaves, stuck, live, threshold - 3 * spread)
    wanted = staged(
        groups.select(F.col("node").alias("sid"), "component").join(sets.select("sid", "row.key", "row.h", "a"), "sid")
    )
    grams = staged(_with_grams(source, wanted))
    cells = _cells(grams)
    found = staged(_exact(cells, threshold))
    joined = connected_components(found.where("other is not null").select(F.col("sid").alias("u"), F.col("other").alias("v")))
    counts = found.where("other is null").groupBy("sid").agg(F.sum("links").alias("n_links"))
    named = (
        sets.select("sid", "a", "b", F.col("doc_id").alias("set_id"), "n_copies")
        .join(counts, "sid", "left")
        .join(joined.select(F.col("node").alias("sid"), "component"), "sid", "left")
    )
    # The class takes the least id of its sets.
    least = named.groupBy("component").agg(F.min("set_id").alias("class_id")).where("component is not null")
    named = named.join(least, "component", "left").select(
        "a", "b", F.coalesce("component", "sid").alias("class"), F.coalesce("class_id", "set_id").alias("class_id"), "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    return sketched.select("doc_id", "key", "h", "a", "b").join(named, ["a", "b"], "left").select(
        "doc_id",
        "key",
        "h",
        "class",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("set_id", "doc_id").alias("set_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def _cells(grams: DataFrame) -> DataFrame:
    """Sets of each linked group dealt into cells of one or two blocks, so that each pair meets once."""
    sizes = grams.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = grams.join(sizes, "component").withColumn(
        "block", F.pmod(F.xxhash64("sid", F.lit(11)), F.col("blocks")).cast("int")
    )
    # Block i is side 0 of the cells (i, j) with j >= i, and side 1 of the cells (j, i) with j < i.
    every = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.xxhash64("component", F.least(j, F.col("block")), F.greatest(j, F.col("block"))).alias("cell"),
            F.when(j >= F.col("block"), 0).otherwise(1).alias("side"),
        ),
    )
    return placed.select("sid", "grams", F.explode(every).alias("c")).select("c.cell", "c.side", "sid", "grams")
