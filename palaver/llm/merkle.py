"""Merkle manifest of a table: levels stored as parent-linked rows, proofs climbed by a recursive query.

Rows are leaves, in one tree for each group and one tree over the groups. A tree is built in storeys of six
levels; a stored node row links a node to its ancestor six levels above and holds the siblings on the way. A
Spark recursive query starts at each leaf, takes one storey a step, appends the siblings and folds the hash.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.llm.ranks import bounded, numbered
from palaver.llm.scratch import staged

#: Levels of a storey. A node row has so many siblings, and is shared by the leaves below it.
LEVELS = 6
FAN = 1 << LEVELS
#: Rows that one row is expanded to at once.
EXPAND = 1 << 16

_PAIR = "unhex(sha2(concat({}, {}), 256))"
_LIFT = _PAIR.format("lower(hex(a[2 * i]))", "coalesce(lower(hex(get(a, 2 * i + 1))), '')")
#: Hashes of all levels of a block, from those of its lowest level.
_ALL_LEVELS = f"""aggregate(array_repeat(0, k), array(hashes), (all, _) -> concat(all, array(transform(
    sequence(0, (size(element_at(all, -1)) - 1) div 2),
    i -> {_LIFT.replace("a[", "element_at(all, -1)[").replace("get(a", "get(element_at(all, -1)")}))))"""
#: Siblings of member j, from below: null where a node is alone in its run.
_PATH = """transform(array_repeat(0, k), (_, l) -> named_struct(
    'sibling', get(levels[l], shiftright(j, l) ^ 1), 'left', shiftright(j, l) & 1 = 1))"""
_FOLD = f"""aggregate({{path}}, {{start}}, (h, p) -> CASE WHEN p.left THEN {_PAIR.format("lower(hex(p.sibling))", "lower(hex(h))")}
    ELSE {_PAIR.format("lower(hex(h))", "coalesce(lower(hex(p.sibling)), '')")} END)"""

_APPEND = "aggregate({path}, {start}, (s, p) -> concat(s, coalesce(p.sibling, X'')))"

CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT tree, 1 AS storey, pos div {FAN} AS block, false AS done, doc_id, hash AS leaf,
    {_FOLD.format(path="path", start="start")} AS folded, {_APPEND.format(path="path", start="X''")} AS siblings,
    CAST(NULL AS BINARY) AS subroot FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.storey + 1, c.block, n.top, c.doc_id, c.leaf,
    {_FOLD.format(path="n.path", start="c.folded")}, {_APPEND.format(path="n.path", start="c.siblings")}, n.subroot
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.storey = n.storey AND c.block = n.block
)
SELECT doc_id, leaf, folded, siblings, subroot FROM climb WHERE done
"""


PATH = "array<struct<sibling:binary,left:boolean>>"
NODE = f"tree bigint, storey int, block bigint, path {PATH}, top boolean, subroot binary"


class Manifest(NamedTuple):
    """``leaves``: the lowest storey, a node row for each input row. ``nodes``: those above. ``root``: hex."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def record_hash(*fields: Column) -> Column:
    """SHA-256 (hex) of a record: each field as its count of UTF-8 bytes, a colon and its value; null is ``-``."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _storeys(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Storeys from (tree, pos, size, hash) upward: (tree, storey, pos, hash, path, top, up), one row for each node.

    ``up`` is the hash of the ancestor one storey above; ``top`` tells that this is the root of the tree. Other
    columns stay with the lowest nodes.
    """
    more = [c for c in nodes.columns if c not in ("tree", "size", "pos", "hash")]
    out = []
    for storey in itertools.count():
        here = F.col("size") <= FAN
        blocks = (
            nodes.groupBy("tree", "size", F.expr(f"pos div {FAN}").alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *more))).alias("members"))
            .withColumn("hashes", F.col("members.hash"))
            .withColumn("k", F.when(here, F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)).otherwise(LEVELS))
            .withColumn("levels", F.expr(_ALL_LEVELS))
        )
        rows = blocks.select(
            "tree", "size", "block", "levels", "k", here.alias("top"),
            F.element_at(F.element_at("levels", -1), 1).alias("up"), F.posexplode("members").alias("j", "m"),
        )
        rows = rows.select(
            "tree", "size", F.lit(storey).alias("storey"), "m.pos", "m.hash", F.expr(_PATH).alias("path"), "top", "up",
            *(f"m.{c}" for c in more),
        )
        out.append(staged(rows))
        nodes = out[-1].where(~F.col("top") & (F.col("pos") % FAN == 0)).select(
            "tree", F.expr(f"pos div {FAN}").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), F.col("up").alias("hash")
        )
        if largest <= FAN:
            return out
        largest, more = -(-largest // FAN), []


def _for_blocks(rows: DataFrame) -> DataFrame:
    """One copy of a node row for each block of leaves below it, ``first_block`` to ``last_block``.

    So each copy meets at most ``FAN`` leaves in a join, even the ones at the top of the largest tree. The long
    ranges are cut into parts, which are dealt out before they are expanded.
    """
    parts = rows.select("*", F.explode(F.sequence("first_block", "last_block", F.lit(EXPAND))).alias("part"))
    parts = parts.repartition("tree", "storey", "part")
    return parts.select(
        "tree", "storey", F.explode(F.sequence("part", F.least("last_block", F.col("part") + EXPAND - 1))).alias("block"),
        "path", "top", "subroot",
    )


def _crowns(groups: DataFrame, count: int) -> tuple[DataFrame, str]:
    """The path of each group's root through the tree of all groups, and the root of that."""
    nodes = groups.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("size"), F.col("subroot").alias("hash"))
    found = groups.select("tree", "subroot", "leaves", F.array().cast(PATH).alias("path"))
    for i, storey in enumerate(_storeys(nodes, count)):
        up = storey.select(F.col("pos").alias("_pos"), F.col("path").alias("_path"))
        at = F.expr(f"tree div {FAN**i}") == F.col("_pos")
        found = found.join(bounded(up), at).select("tree", "subroot", "leaves", F.concat("path", "_path").alias("path"))
        root = storey.where("top").select("up").first()
    return found, root.up.hex()


def build(docs: DataFrame, *, fields: list[str], group: str, order: str, start: Column | None = None) -> Manifest:
    """Manifest of ``docs``: leaves by ``group``, in it by ``order``, then by their hash.

    A leaf is the ``record_hash`` of ``fields``; ``start`` is the hash (hex) with which its climb begins, that of
    a changed row, and else the leaf. Null is a group of its own and sorts first; a null ``order`` comes first.
    Repeated rows are leaves of their own. Texts of any length are hashed whole, in one pass. Other columns take
    no part, whatever their names. An empty table has no root.
    """
    leaf = record_hash(*(F.col(f"`{f}`") for f in fields))
    rows = docs.select(
        F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("doc_id"), F.unhex(leaf).alias("leaf"),
        F.unhex(leaf if start is None else start).alias("start"),
    )
    rows = staged(numbered(rows, ["grp"], ["doc_id", "leaf"]))
    groups = staged(rows.where("pos = 0").select("grp", F.col("size").alias("leaves")))
    groups = numbered(groups, [], ["grp"]).select(F.col("grp").alias("_grp"), F.col("pos").alias("tree"), "leaves")
    groups = staged(groups)
    leaves = rows.join(bounded(groups.drop("leaves")), F.col("grp").eqNullSafe(F.col("_grp")))
    count, largest = groups.agg(F.count("*"), F.max("leaves")).first()
    if not count:
        none = leaves.select("tree", "pos", F.col("leaf").alias("hash"), "doc_id", "start", F.array().cast(PATH).alias("path"))
        return Manifest(none, leaves.sparkSession.createDataFrame([], NODE), None)
    storeys = _storeys(leaves.select("tree", "pos", "size", F.col("leaf").alias("hash"), "doc_id", "start"), largest)
    tops = [s.where("top and pos = 0").select("tree", F.col("storey").alias("storeys"), F.col("up").alias("subroot")) for s in storeys]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    groups = staged(groups.join(bounded(subroots), "tree"))
    crowns, root = _crowns(groups, count)
    none = F.lit(None).cast("binary").alias("subroot")
    last = F.ceil(F.col("leaves") / FAN) - 1
    shared = crowns.join(bounded(groups.select("tree", "storeys")), "tree").select(
        "tree", (F.col("storeys") + 1).alias("storey"), F.lit(0).cast("long").alias("first_block"), last.alias("last_block"), "path", F.lit(True).alias("top"), "subroot"
    )
    sizes = bounded(groups.select("tree", "leaves"))
    for i, storey in enumerate(storeys[1:], 1):
        width = FAN ** (i - 1)
        upper = storey.join(sizes, "tree").select(
            "tree", "storey", (F.col("pos") * width).alias("first_block"),
            F.least((F.col("pos") + 1) * width - 1, last).alias("last_block"), "path", F.lit(False).alias("top"), none,
        )
        shared = shared.unionByName(upper)
    return Manifest(storeys[0], staged(_for_blocks(shared)), root)


def climb(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, folded, siblings, subroot) of each leaf, all binary: what its climb to the root gives.

    ``folded`` is the root that follows from the leaf's ``start`` and the stored siblings; ``siblings`` are their
    hashes one after another, from below. The result is written, as Spark's limit for the rows of a recursive
    query is lifted only while it runs; the steps are as many as the storeys.
    """
    spark, limit = manifest.leaves.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)
    try:
        return staged(spark.sql(CLIMB, leaves=manifest.leaves, nodes=bounded(manifest.nodes)))
    finally:
        spark.conf.set(limit, before)
