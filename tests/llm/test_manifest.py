import hashlib

import pytest
from pyspark.sql import functions as F

from palaver.llm import merkle

FIELDS = ["doc_id", "lang", "text"]
SCHEMA = "doc_id bigint, lang string, text string, tree string, pos string, size string, grp int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def record(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def climbed(tree, pos, start):
    siblings = []
    for level in tree[:-1]:
        if pos ^ 1 < len(level):
            other = level[pos ^ 1]
            siblings.append(other)
            start = sha(other, start) if pos % 2 else sha(start, other)
        else:
            start = sha(start)
        pos //= 2
    return siblings, start


def brute(rows, bad):
    langs = sorted({r[1] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = [(r[0] is not None, r[0] or 0, record(*r[:3]), record(*bad(r)[:3]), r[0]) for r in rows if r[1] == lang]
        trees.append(sorted(own))
    built = [levels([x[2] for x in t]) for t in trees]
    over = levels([b[-1][0] for b in built])
    out = []
    for i, tree in enumerate(trees):
        for pos, (_, _, leaf, start, doc) in enumerate(tree):
            first, mid = climbed(built[i], pos, start)
            rest, end = climbed(over, i, mid)
            out.append((doc, leaf, built[i][-1][0], over[-1][0], sha(*first, *rest), end))
    return sorted(out, key=repr)


def got(spark, frame, rows):
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    start = merkle.record_hash(F.col("doc_id"), F.col("lang"), changed)
    docs = frame([(*r, "x", None, "y", 1) for r in rows], SCHEMA)
    m = merkle.build(docs, fields=FIELDS, group="lang", order="doc_id", start=start)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "siblings", "folded")]
    found = merkle.climb(m).select("doc_id", *hexed).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, m.root, sha(r.siblings), r.folded) for r in found), key=repr)


def bad(r):
    return (r[0], r[1], r[2] + "!") if r[0] is not None and r[0] % 3 == 0 and r[2] is not None else r


def test_manifest_equals_plain_trees(spark, frame):
    rows = [(i, "en", f"text {i}") for i in range(4200)]
    rows += [(i, "de", "ü" * (i % 5)) for i in range(65)] + [(i, "fr", None) for i in range(64)]
    rows += [(1, None, "a"), (None, None, "b"), (None, None, None), (7, "é", ""), (7, "x", "long " * 100_000), (7, "x", "twice"), (7, "x", "twice")]
    assert got(spark, frame, rows) == brute(rows, bad)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_trees(spark, frame, n):
    rows = [(i, str(i), "t") for i in range(n)]
    assert got(spark, frame, rows) == brute(rows, bad)


def test_many_groups_have_several_storeys(spark, frame):
    rows = [(i, f"g{i:03d}", "t") for i in range(70)]
    assert got(spark, frame, rows) == brute(rows, bad)


def test_empty_table(spark, frame):
    assert got(spark, frame, []) == []


def test_limit_of_recursion_is_put_back(spark, frame):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got(spark, frame, [(1, "en", "x")])
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
