"""Matching windows of speech to enrolled voices, and spans where the windows agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.functions.vectors import dot
from palaver.operators.ordered import running
from palaver.operators.sessions import islands

# Up to this many vector elements the enrolled voices travel to every task as one matrix.
BROADCAST_ELEMENTS = 8_000_000
SHARD = 1024
#: Similarities that a task holds at a time; vectors are scored in steps of so many rows.
STEP_ELEMENTS = 1_000_000


def enabled(profiles: DataFrame, model: str | None = None) -> DataFrame:
    out = profiles.filter("enabled")
    return out if model is None else out.filter(F.col("model") == model)


def best_and_second(
    vectors: DataFrame,
    profiles: DataFrame,
    key: str = "vec_id",
    broadcast_elements: int = BROADCAST_ELEMENTS,
) -> DataFrame:
    """Per vector: most similar voice by its best prototype, that similarity, and the next voice's.

    The size of the prototype set is checked first. A small set is sent out as a matrix and scored
    batch by batch. A large set is cut into shards; every shard keeps its two best voices per
    vector, and the shards' lists are merged. Both ways are exact.
    """
    protos = profiles.select("name", F.col("embedding").cast("array<double>").alias("embedding"))
    n, elements = protos.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    if elements <= broadcast_elements:
        return _by_matrix(vectors, protos, key)
    return _by_shards(vectors, protos, key, -(-n // SHARD))


def two_best(vectors: pd.Series, group: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best voice of each vector, its similarity and the next voice's (NaN if there is none).

    ``matrix`` has the prototypes, ``group`` the ascending number of each one's voice. Of equal voices the first
    wins. Similarities are made for a few vectors at a time, so memory does not grow with the prototypes.
    """
    n = len(vectors)
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    top, best, second = np.empty(n, np.int64), np.empty(n), np.full(n, np.nan)
    rows = max(1, STEP_ELEMENTS // len(matrix))
    for low in range(0, n, rows):
        part = slice(low, low + rows)
        sims = np.stack(vectors.iloc[part].to_numpy()).astype(np.float64) @ matrix.T
        per = np.maximum.reduceat(sims, first, axis=1)
        at = np.arange(len(per))
        top[part] = per.argmax(axis=1)
        best[part] = per[at, top[part]]
        if per.shape[1] > 1:
            per[at, top[part]] = -np.inf
            second[part] = per.max(axis=1)
    return top, best, second


def _by_matrix(vectors: DataFrame, protos: DataFrame, key: str) -> DataFrame:
    rows = protos.orderBy("name").collect()  # size checked by the caller
    names = sorted({r["name"] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    group = np.array([number[r["name"]] for r in rows], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((names, group, matrix))
    kind = T.StructType(
        [
            T.StructField("best_name", T.StringType()),
            T.StructField("best", T.DoubleType()),
            T.StructField("second", T.DoubleType()),
        ]
    )

    @F.pandas_udf(kind)
    def match(v: pd.Series) -> pd.DataFrame:
        who, of, m = shared.value
        if len(v) == 0 or len(who) == 0:
            nothing = [None] * len(v)
            return pd.DataFrame({"best_name": nothing, "best": nothing, "second": nothing})
        top, best, second = two_best(v, of, m)
        return pd.DataFrame(
            {
                "best_name": [who[i] for i in top],
                "best": best,
                "second": pd.Series(second).where(pd.notna(second), None),
            }
        )

    return vectors.withColumn("_m", match("embedding")).select(
        *[c for c in vectors.columns if c != "embedding"], "_m.best_name", "_m.best", "_m.second"
    )


def _by_shards(vectors: DataFrame, protos: DataFrame, key: str, shards: int) -> DataFrame:
    """Two best voices of each vector per shard, then merged: no row for a pair of vector and voice."""
    slim = vectors.select(key, "embedding")
    found = None
    for n in range(shards):
        # A voice stays whole within its shard, so its best prototype is known there.
        some = protos.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == n)
        part = _by_matrix(slim, some, key).filter("best_name is not null")
        found = part if found is None else found.unionByName(part)
    ranked = F.struct((-F.col("best")).alias("o"), F.col("best_name"), F.col("best"), F.col("second"))
    tops = found.groupBy(key).agg(F.sort_array(F.collect_list(ranked)).alias("_t"))
    first, other = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    merged = tops.select(
        key,
        first["best_name"].alias("best_name"),
        first["best"].alias("best"),
        F.greatest(first["second"], other["best"]).alias("second"),
    )
    return vectors.drop("embedding").join(merged, key, "left")


def decide(matched: DataFrame, threshold: float = 0.80, margin: float = 0.08) -> DataFrame:
    """Add ``reason`` and the accepted ``speaker``: none enrolled, unknown, ambiguous or matched."""
    gap = F.col("best") - F.coalesce("second", F.lit(-1.0))
    reason = (
        F.when(F.col("best_name").isNull(), "no_enrolled_speakers")
        .when(F.col("best") < threshold, "unknown_or_media")
        .when(gap < margin, "ambiguous_or_overlap")
        .otherwise("matched")
    )
    return matched.withColumn("reason", reason).withColumn(
        "speaker", F.when(F.col("reason") == "matched", F.col("best_name"))
    )


def window_reasons(decided: DataFrame, key: str = "source_id") -> DataFrame:
    """Windows per source and reason."""
    return decided.groupBy(key, "reason").agg(F.count("*").alias("n"))


def reason_maps(decided: DataFrame, key: str = "source_id") -> DataFrame:
    return window_reasons(decided, key).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("window_reasons")
    )


def sliding_windows(
    df: DataFrame, length: str = "n_samples", window: int = 32_000, hop: int = 16_000
) -> DataFrame:
    """Window starts over each recording, the last one aligned to its end. Short ones give none."""
    last = F.col(length) - window
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last, F.lit(hop).cast("bigint")))
    tail = F.when((last >= 0) & (last % hop != 0), F.array(last)).otherwise(
        F.array().cast("array<bigint>")
    )
    return df.withColumn("w_start", F.explode(F.concat(starts, tail))).withColumn(
        "w_end", F.col("w_start") + window
    )


def span_voting(
    windows: DataFrame,
    source: str = "source_id",
    hop: int = 16_000,
    length: str = "n_samples",
    min_samples: int = 25_600,
) -> DataFrame:
    """Spans where all windows over each core agree on one speaker.

    ``windows`` has w_start, w_end, speaker (null when rejected), similarity and the recording
    length. Each window names the cores it covers, so votes meet in an equi-aggregation; adjacent
    cores of one speaker coalesce, and spans under ``min_samples`` are dropped.
    """
    first = F.expr(f"w_start div {hop}")
    last = F.expr(f"(w_end - 1) div {hop}")
    votes = windows.withColumn("core", F.explode(F.sequence(first, last))).groupBy(source, "core").agg(
        F.bool_and(F.col("speaker").isNotNull()).alias("_all"),
        F.min("speaker").alias("speaker"),
        F.max("speaker").alias("_other"),
        F.min("similarity").alias("similarity"),
        F.max(length).alias("_len"),
    )
    admitted = votes.filter(
        F.col("_all") & (F.col("speaker") == F.col("_other")) & (F.col("core") * hop < F.col("_len"))
    )
    runs = islands(admitted, [source, "speaker"], "core")
    spans = runs.groupBy(source, "speaker", "island").agg(
        (F.min("core") * hop).alias("start_sample"),
        F.least((F.max("core") + 1) * hop, F.max("_len")).alias("end_sample"),
        F.min("similarity").alias("similarity"),
    )
    return spans.filter(F.col("end_sample") - F.col("start_sample") >= min_samples).drop("island")


def vector_mean(
    df: DataFrame, key: str, vector: str = "embedding", weight: str | None = None
) -> DataFrame:
    """Element-wise mean per key, scaled to unit length. Sums merge map-side by (key, position)."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    each = df.select(key, w.alias("_w"), F.posexplode(vector).alias("_p", "_v"))
    mean = each.groupBy(key, "_p").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_m"))
    vec = mean.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("_vec")
    )
    from palaver.functions.text import let
    from palaver.functions.vectors import norm

    return vec.select(
        key,
        let(norm(F.col("_vec")), lambda n: F.transform(F.col("_vec"), lambda v: v / n)).alias("mean"),
    )


def enrollment_quality(
    blocks: DataFrame, key: str, min_voiced_s: float = 10.0, window_s: float = 2.0
) -> DataFrame:
    """Accept or reject an enrollment from its window vectors.

    ``blocks`` has one row per window with ``block``, ``clipped`` share and ``embedding``. The
    consistency is the median similarity of the windows to their common centre.
    """
    centre = vector_mean(blocks, key)
    sim = dot(F.col("embedding"), F.col("mean"))
    g = (
        blocks.join(centre, key)
        .groupBy(key)
        .agg(
            F.count("*").alias("window_count"),
            F.count_distinct("block").alias("prototype_count"),
            F.avg("clipped").alias("clipping_fraction"),
            F.percentile(sim, 0.5).alias("self_consistency"),
        )
        .withColumn("voiced_seconds", F.col("window_count") * F.lit(window_s))
    )
    reason = (
        F.when(F.col("clipping_fraction") > 0.03, "clipping")
        .when(
            (F.col("voiced_seconds") < min_voiced_s)
            | (F.col("window_count") < 5)
            | (F.col("prototype_count") < 2),
            "not_enough_speech",
        )
        .when(F.col("self_consistency") < 0.70, "inconsistent")
        .otherwise("accepted")
    )
    return g.withColumn("verdict", reason)


def zscore_match(features: DataFrame, profiles: DataFrame, key: str, shard_profiles: int = 10_000) -> DataFrame:
    """Best Gaussian profile per row by weighted z-scores of pitch and spectral centroid.

    The profiles are counted and cut into shards of about ``shard_profiles``. Each shard is one array that
    every row scores, and the best of the shards is the result. ``key`` names a row.
    """
    shards = max(1, -(-profiles.count() // shard_profiles))

    def score(p):
        zp = F.abs(F.col("pitch") - p["pitch_mean"]) / p["pitch_std"]
        zc = F.abs(F.col("centroid") - p["centroid_mean"]) / p["centroid_std"]
        s = F.greatest(F.lit(0.0), 1.0 - (0.7 * zp + 0.3 * zc) / (2.0 * p["multiplier"]))
        ok = (F.col("pitch") > 0) & (F.col("centroid") > 0) & (p["pitch_std"] > 0) & (p["centroid_std"] > 0)
        return F.struct(
            F.when(ok, s).otherwise(0.0).alias("s"),
            F.when(ok, zp <= p["multiplier"]).otherwise(False).alias("near"),
            p["name"].alias("name"),
        )

    profile = F.struct("name", "pitch_mean", "pitch_std", "centroid_mean", "centroid_std", "multiplier")
    rows = None
    for i in range(shards):
        packed = profiles.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == i).agg(F.collect_list(profile).alias("_ps"))
        part = features.join(F.broadcast(packed)).withColumn("_b", F.array_max(F.transform("_ps", score))).drop("_ps")
        rows = part if rows is None else rows.unionByName(part)
    if shards > 1:
        tops = rows.groupBy(key).agg(F.max("_b").alias("_b"))
        rows = features.join(tops, key)
    good = (F.col("voiced_ratio") >= 0.1) & (F.col("_b.s") >= 0.5)
    hit = good & F.col("_b.near")
    return rows.select(
        key,
        F.when(hit, F.col("_b.name")).otherwise("unknown").alias("speaker"),
        F.when(F.col("voiced_ratio") < 0.1, 0.0)
        .when(hit, F.col("_b.s"))
        .otherwise(1.0 - F.col("_b.s"))
        .alias("confidence"),
    )


def lag_correlation(df: DataFrame, key: str, order: str, vector: str = "embedding", at: float = 0.7) -> DataFrame:
    """Mean correlation of neighbouring vectors per key; above ``at`` the sound repeats itself."""
    from palaver.functions.vectors import pearson

    rows = running(df, [key], [order], {"_prev": ("last", F.col(vector))}, slot_us=100_000)
    r = F.when(F.col("_prev").isNotNull(), pearson(F.col("_prev"), F.col(vector)))
    return (
        rows.withColumn("_r", r)
        .groupBy(key)
        .agg(F.avg("_r").alias("mean_r"))
        .withColumn("repetitive", F.coalesce(F.col("mean_r") > at, F.lit(False)))
    )
