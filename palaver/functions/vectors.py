"""Arithmetic on sample and embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def mean_square(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(0.0)


def rms_db(a: Column, floor_db: float = -100.0, tiny: float = 1e-10) -> Column:
    """Level in dB, ``floor_db`` for empty or silent input."""
    rms = F.sqrt(mean_square(a))
    return F.when(rms < tiny, floor_db).otherwise(F.lit(20.0) * F.log10(rms))


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))


def normalize_gain(a: Column, target_db: float, silent_db: float = -60.0) -> Column:
    """Scale to the target level unless nearly silent, then limit the peak to 0.99."""
    db = rms_db(a)

    def limited(x):
        top = peak(x)
        return let(top, lambda m: F.when(m > 0.99, F.transform(x, lambda v: v / m * 0.99)).otherwise(x))

    gain = F.pow(F.lit(10.0), (F.lit(target_db) - db) / 20.0)
    scaled = let(gain, lambda g: F.transform(a, lambda v: v * g))
    return F.when(db < silent_db, a).otherwise(let(scaled, limited))


def level_quality(amplitude: Column) -> Column:
    return (
        F.when(amplitude < 0.05, "too_low")
        .when(amplitude < 0.3, "acceptable")
        .when(amplitude < 0.8, "good")
        .otherwise("clipping")
    )


def noise_profile(a: Column) -> dict[str, Column]:
    """Level of a silent recording and the detection threshold it suggests."""
    rms = F.sqrt(mean_square(a))
    return {
        "rms": rms,
        "max_amplitude": peak(a),
        "threshold": F.least(F.greatest(rms * 5.0, F.lit(0.3)), F.lit(0.7)),
        "floor_db": rms_db(a),
    }


def similarity_to_confidence(s: Column, threshold: float) -> Column:
    """1 from similarity 1 on, 0 up to the threshold, one half to one in between."""
    t = F.lit(threshold)
    return F.when(s >= 1.0, 1.0).when(s <= t, 0.0).otherwise(0.5 + (s - t) / (2.0 * (1.0 - t)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equal-length arrays, null where either is constant."""
    n = F.size(a)
    sa = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    sb = F.aggregate(b, F.lit(0.0), lambda s, v: s + v)
    cov = dot(a, b) - sa * sb / n
    va = dot(a, a) - sa * sa / n
    vb = dot(b, b) - sb * sb / n
    return F.when((va > 1e-15) & (vb > 1e-15), cov / F.sqrt(va * vb))
