"""Running values over long ordered keys without one task per key.

A plain window puts all rows of a key into one task. Here the rows of a key are cut into time
slots. Each slot runs its own window, one summary row per (key, slot) carries the state from slot
to slot, and the two are joined on (key, slot). A key that holds a third of all rows is spread over
as many tasks as it has slots, and only slot summaries meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.functions.timefmt import floor_div

SLOT_US = 6 * 3600 * 1_000_000


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Add running columns over each key in the given order.

    ``order`` starts with a time in microseconds and must be unique per key. Each spec is
    ``name: (kind, column)`` with kind ``last`` (latest non-null value), ``max`` or ``sum``. Rows
    before the current one count, and the current one as well when ``inclusive``. ``last`` and
    ``max`` are null, and ``sum`` is 0, where nothing came before.
    """
    src = {f"_v_{n}": c for n, (_, c) in specs.items()}
    base = df.withColumns({"_key": slot_key(keys, order[0], slot_us), **src})
    w = Window.partitionBy("_key").orderBy(*order)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = slots_in_order(keys).rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carry, final = {}, [], {}, {}
    for n, (kind, _) in specs.items():
        v, at = F.col(f"_v_{n}"), F.struct(*order)
        if kind == "last":
            local[f"_l_{n}"] = F.last(v, ignorenulls=True).over(w)
            summary.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_s_{n}"))
            carry[f"_c_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(across)
            final[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
        elif kind == "max":
            local[f"_l_{n}"] = F.max(v).over(w)
            summary.append(F.max(v).alias(f"_s_{n}"))
            carry[f"_c_{n}"] = F.max(f"_s_{n}").over(across)
            final[n] = F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}"))
        elif kind == "sum":
            local[f"_l_{n}"] = F.sum(v).over(w)
            summary.append(F.sum(v).alias(f"_s_{n}"))
            carry[f"_c_{n}"] = F.sum(f"_s_{n}").over(across)
            zero = F.lit(0)
            final[n] = F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)
        else:
            raise ValueError(f"unknown kind {kind}")
    edges = unpacked(base.groupBy(F.col("_key").alias("_edge")).agg(*summary), keys)
    edges = edges.withColumns(carry).select("_edge", *carry)
    out = base.withColumns(local).join(edges, F.col("_key") == F.col("_edge")).withColumns(final)
    return out.select(*[c for c in df.columns if c not in specs], *specs)


def slot_key(keys: list[str], time: str, slot_us: int) -> Column:
    """Key columns and time slot as one struct.

    The struct is never null and its equality treats null fields as equal, so windows, summaries and
    the join share one plain hash partitioning, and rows with a null key stay.
    """
    return F.struct(*keys, floor_div(F.col(time), slot_us).alias("_slot"))


def unpacked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Slot summaries with the fields of their key as columns, so their windows share one shuffle."""
    return edges.select("*", *[F.col("_edge")[k].alias(f"_k_{k}") for k in [*keys, "_slot"]])


def slots_in_order(keys: list[str]):
    """Window over the unpacked slot summaries of one key, in time order."""
    return Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_k__slot")


def fit_slot(df: DataFrame, keys: list[str], time: str, target_rows: int = 1_000_000) -> int:
    """Slot width so that no (key, slot) exceeds about ``target_rows``, from one count per hour."""
    hour = 3_600_000_000
    top = (
        df.groupBy(*keys, floor_div(F.col(time), hour).alias("_h"))
        .count()
        .agg(F.max("count"))
        .first()[0]
    )
    return max(1_000_000, min(24 * hour, int(hour * target_rows / max(top or 1, 1))))
