"""Running aggregates and ranks that survive very large groups.

A plain window sorts each group in one task.  That suits groups that are small by
their meaning, such as the PSMs of one spectrum.  With few groups (engines, runs) or
none it does not scale, so there the rows are range partitioned on (group, order):
every part is scanned on its own and receives the totals of the parts before it.  Which
way is taken depends on the group columns alone, never on the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psmweave.runtime import stored

Order = Sequence[tuple[str, bool]]  # (column, ascending)

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _sort(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


#: Columns that make a group small: a spectrum has some engines' hits, not a share of all rows.
SMALL_GROUP = frozenset({"spectrum_id"})


def small_groups(group: Sequence[str]) -> bool:
    return not SMALL_GROUP.isdisjoint(group)


def _way(strategy: str, group: Sequence[str]) -> str:
    if strategy != "auto":
        return strategy
    return "single" if small_groups(group) else "split"


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where null equals null; key columns of ``right`` are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    outputs: dict[str, tuple[str, str]],
    inclusive: bool = True,
    strategy: str = "auto",
    parts: int | None = None,
) -> DataFrame:
    """Add running aggregates over ``order`` inside ``group``.

    ``outputs`` maps a new column to ``(sum|min|max, input column)``; the frame
    ends at the current row, or one before it when not ``inclusive``.  Sums over
    an empty frame are 0.  Rows with equal order values see each other in row
    order, so pass a total order or pre-aggregate ties first.
    """
    end = 0 if inclusive else -1
    strategy = _way(strategy, group)
    if strategy == "single":
        w = Window.partitionBy(*group).orderBy(*_sort(order)).rowsBetween(
            Window.unboundedPreceding, end
        )
        return df.withColumns(
            {
                name: F.coalesce(_AGG[fn](c).over(w), F.lit(0))
                if fn == "sum"
                else _AGG[fn](c).over(w)
                for name, (fn, c) in outputs.items()
            }
        )

    keys = [F.col(c) for c in group] + _sort(order)
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    # The part number must not change when a task is repeated: fix it on disk.
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()))
    w = (
        Window.partitionBy(*group, "_part")
        .orderBy(*_sort(order))
        .rowsBetween(Window.unboundedPreceding, end)
    )
    inner = ranged.withColumns(
        {f"_in_{name}": _AGG[fn](c).over(w) for name, (fn, c) in outputs.items()}
    )
    totals = ranged.groupBy(*group, "_part").agg(
        *[_AGG[fn](c).alias(f"_tot_{name}") for name, (fn, c) in outputs.items()]
    )
    before = (
        Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *group,
        "_part",
        *[
            _AGG[fn](f"_tot_{name}").over(before).alias(f"_carry_{name}")
            for name, (fn, _) in outputs.items()
        ],
    )
    # One row per group and part: with its size known, the rows are not shuffled to be joined.
    out = _null_safe(inner, stored(carry), [*group, "_part"], "left")
    combined = {}
    for name, (fn, _) in outputs.items():
        a, b = F.col(f"_in_{name}"), F.col(f"_carry_{name}")
        if fn == "sum":
            combined[name] = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            combined[name] = F.least(a, b) if fn == "min" else F.greatest(a, b)
    return out.withColumns(combined).select(*df.columns, *outputs)


def attach_group_values(
    df: DataFrame, group: Sequence[str], values: dict[str, Column], fits: bool | None = None
) -> DataFrame:
    """Add aggregates of the row's group to every row.

    One pass over sorted groups where groups are small; else partial aggregation and a join
    back, where the aggregated side has one row per group.
    """
    if fits is None:
        fits = small_groups(group)
    if fits:
        w = Window.partitionBy(*group)
        return df.withColumns({name: agg.over(w) for name, agg in values.items()})
    totals = df.groupBy(*group).agg(*[agg.alias(name) for name, agg in values.items()])
    return _null_safe(df, totals, group, "left") if group else df.withColumns(
        {name: totals.select(name).scalar() for name in values}
    )


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    method: str = "dense",
    name: str = "rank",
    strategy: str = "auto",
) -> DataFrame:
    """Rank rows inside ``group``: ``dense``, ``min`` (gaps) or ``first`` (needs a total order)."""
    strategy = _way(strategy, group)
    if strategy == "single":
        w = Window.partitionBy(*group).orderBy(*_sort(order))
        fn = {"dense": F.dense_rank, "min": F.rank, "first": F.row_number}[method]
        return df.withColumn(name, fn().over(w))
    if method == "first":
        ranked = running(
            df.withColumn("_one", F.lit(1)), group, order, {name: ("sum", "_one")}, True, "split"
        ).drop("_one")
        return ranked.withColumn(name, F.col(name).cast("int"))
    # Ties collapse before the shuffle, so a hot score value is one row.
    keys = [c for c, _ in order]
    levels = df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    if method == "dense":
        levels = running(
            levels.withColumn("_one", F.lit(1)), group, order, {name: ("sum", "_one")}, True, "split"
        )
    else:
        levels = running(levels, group, order, {name: ("sum", "_n")}, False, "split").withColumn(
            name, F.col(name) + 1
        )
    levels = levels.select(*group, *keys, F.col(name).cast("int").alias(name))
    return _null_safe(df, levels, [*group, *keys], "left")
