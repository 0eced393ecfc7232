"""Running totals that stay exact and parallel when one group is huge.

One plan for every size: rows are dealt by (group, range of the order value),
each range is totalled by an aggregate that combines before the shuffle, a
prefix over those few totals gives each range its offset, and a window inside
the range does the rest. Nothing runs while the plan is composed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column], ranges: Column | None = None
) -> DataFrame:
    """Append ``name = sum(measure)`` over the group up to and including each row.

    ``order`` must be total within a group. ``ranges`` is a value that never
    falls as the rows of a group go up in order: it cuts a group into the parts
    that one task may hold. Without it a group is one part, which suits groups
    that cannot grow with the data.
    """
    if ranges is None:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in measures.items()})
    values = {f"_m_{name}": value for name, value in measures.items()}
    cut = df.withColumns({**values, "_range": ranges})
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(name).alias(f"_t{name}") for name in values])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_orange"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.sum(f"_t{name}").over(earlier).alias(f"_o{name}") for name in values])
    match = F.col("_range").eqNullSafe(F.col("_orange"))
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totalled = cut.join(offsets, match, "left").withColumns({
        name: F.sum(f"_m_{name}").over(inside) + F.coalesce(F.col(f"_o_m_{name}"), F.lit(0)) for name in measures
    })
    return totalled.select(*df.columns, *measures)
