"""Running sums over groups of any size: rows are dealt by range of (group, order), and ranges add up by their totals.

No task and no window holds a whole group: rows of a range are one partition, a range's total for a group is one row, and
what came before a range is the sum of those rows, of which a group has as many as there are ranges at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.sources.tables import stage


def ranged(rows: DataFrame, by: str, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """rows with _range: the range of (by, order) that holds them. Rows that tie lie in one range.

    Bounds of ranges come from a sample, so the rows are written once: what is read again has the ranges that were counted.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, by, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def before(dealt: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """(by, _range, _name for each of sums): the sums over all rows of the group in earlier ranges (0 in the first)."""
    totals = dealt.groupBy(by, "_range").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(by, "_range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])


def running(rows: DataFrame, by: str, order: Sequence[Column | str], sums: dict[str, Column], within: tuple[str, Callable[[Column], Column]] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with a column for each of sums: the sum over the group's rows before this one in the order.

    The order must tell rows of a group apart. ``within`` names one of the sums and says which of its values rows are kept
    with; it must hold from the first row on and end for good, as a budget does that sums of no negative number use up.
    Ranges behind the end are not read again. A null group is a group.
    """
    dealt = ranged(rows, by, order, ranges)
    group = f"{by}_"
    spent = before(dealt, by, sums)
    if within:
        spent = spent.filter(within[1](F.col(f"_{within[0]}")))
    spent = spent.withColumnsRenamed({by: group, "_range": "_of"})
    joined = dealt.join(spent, dealt[by].eqNullSafe(spent[group]) & (F.col("_range") == F.col("_of"))).drop(group, "_of")
    inside = Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()})
    out = out.drop("_range", *[f"_{k}" for k in sums])
    return out.filter(within[1](F.col(within[0]))) if within else out
