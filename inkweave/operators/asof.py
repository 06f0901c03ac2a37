"""Joins as of a time: each row with the last row of the other side before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """left with the values of the last row of right (by, at, values) of the same key that isn't later; nulls if there is none.

    Both sides are put together and carried forward inside buckets of time, so a key of any size is as many pieces as it has
    buckets; what a bucket begins with is the last value of the key's buckets before it, of which there is one row each. No
    rows are compared pair by pair. right has one row for a key and time. A null key or time meets nothing.
    """
    known = F.struct(*[F.col(v) for v in values])
    none = F.lit(None).cast(right.select(known.alias("x")).schema["x"].dataType)
    packed = F.struct(*[F.col(c) for c in left.columns])
    no_row = F.lit(None).cast(left.select(packed.alias("x")).schema["x"].dataType)
    rows = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), packed.alias("_row"), none.alias("_known"))
    news = right.filter(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(0).alias("_side"), no_row.alias("_row"), known.alias("_known"))
    both = rows.unionByName(news).withColumn("_bucket", F.floor(F.unix_micros(F.col("_at").cast("timestamp")) / (bucket_seconds * 1_000_000)))
    inside = Window.partitionBy("_by", "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_here", F.last("_known", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    # what each bucket ends with, and so what the next ones begin with
    ends = both.filter(F.col("_by").isNotNull() & F.col("_bucket").isNotNull()).groupBy("_by", "_bucket").agg(F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("_at"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    begins = ends.select("_by", "_bucket", before.alias("_before"))
    met = carried.join(begins, ["_by", "_bucket"], "left")
    known_at = F.coalesce("_here", "_before")
    usable = F.col("_by").isNotNull() & F.col("_at").isNotNull()
    return met.select("_row.*", *[F.when(usable, known_at[v]).alias(v) for v in values])


def cost(units: Column, price: Column) -> Column:
    """The cost of units at a price; nothing where no price was known."""
    return F.coalesce(units * price, F.lit(0.0))
