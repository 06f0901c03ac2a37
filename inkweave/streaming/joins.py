"""Joins of two streams inside an interval of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_interval(first: DataFrame, second: DataFrame, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, first_id, second_id, first_at, second_at): each row of second (key, id, at) with the rows of first of its key
    that came before it, or at the same time, by ``width`` at most.

    Works on streams and on tables. On streams the watermark is the smaller of both sides' latest times less ``late``: a row
    that is older than the watermark of the batch before may be dropped, and the state keeps a row only as long as a row in
    time on the other side could meet it.
    """
    a = first.select(F.col(key), F.col("id").alias("first_id"), F.col("at").alias("first_at")).withWatermark("first_at", late)
    b = second.select(F.col(key).alias("_key"), F.col("id").alias("second_id"), F.col("at").alias("second_at")).withWatermark("second_at", late)
    met = (F.col(key) == F.col("_key")) & (F.col("second_at") >= F.col("first_at")) & (F.col("second_at") <= F.col("first_at") + F.expr(f"interval {width}"))
    return a.join(b, met).drop("_key")
