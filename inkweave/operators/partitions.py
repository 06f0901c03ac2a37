"""Tables in partitions by a key, of which a replacement rewrites those it touches and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a file should get: a large partition is written by several tasks.
FILE_ROWS = 1_000_000


def _dealt(rows: DataFrame, by: str, file_rows: int) -> DataFrame:
    """rows dealt by (key, share of the key): as many shares as its rows ask for."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files"))
    hashed = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])  # the same for a task that runs again
    shared = rows.join(sizes, by).withColumn("_share", F.pmod(hashed, F.col("_files")))
    return shared.repartition(by, "_share").drop("_files", "_share")


def store(rows: DataFrame, path: str, by: str, file_rows: int = FILE_ROWS) -> None:
    """Write a table in partitions by a key (not null), replacing what is there."""
    _dealt(rows, by, file_rows).write.partitionBy(by).mode("overwrite").parquet(path)


def passing(arriving: DataFrame, by: str, failed: Column, most: float = 0.10, least_tries: int = 20) -> DataFrame:
    """The rows that may be committed: those that didn't fail, of keys whose share of failed rows isn't above ``most``
    after ``least_tries``."""
    rate = arriving.groupBy(by).agg(F.count("*").alias("n"), F.avg(failed.cast("int")).alias("r"))
    good = rate.filter((F.col("n") < least_tries) | (F.col("r") <= most)).select(by)
    return arriving.filter(~failed).join(good, by, "left_semi")


def replace(arriving: DataFrame, path: str, by: str, failed: Column | None = None, most: float = 0.10, least_tries: int = 20, file_rows: int = FILE_ROWS) -> None:
    """Replace the partitions of the keys that arrive; the files of all others stay as they are.

    Rows are buffered beside the table and moved in when all of them are written. With ``failed``, rows that failed are left
    out, and a key of which too many did keeps what it has, as does one of which no row is left. Rows may come from the
    table itself: it is read before anything moves.
    """
    rows = arriving if failed is None else passing(arriving, by, failed, most, least_tries)
    _dealt(rows, by, file_rows).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
