"""Streams over folders of files, brought to tables batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, folder: str, schema: T.StructType, at_a_time: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, in the order in which they came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_a_time).parquet(folder)


def in_order(rows: DataFrame, folder: str, at: str, parts: int = 4) -> None:
    """Write rows to a folder as files that follow each other in time."""
    first, last = rows.agg(F.min(at), F.max(at)).first()
    if first is None:
        rows.limit(0).write.mode("append").parquet(folder)
        return
    share = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp"))) / F.greatest(F.lit(1), F.unix_micros(F.lit(last).cast("timestamp")) - F.unix_micros(F.lit(first).cast("timestamp")))
    dealt = rows.withColumn("_part", F.least(F.lit(parts - 1), F.floor(share * parts)))
    for k in range(parts):
        dealt.filter(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(folder)


def finish(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream in append mode over all that is there, and return the table of all it has ever given.

    ``folder`` holds the table and the stream's checkpoint: a later call, or one after a crash, goes on where the last one
    ended. A batch that runs again overwrites its own rows.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    stream.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("epoch", T.LongType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows").drop("epoch")
