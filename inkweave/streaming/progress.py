"""Progress of jobs as a stream: counts by type in event-time windows, with a watermark for late rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.sources.tables import shared_folder


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): works on a stream and on a table alike."""
    made = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_once(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """Read the files of a folder (or one file) as a stream, bring the counts to a table in the shared folder, return it."""
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        source, path = source.option("pathGlobFilter", place.getName()), place.getParent().toString()
    events = source.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    stream = windowed(events, width).writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("epoch")).first()[0]
    return rows.filter(F.col("epoch") == last).drop("epoch")
