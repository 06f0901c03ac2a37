"""Ingestion: deduplication by content, upserts, replacement, guarded swaps, cascades, files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_content(arriving: DataFrame, stored: DataFrame, content: str, key: str) -> DataFrame:
    """Rows whose content (by its SHA-256) isn't stored, one for each content: that with the smallest key."""
    hashed = arriving.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias(key))
    fresh = hashed.join(first, ["content_hash", key], "left_semi")
    return fresh.join(stored.select(F.sha2(F.col(content), 256).alias("content_hash")), "content_hash", "left_anti")


def upsert(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced by arriving ones of the same key, and new rows."""
    return stored.join(arriving.select(key), key, "left_anti").unionByName(arriving)


def replace_by(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that arrive are replaced."""
    return stored.join(arriving.select(key).distinct(), key, "left_anti").unionByName(arriving)


def guarded_swap(stored: DataFrame, arriving: DataFrame, key: str, failed: str, most: float = 0.10, least_tries: int = 20) -> DataFrame:
    """Replacement by key, but a key whose share of failed rows is above ``most`` after ``least_tries`` keeps what it has."""
    rate = arriving.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(failed).cast("int")).alias("r"))
    good = rate.filter((F.col("n") < least_tries) | (F.col("r") <= most)).select(key)
    passing = arriving.join(good, key, "left_semi").filter(~F.col(failed)).drop(failed)
    return stored.join(good, key, "left_anti").unionByName(passing)


def cascade(tables: dict[str, DataFrame], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of deleted keys."""
    return {name: df.join(deleted.select(key), key, "left_anti") for name, df in tables.items()}


def files(spark, folder: str, pattern: str = "*", fallback: str | None = None) -> DataFrame:
    """Files of a folder with their bytes, read by the executors: (path, modificationTime, length, content). Where the
    folder isn't there, those of the fallback."""
    if fallback is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            folder = fallback
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def unprocessed_pages(found: DataFrame, done: DataFrame) -> DataFrame:
    """Page numbers of files named page-N.png that aren't done: (page_number)."""
    n = F.regexp_extract("path", r"page-(\d+)\.png$", 1)
    return found.select(F.nullif(n, F.lit("")).cast("int").alias("page_number")).filter("page_number is not null").distinct().join(done, "page_number", "left_anti")


def store_blobs(blobs: DataFrame, folder: str) -> DataFrame:
    """Write blobs (key, content) to files of a folder that the executors share or reach: (key, path, length).

    A blob is written beside its place and then moved there, so a task that runs again leaves whole files.
    """

    def run(frames):
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for f in frames:
            rows = []
            for key, content in zip(f["key"], f["content"], strict=True):
                path = f"{base.rstrip('/')}/{key}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, path)
                rows.append((key, path, len(content)))
            yield pd.DataFrame(rows, columns=["key", "path", "length"])

    return blobs.select("key", "content").mapInPandas(run, "key string, path string, length long")


def markdown_lines(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(at, line) of a Markdown report: a title and a table with a row for each row of df, which is of a report's size."""
    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    body = df.select((F.row_number().over(Window.orderBy(*order)) + len(head) - 1).alias("at"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))
    return df.sparkSession.createDataFrame(list(enumerate(head)), "at int, line string").unionByName(body)


def write_markdown(lines: DataFrame, path: str) -> None:
    lines.orderBy("at").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
