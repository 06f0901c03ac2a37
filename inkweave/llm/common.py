"""Helpers that the operators share: tables, the shared folder, texts and ids in Python, folds, connected components.

Ids never pass through pandas as numbers: there a long column with a null becomes floats, which round what is above 2^53.
Operators that give one row for each row run as Python functions of the text alone (``by_text``) and leave the id in the
JVM; the others take the id as a string and cast it back.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the five ASCII controls that ``bytes.split()`` also takes.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error, since executors would each
    write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="inkweave-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _located(spark: SparkSession, folder: str):
    """(file system, path) of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors.

    What discard() didn't delete before goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/inkweave/{spark.sparkContext.applicationId}"
    path = f"{folder}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _located(spark, folder)
    system.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """df as the side of a join that grows with the corpus: dealt by key at every size, and never broadcast."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/inkweave/" in folder:
                system, path = _located(df.sparkSession, folder)
                system.delete(path, True)


def slices(frames: Iterator[pd.DataFrame], chars: int = 8_000_000, rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The frames in slices of about so many characters of text, and so many rows at most.

    Memory then follows neither the batch's size nor, but for a single text, the texts' length.
    """
    for frame in frames:
        ends = frame["text"].str.len().fillna(0).to_numpy().cumsum()
        begin = 0
        while begin < len(frame):
            so_far = ends[begin - 1] if begin else 0
            end = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, so_far + chars, side="right"))))
            yield frame.iloc[begin:end]
            begin = end


def by_text(work: Callable[[list[str]], dict], schema: str, chars: int = 8_000_000) -> Callable[[Column], Column]:
    """A column function text -> struct of schema. work maps some texts (null: empty) to columns of values."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            parts = [pd.DataFrame(work([t or "" for t in f["text"]])) for f in slices(iter([text.to_frame("text")]), chars)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(work([]))

    return F.pandas_udf(run, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """The document's fold: crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def components(edges: DataFrame, what: str, max_rounds: int = 100) -> DataFrame:
    """Connected components of edges (u, v: any type with an order): (node, component) of each node, component being one of
    its nodes.

    Each round every node joins its smallest neighbour if that is smaller than itself, and edges go on between what was
    joined. Smaller means by the nodes themselves and by a hash of them in turns: the first ends stars around small nodes
    at once, the second halves whatever shape, such as long chains of ascending nodes. Edges and labels of a round are
    tables in the shared folder. A node with very many edges is only the probe side of joins, which adaptive execution can
    split, and of sums with a map-side part.
    """
    ends = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    left = written(edges.filter("u <> v").select(*ends("u", "v")).distinct(), f"{what}-edges")
    labels, steps = None, []
    for k in range(max_rounds):
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k % 2 else F.lit(0)).alias("h"), F.col(c).alias("n"))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        step = written(least.select(F.col("u").alias("node"), F.least("near", rank("u"))["n"].alias("component")), f"{what}-step")
        steps.append(step)
        at = lambda end: step.select(F.col("node").alias(end), F.col("component").alias(f"{end}_at"))
        joined = left.join(at("u"), "u").join(at("v"), "v").filter("u_at <> v_at").select(*ends("u_at", "v_at"))
        before, left = left, written(joined.distinct(), f"{what}-edges")
        discard(before)
        if not left.limit(1).count():
            break
    else:
        raise RuntimeError("components: edges are left")
    labels = steps[0]
    for step in steps[1:]:
        labels = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if len(steps) > 1:
        labels = written(labels, f"{what}-labels")
        discard(*steps)
    discard(left)
    return labels
