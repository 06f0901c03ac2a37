"""The vector index, partitioned tables, blobs, joins as of a time, sketches."""

import datetime as dt
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.operators import asof, partitions, sketches, vector_index
from inkweave.operators import vectors as V
from inkweave.plans import catalog
from inkweave.sources import blobs

SF = "/root/testdata/sf0.001"


def clustered(spark, n=1500, size=24, seed=1):
    r = np.random.RandomState(seed)
    centres = r.standard_normal((30, size))
    # a third of all rows in one cluster
    own = np.where(np.arange(n) % 3 == 0, 0, r.randint(1, 30, n))
    vectors = (centres[own] + 0.4 * r.standard_normal((n, size))).astype(np.float32)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vector array<float>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = clustered(spark)
    folder = str(tmp_path_factory.mktemp("index"))
    return rows, vector_index.build(rows, folder), rows.filter("id % 100 = 0").withColumnRenamed("id", "query_id")


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.cosine, 9)) for r in df.collect())


def test_index_holds_every_row_and_finds_most(spark, built):
    rows, index, asked = built
    assert index.rows(spark).count() == rows.count() and index.lists == round(rows.count() ** 0.5)
    exact = V.top_k(rows, asked, 20)
    probes = vector_index.calibrate(index, asked, exact, 20, 0.95)
    assert probes < index.lists / 2
    found = vector_index.top_k(index, asked, 20, probes)
    assert vector_index.recall(found, exact) >= 0.95
    assert hits(vector_index.top_k(index, asked, 20, index.lists)) == hits(exact)
    again = vector_index.opened(spark, index.folder)
    assert hits(vector_index.top_k(again, asked, 20, probes)) == hits(found)


def test_index_reads_only_probed_lists(spark, built):
    rows, index, asked = built
    found = vector_index.top_k(index, asked.limit(1), 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list#", "list") or "PartitionFilters: [" in plan and "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == 5


def test_blocks_give_what_sent_queries_give(built):
    _, index, asked = built
    assert hits(vector_index.top_k(index, asked, 10, 4, sent=0)) == hits(vector_index.top_k(index, asked, 10, 4))


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, 0.1]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    index = vector_index.build(df, str(tmp_path), 2)
    assert sorted(r.id for r in index.rows(spark).collect()) == [1, 5, 7]
    asked = df.withColumnRenamed("id", "query_id")
    assert [(r.query_id, r.id) for r in vector_index.top_k(index, asked, 1, 2).orderBy("query_id").collect()] == [(1, 7), (5, 1), (7, 1)]
    with pytest.raises(ValueError):
        vector_index.build(df.filter("id = 3"), str(tmp_path / "none"))


def test_a_list_of_a_third_of_all_rows_has_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILE_ROWS", 100)
    index = vector_index.build(clustered(spark), str(tmp_path), 8)
    sizes = [sum(f.endswith(".parquet") for f in files) for _, _, files in os.walk(f"{tmp_path}/rows")]
    assert max(sizes) >= 4 and index.rows(spark).count() == 1500


def test_recall_of_the_query(spark):
    """The registered query against the exact one, over the whole table."""
    found, exact = (catalog.load()[n].run(spark, "/root/testdata/sf0.01") for n in ("vector_index_topk", "vector_topk"))
    assert vector_index.recall(found, exact) >= 0.9


# ── partitions ──


def named(path):
    return {f"{d}/{f}" for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(300).select("id", (F.col("id") % 5).alias("book"), F.lit("old").alias("v"))
    partitions.store(rows, path, "book")
    before = named(path)
    arriving = rows.filter("book in (1, 2, 3)").withColumn("v", F.lit("new"))
    # book 2 fails too often, all of book 3 fails
    partitions.replace(arriving, path, "book", ((F.col("book") == 2) & (F.col("id") % 3 == 0)) | (F.col("book") == 3) | (F.col("id") == 1))
    after = named(path)
    kept = {f for f in before if "book=1/" not in f}
    assert kept <= after and not {f for f in before if "book=1/" in f} & after
    out = {(r.book, r.v): r["count"] for r in spark.read.parquet(path).groupBy("book", "v").count().collect()}
    assert out == {(0, "old"): 60, (1, "new"): 59, (2, "old"): 60, (3, "old"): 60, (4, "old"): 60}


def test_a_table_can_be_extracted_again_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task
    partitions.store(spark.range(40).select("id", (F.col("id") % 2).alias("book")), path, "book", file_rows=7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(named(path)) > 2
    partitions.replace(spark.read.parquet(path).filter("book = 1").withColumn("id", F.col("id") + 1000), path, "book")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [*range(0, 40, 2), *range(1001, 1040, 2)]
    partitions.replace(spark.read.parquet(path).limit(0), path, "book")
    assert spark.read.parquet(path).count() == 40


def test_re_extraction_replaces_and_keeps(spark):
    out = catalog.load()["library_reextract"].run(spark, "/root/testdata/sf0.01")
    assert {r.version for r in out.select("version").distinct().collect()} >= {"new"} and out.count() > 200


# ── blobs ──


def test_blobs_round_trip(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = [("a/x.bin", b"\x00\x01"), ("a/b/y.bin", b""), ("z.txt", b"t" * 5000), ("n.bin", None)]
    blobs.write_blobs(spark.createDataFrame([(1, *r) for r in rows], "extra int, key string, content binary"), folder)
    with open(f"{folder}/a/x.bin.half-1", "wb") as half:
        half.write(b"half")
    read = {r.key: (r.length, bytes(r.content)) for r in blobs.read_blobs(spark, folder).collect()}
    assert read == {k: (len(c or b""), c or b"") for k, c in rows}
    blobs.write_blobs(spark.createDataFrame([("z.txt", b"again")], "key string, content binary"), folder)
    some = blobs.read_blobs(spark, f"{folder}/absent", folder, "*.txt")
    assert [(r.key, bytes(r.content)) for r in some.collect()] == [("z.txt", b"again")]
    left = blobs.unread(blobs.read_blobs(spark, folder), spark.createDataFrame([("z.txt",), ("n.bin",)], "key string"))
    assert sorted(r.key for r in left.collect()) == ["a/b/y.bin", "a/x.bin"]
    with pytest.raises(Exception, match="absent"):
        blobs.read_blobs(spark, f"{folder}/absent").count()


def test_blobs_go_to_partitions_by_size(tmp_path):
    for k in range(10):
        (tmp_path / f"{k}.bin").write_bytes(b"x" * 100)
    reader = blobs.BlobReader({"path": str(tmp_path), "partition_bytes": "250"})
    assert [len(p.blobs) for p in reader.partitions()] == [2] * 5
    assert hashlib.sha256(next(iter(reader.read(reader.partitions()[0])))[2]).hexdigest() == hashlib.sha256(b"x" * 100).hexdigest()


# ── as of a time, sketches ──


def test_as_of_takes_the_last_row_before(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    prices = spark.createDataFrame([("a", at(0), 1.0), ("a", at(30), 2.0), ("a", at(31), None), ("b", at(5), 7.0), (None, at(1), 9.0), ("c", None, 9.0)], "who string, at timestamp, price double")
    asked = [("a", at(-1), None), ("a", at(0), 1.0), ("a", at(29), 1.0), ("a", at(30), 2.0), ("a", at(500), None), ("b", at(4), None), ("b", at(900), 7.0), ("d", at(4), None), (None, at(4), None), ("c", at(4), None), ("a", None, None), ("a", at(29), 1.0)]
    left = spark.createDataFrame([(k, w, t) for k, (w, t, _) in enumerate(asked)], "id int, who string, at timestamp")
    out = {r.id: r.price for r in asof.as_of(left, prices, "who", "at", ["price"], 3600 * 24).collect()}
    assert out == {k: p for k, (_, _, p) in enumerate(asked)}
    assert asof.as_of(left, prices.limit(0), "who", "at", ["price"]).filter("price is not null").count() == 0
    assert asof.as_of(left.limit(0), prices, "who", "at", ["price"]).count() == 0


def test_merged_sketches_are_near_the_exact_figures(spark):
    events = spark.range(60_000).select(F.timestamp_seconds(F.col("id") * 40).alias("ts"), F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id") % 9000).cast("long").alias("user"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100.0).alias("value"))
    days = sketches.by_day(events, "ts", "user", "value")
    assert days.count() == 28
    out = sketches.figures(sketches.merged(days.withColumn("all", F.lit(1)), "all"), [0.1, 0.5, 0.9], 1).first()
    exact = events.agg(F.countDistinct("user").alias("n"), F.percentile("value", F.array(F.lit(0.08), F.lit(0.12), F.lit(0.48), F.lit(0.52), F.lit(0.88), F.lit(0.92))).alias("q")).first()
    assert out.n == 60_000 and abs(out.n_distinct / exact.n - 1) < 0.03
    assert exact.q[0] <= out.q_10 <= exact.q[1] and exact.q[2] <= out.q_50 <= exact.q[3] and exact.q[4] <= out.q_90 <= exact.q[5]
    assert out.top[0]["item"] == 7 and abs(out.top[0]["count"] / 15_000 - 1) < 0.05
