"""Running sums by ranges against plain windows, and what their plans hold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweave.operators import context, prefix, quality, repairs, segments


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(2)
    # a third of all rows in one group, one group of one row, a null group
    data = [("hot" if k % 3 == 0 else None if k % 50 == 1 else f"g{k % 7}", k, r.choice([0, 1, 5, 30])) for k in range(3000)] + [("one", 5, 3)]
    r.shuffle(data)
    return spark.createDataFrame(data, "book string, place long, size long").cache()


def plain(rows):
    w = Window.partitionBy("book").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("n", F.coalesce(F.sum(F.lit(1)).over(w), F.lit(0))).withColumn("spent", F.coalesce(F.sum("size").over(w), F.lit(0)))


def listed(df):
    return sorted((tuple(r) for r in df.select("book", "place", "size", "n", "spent").collect()), key=str)


@pytest.mark.parametrize("ranges", [None, 1, 23])
def test_sums_equal_windows(rows, ranges):
    sums = {"n": F.lit(1), "spent": F.col("size")}
    assert listed(prefix.running(rows, "book", ["place"], sums, ranges=ranges)) == listed(plain(rows))
    kept = prefix.running(rows, "book", ["place"], sums, ("spent", lambda s: s < 700), ranges)
    assert listed(kept) == listed(plain(rows).filter("spent < 700"))


def test_no_range_holds_a_group_and_ranges_behind_the_budget_go(rows):
    dealt = prefix.ranged(rows, "book", ["place"], 20)
    sizes = dict(dealt.groupBy("_range").count().collect())
    assert max(sizes.values()) < 3 * rows.count() / 20
    assert dealt.filter("book = 'hot'").select("_range").distinct().count() >= 5
    spent = prefix.before(dealt, "book", {"spent": F.col("size")})
    left = dealt.join(spent.filter("_spent < 700"), ["book", "_range"], "left_semi").filter("book = 'hot'").count()
    assert left < 0.5 * rows.filter("book = 'hot'").count()


def test_budgets_calls_and_sessions(rows):
    of = rows.filter("book is not null")
    w = Window.partitionBy("book").orderBy("place")
    want = of.withColumn("used", F.sum("size").over(w)).filter("used <= 500").select("book", "place", "used")
    assert sorted(quality.within_running_budget(of, "book", ["place"], "size", 500).select("book", "place", "used").collect()) == sorted(want.collect())
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = of.withColumn("spent", before).filter("spent < 200").select("book", "place", "spent")
    assert sorted(context.within_calls(of, "book", ["place"], "size").select("book", "place", "spent").collect()) == sorted(want.collect())
    pages = of.select(F.col("book").alias("book_id"), F.col("place").alias("page_number"))
    want = pages.withColumn("session", F.floor((F.row_number().over(Window.partitionBy("book_id").orderBy("page_number")) - 1) / 8).cast("int"))
    assert sorted(segments.sessions(pages).collect()) == sorted(want.collect())


def test_a_sweep_works_off_kinds_in_order(spark):
    cands = [("b", k, c, 10) for k in ("p1", "p2", "p3") for c in range(4)] + [("c", "p3", 1, 99)]
    df = spark.createDataFrame(cands, "book_id string, kind string, chunk_id long, cost long").withColumn("outcome", F.lit("repaired"))
    out = repairs.sweep(df, 60).orderBy("book_id", "place").collect()
    assert [(r.kind, r.chunk_id, r.place, r.spent, r.flush) for r in out if r.book_id == "b"] == [("p2", 0, 1, 0, 1), ("p2", 1, 2, 10, 1), ("p2", 2, 3, 20, 1), ("p2", 3, 4, 30, 1), ("p1", 0, 5, 40, 1), ("p1", 1, 6, 50, 2)]
    assert [(r.place, r.spent) for r in out if r.book_id == "c"] == [(1, 0)]
    assert repairs.sweep(df.limit(0), 60).count() == 0
