"""The relational core over the trade tables: joins, aggregates, windows, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweave.plans.catalog import query
from inkweave.sources.tables import read

def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("pricing_summary", "2.L aggregation", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    li = read(spark, sf, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("join_inner", "2.L inner join", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def join_inner(spark, sf):
    t = {name: read(spark, sf, name) for name in ("customer", "orders", "lineitem", "nation", "region")}
    j = t["region"].filter("r_name = 'ASIA'").join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey")).join(t["customer"], F.col("n_nationkey") == F.col("c_nationkey"))
    j = j.join(t["orders"], F.col("c_custkey") == F.col("o_custkey")).join(t["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"))


@query("join_left", "2.L left join", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'F'")
    j = read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.round(F.sum("o_totalprice"), 2), F.lit(0.0)).alias("total"))


@query("join_semi", "2.L semi join", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def join_semi(spark, sf):
    li = read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("join_anti", "2.L anti join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_anti(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("join_band", "2.L band join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 20 AND s_acctbal + 20 GROUP BY 1")
def join_band(spark, sf):
    """A band join by cells of 40: a supplier goes to the two cells that its band may touch."""
    s = read(spark, sf, "supplier").withColumn("cell", F.explode(F.array_distinct(F.array(F.floor((F.col("s_acctbal") - 20) / 40), F.floor((F.col("s_acctbal") + 20) / 40)))))
    p = read(spark, sf, "part").withColumn("cell", F.floor(F.col("p_retailprice") / 40))
    return s.join(p, "cell").filter("p_retailprice between s_acctbal - 20 and s_acctbal + 20").groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("join_theta", "2.L theta join", "SELECT m, count(*) AS n FROM part JOIN (SELECT unnest(['STEEL', 'TIN', 'BRASS', 'a', 'Brand#1']) AS m) ON contains(p_type, m) OR contains(p_name, m) OR contains(p_brand, m) GROUP BY 1")
def join_theta(spark, sf):
    """A substring join against five fixed markers, which is a filter of an array inside the scan."""
    markers = F.array(*[F.lit(x) for x in ("STEEL", "TIN", "BRASS", "a", "Brand#1")])
    hit = F.filter(markers, lambda m: F.contains("p_type", m) | F.contains("p_name", m) | F.contains("p_brand", m))
    return read(spark, sf, "part").select(F.explode(hit).alias("m")).groupBy("m").agg(F.count("*").alias("n"))


@query("distinct_counts", "2.L distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def distinct_counts(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("set_operations", "2.L set operations", """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size > 25)""")
def set_operations(spark, sf):
    c, s = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = read(spark, sf, "lineitem").select("l_partkey").subtract(read(spark, sf, "part").filter("p_size > 25").select("p_partkey"))
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(c.union(s).distinct(), "union").unionByName(n(c.intersect(s), "intersect")).unionByName(n(parts, "except"))


@query("argmax_group", "2.L argmax", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_group(spark, sf):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("minus"))).alias("b")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(best).select("o_custkey", (-F.col("b.minus")).alias("o_orderkey"), "b.o_totalprice")


@query("topk_group", "2.L top-k", "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_group(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return read(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank")).filter("rank <= 3")


@query("running_window", "2.L windows", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def running_window(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("sessions_by_gap", "2.L windows", "SELECT user_id, s AS session, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN g IS NULL OR g > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM events)) GROUP BY 1, 2")
def sessions_by_gap(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    gap = F.col("t") - F.lag("t").over(w)
    e = e.withColumn("new", F.when(gap.isNull() | (gap > 1800), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("sort_limit", "2.L sort and limit", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def sort_limit(spark, sf):
    return read(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("array_mutators", "A12", "SELECT o_custkey, array_to_string(list_filter(list_distinct_sorted, lambda x: x <> '3-MEDIUM'), ',') AS kinds, len(list_distinct_sorted) AS n FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) || ['0-NEW'])) AS list_distinct_sorted FROM orders GROUP BY 1)")
def array_mutators(spark, sf):
    kinds = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("k")).withColumn("k", F.array_sort(F.array_union("k", F.array(F.lit("0-NEW")))))
    return kinds.select("o_custkey", F.array_join(F.array_remove("k", "3-MEDIUM"), ",").alias("kinds"), F.size("k").cast("long").alias("n"))
