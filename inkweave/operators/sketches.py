"""Summaries that can be stored by day and merged later: distinct counts, quantiles, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes: the distinct sketch has 2^DISTINCT registers (an error of some 0.8 %), a quantile sketch of QUANTILE an error in
#: rank of some 1.3 %, and a value that makes up 1 in FREQUENT of all rows is always kept.
DISTINCT, QUANTILE, FREQUENT = 14, 200, 1_000


def by_day(rows: DataFrame, at: str, key: str, value: str) -> DataFrame:
    """(day, n, distinct, quantiles, frequent): a row for each day, whatever the number of rows; all parts are summed up
    before the shuffle."""
    day = F.col(at).cast("date").alias("day")
    return rows.groupBy(day).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(key, DISTINCT).alias("distinct"),
        F.kll_sketch_agg_double(value, QUANTILE).alias("quantiles"),
        F.expr(f"approx_top_k_accumulate({key}, {FREQUENT * 10})").alias("frequent"),
    )


def merged(days: DataFrame, *by: str) -> DataFrame:
    """(by, n, distinct, quantiles, frequent) of the days that fall together: as if their rows had been summed up at once."""
    folded = F.aggregate(F.slice("q", 2, F.size("q")), F.col("q")[0], lambda a, b: F.kll_sketch_merge_double(a, b))
    out = days.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"), F.collect_list("quantiles").alias("q"), F.expr(f"approx_top_k_combine(frequent, {FREQUENT * 10})").alias("frequent"))
    return out.withColumn("quantiles", folded).drop("q")


def figures(sketches: DataFrame, ranks: list[float], top: int) -> DataFrame:
    """The sketches read out: n_distinct, quantiles at the ranks (q_<percent>), and the ``top`` most frequent values."""
    at = {f"q_{round(100 * r)}": F.kll_sketch_get_quantile_double("quantiles", F.lit(float(r))) for r in ranks}
    return sketches.withColumns({"n_distinct": F.hll_sketch_estimate("distinct"), **at, "top": F.expr(f"approx_top_k_estimate(frequent, {top})")}).drop("distinct", "quantiles", "frequent")
