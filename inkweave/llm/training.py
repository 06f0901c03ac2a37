"""Bounded samples of labelled documents, and the logistic calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import fold

#: Folds of labelled rows; rows of fold 0 are held out.
FOLDS = 5
#: Classes that are learnt at most.
MOST_CLASSES = 1000


def held_out(doc_id):
    return fold(doc_id, FOLDS) == 0


def sample(docs: DataFrame, marks: DataFrame, per_class: int, chars: int, on: list[str] | None = None) -> tuple[pd.DataFrame, dict]:
    """(text, mark, rank of at most per_class training rows of each class, numbers of training rows by class).

    marks has (doc_id, mark); rows of the held-out fold, null ids and null marks are left out. Rows of docs have a class
    by the columns ``on`` (doc_id; with mark, if docs has it). Chosen are the ids with the smallest hashes, so the sample is
    the same on every run; a bound on the hash, from the number of ids of the class, leaves about twice as many before the
    shuffle. Where ids stand on several rows, the rows are ranked once more by the hash of their text.

    What reaches the driver is bounded: at most MOST_CLASSES classes (the most frequent), per_class rows and chars
    characters of each; texts longer than an eighth of chars aren't learnt from. No text is cut.
    """
    usable = marks.filter(F.col("mark").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "mark")
    sizes = usable.groupBy("mark").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "mark").limit(MOST_CLASSES).collect()
    counts = {r["mark"]: r["n"] for r in sizes}
    if not counts:
        return pd.DataFrame({"text": [], "mark": [], "rank": []}), counts
    space = 1 << 40
    bounds = F.create_map(*[x for r in sizes for x in (F.lit(r["mark"]), F.lit(min(space, space * 2 * per_class // max(1, r["ids"]))))])
    usable = usable.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(space))).filter(F.col("hash") < F.try_element_at(bounds, F.col("mark"))).distinct()
    first = Window.partitionBy("mark").orderBy("hash", "doc_id")
    chosen = usable.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= per_class)
    size = F.length("text")
    rows = docs.filter(F.col("text").isNotNull() & (size <= chars // 8)).join(F.broadcast(chosen), on or ["doc_id"])
    # rows beyond per_class go before the shuffle
    order = Window.partitionBy("mark").orderBy("at", F.xxhash64("text"), "text")
    ranked = rows.select("text", "mark", F.row_number().over(order).alias("rank"), "at").filter(F.col("rank") <= per_class)
    so_far = F.sum(size).over(Window.partitionBy("mark").orderBy("rank"))
    kept = ranked.withColumn("so_far", so_far).filter(F.col("so_far") <= chars)
    return kept.select("text", "mark", "rank").toPandas().sort_values(["mark", "rank"], ignore_index=True), counts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the columns of x (the last is the constant), by Newton's method.

    Columns are scaled to mean 0 and deviation 1 meanwhile; a step that doesn't lower the loss is halved.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-9
    sign = 2 * y - 1

    def loss(w):
        return (weight * np.logaddexp(0, -sign * (z @ w))).sum() + 0.5 * (keep * w * w).sum()

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (p - y)) + keep * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9)
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    w = w / scale
    w[-1] -= (w[:-1] * mean[:-1]).sum()
    return w


def logistic_over(rows: DataFrame, width: int, weight: dict, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """logistic() over a table of any size: rows (mark, at array<int>, value array<double>: the columns that aren't 0, the
    last being the constant); weight of a row by its mark.

    Each step sums the loss and its derivatives over all rows where they lie; the driver gets the sums. Columns aren't scaled,
    the ridge is: the minimum is the same.
    """
    upper = np.triu_indices(width)

    def derivatives(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(frames):
            loss, gradient, curve = 0.0, np.zeros(width), np.zeros((width, width))
            for frame in frames:
                for begin in range(0, len(frame), 2048):
                    some = frame.iloc[begin : begin + 2048]
                    x = np.zeros((len(some), width))
                    x[np.repeat(np.arange(len(some)), some["at"].str.len().to_numpy()), np.concatenate(some["at"].tolist())] = np.concatenate(some["value"].tolist())
                    y = some["mark"].to_numpy()
                    each = np.where(y == 1, weight[1], weight[0])
                    z = x @ w
                    p = sigmoid(z)
                    loss += (each * np.logaddexp(0, -(2 * y - 1) * z)).sum()
                    gradient += x.T @ (each * (p - y))
                    curve += (x * (each * p * (1 - p))[:, None]).T @ x
            sums = np.concatenate([[loss], gradient, curve[upper]])
            yield pd.DataFrame({"k": np.arange(len(sums), dtype="int32"), "v": sums})

        sums = rows.mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
        curve = np.zeros((width, width))
        curve[upper] = sums[1 + width :]
        return float(sums[0]), sums[1 : 1 + width], curve + np.triu(curve, 1).T

    w = np.zeros(width)
    loss, gradient, curve = derivatives(w)
    # at 0 the curve is a quarter of the columns' weighted products: the constant's are the sums and their number
    n = curve[-1, -1]
    scale2 = np.maximum(np.diag(curve) / n - (curve[-1] / n) ** 2, 0.0)
    keep = ridge * np.where(scale2 > 0, scale2, 1.0)
    keep[-1] = 1e-9
    now = loss
    for _ in range(steps):
        step = np.linalg.solve(curve + np.diag(keep + 1e-9), gradient + keep * w)
        size = 1.0
        while True:
            tried = w - size * step
            loss, gradient, curve = derivatives(tried)
            after = loss + 0.5 * (keep * tried * tried).sum()
            if after <= now or size <= 1e-6:
                break
            size /= 2
        w, before, now = tried, now, after
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return w


def class_weights(y: np.ndarray, counts: dict, one=1, zero=0) -> np.ndarray:
    """Weights that give the classes of a balanced sample the shares that they have among all training rows."""
    ones, zeros = max(1, counts.get(one, 0)), max(1, counts.get(zero, 0))
    share = np.where(y == 1, ones / (ones + zeros) / max(1, (y == 1).sum()), zeros / (ones + zeros) / max(1, (y == 0).sum()))
    return share * len(y)
