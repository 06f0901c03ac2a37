"""Small tables with the cases that every operator must stand."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHES = ["id", "row", "score", "held_out", "weight", "rep", "piece", "place", "prefixes", "runs", "group", "path", "tokens", "component", "_own", "_range", "next_text"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "tu", "ren", "sol", "vex", "dar", "pin", "gom"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, ties of id, signs, a very long text."""
    long = prose(99, 30_000)
    texts = [(1, prose(1, 60)), (2, None), (3, ""), (4, "   \t\n "), (5, "one two"), (6, "日本語 🙂 naïve ½"), (7, prose(1, 60)), (7, prose(1, 60)), (8, prose(8, 45)), (8, prose(9, 45)), (None, prose(10, 50)), (11, long), (12, "!!! 123 ---")]
    return [(i, t, "en" if i != 5 else None, "s", None if t is None else len(t)) for i, t in texts]


def frame(spark, rows, clashes: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def plain(spark, texts: dict) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
