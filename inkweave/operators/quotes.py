"""Finding quotes in the whole library: a positional index of word n-grams, probed at each quote's rarest one.

``store`` writes (gram, page_id, place) of all pages, in partitions by the gram's bucket. ``search`` looks up the grams of
the quotes alone: their counts first, then the postings of the rarest gram of each beginning of a quote, and compares the
pages' words where it may stand. No quote meets a page that doesn't hold one of its rarest grams.

Texts and quotes are compared in the form of ``text.quote_form`` and by whole words. Empty or null texts hold nothing;
quotes of fewer than WORDS words find nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.sources.tables import stage

#: Words of a gram, buckets of the index, and beginnings of a quote that are tried, the whole quote first (fixed values).
WORDS, BUCKETS = 3, 64
BEGINNINGS = (40, 30, 20, 15, 10, 6, 4, 3)
#: Rows of asked grams that are sent to all tasks at most; more of them are dealt by gram.
SENT = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(T.quote_form(text), " "), lambda w: w != "")


def grams(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, place from 0, gram) of all runs of WORDS words."""
    last = F.size(words) - WORDS
    # numbers alone are exploded, not a text's words beside each of them
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda at: F.xxhash64(*[F.get(F.col(words), at + k) for k in range(WORDS)]))
    return rows.filter(last >= 0).select(key, F.posexplode(every).alias("place", "gram"))


def bucket(gram: Column) -> Column:
    return F.pmod(gram, F.lit(BUCKETS)).cast("int")


def store(pages: DataFrame, folder: str) -> None:
    """Write the index of pages (page_id, text) and their words to a folder that driver and executors share.

    A bucket's postings are dealt on by page, so a gram that all pages hold is in as many files as it asks for; inside a file
    they are sorted by gram, and a scan passes over row groups without the asked ones.
    """
    worded = pages.select("page_id", words_of(F.col("text")).alias("words"))
    worded.write.mode("overwrite").parquet(f"{folder}/words")
    read = pages.sparkSession.read.parquet(f"{folder}/words")
    found = grams(read, "page_id", "words").withColumn("bucket", bucket(F.col("gram")))
    dealt = found.repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "page_id")
    dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/grams")


def _met(many: DataFrame, few: DataFrame, n: int, on: list[str]) -> DataFrame:
    """A join in which ``few`` is sent to all tasks if it has few rows, so that a very common key is no task of its own; else
    both are dealt by the keys, and adaptive execution splits what is large."""
    return many.join(F.broadcast(few) if n <= SENT else few.hint("merge"), on)


def search(spark: SparkSession, folder: str, quotes: DataFrame) -> DataFrame:
    """(quote_id, words, page_id, start): for each quote (quote_id, quote) the longest of its beginnings (all its words, or one
    of BEGINNINGS) that stands in the library, and every place where it does."""
    asked = quotes.select("quote_id", words_of(F.col("quote")).alias("q")).filter(F.size("q") >= WORDS)
    asked = stage(asked, "quotes")
    own = stage(grams(asked, "quote_id", "q").withColumnRenamed("place", "k"), "quote-grams")
    names = own.select("gram").distinct().withColumn("bucket", bucket(F.col("gram")))
    n = names.count()
    index = spark.read.parquet(f"{folder}/grams")
    buckets = [r[0] for r in names.select("bucket").distinct().collect()]  # BUCKETS at most
    held = index.filter(F.col("bucket").isin(buckets))
    counts = stage(_met(held, names, n, ["bucket", "gram"]).groupBy("gram").agg(F.count("*").alias("n")), "gram-counts")
    known = own.join(counts, "gram", "left").select("quote_id", "k", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    # a beginning can only stand somewhere if all its grams do
    lengths = F.array_distinct(F.concat(F.array(F.size("q")), F.array(*[F.lit(b) for b in BEGINNINGS])))
    begins = asked.select("quote_id", F.explode(F.filter(lengths, lambda b: b <= F.size("q"))).alias("words"))
    each = begins.join(known, "quote_id").filter(F.col("k") + WORDS <= F.col("words"))
    rarest = each.groupBy("quote_id", "words").agg(F.min(F.struct("n", "k", "gram")).alias("g")).filter("g.n > 0")
    probes = stage(rarest.select("quote_id", "words", F.col("g.k").alias("k"), F.col("g.gram").alias("gram"), bucket(F.col("g.gram")).alias("bucket")), "quote-probes")
    pages = spark.read.parquet(f"{folder}/words").select("page_id", F.col("words").alias("w"))
    # shorter beginnings stand in many more places, so they are looked for only where no longer one was found
    hits, left = [], stage(rarest.select("quote_id", "words", F.col("g.k").alias("k"), F.col("g.gram").alias("gram"), bucket(F.col("g.gram")).alias("bucket")), "quote-probes")
    for _ in range(len(BEGINNINGS) + 1):
        longest = left.groupBy("quote_id").agg(F.max_by(F.struct("words", "k", "gram", "bucket"), "words").alias("b")).select("quote_id", "b.*")
        probes = stage(longest, "quote-longest")
        n = probes.count()
        met = _met(held, probes, n, ["bucket", "gram"]).filter(F.col("place") >= F.col("k")).select("quote_id", "words", "page_id", (F.col("place") - F.col("k")).alias("start"))
        both = met.join(pages, "page_id").join(asked, "quote_id")
        fits = F.slice("w", F.col("start") + 1, F.col("words")) == F.slice("q", F.lit(1), F.col("words"))
        found = both.filter(fits).select("quote_id", "words", "page_id", "start")
        tried = probes.select("quote_id", F.col("words").alias("tried"))
        shorter = stage(left.join(tried, "quote_id").filter(F.col("words") < F.col("tried")).drop("tried"), "quote-probes")
        if not shorter.limit(1).count():
            hits.append(found)
            break
        hits.append(stage(found, "quote-hits"))
        left = stage(shorter.join(hits[-1].select("quote_id").distinct(), "quote_id", "left_anti"), "quote-probes")
        if not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, hits)
