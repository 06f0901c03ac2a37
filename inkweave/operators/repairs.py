"""Repairs of chunks and spans by verdicts, and the order of a sweep. Nothing is deleted: rows are added and marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.operators.prefix import running


def decompose(spans: DataFrame, verdicts: DataFrame, least: int = 2) -> DataFrame:
    """spans (span_id, chunk_id, tags, role, search_class) after verdicts (span_id, parts: array<struct<tags,role,
    search_class>>): each part with tags becomes a span of its own (span_id * 100 + its place), and the old one stays,
    marked as replaced by them. Fewer than ``least`` such parts leave the span as it is, marked unrepairable."""
    # good parts go to the join alone, and spans pass by a table of them: neither side is sorted
    good = verdicts.filter("parts is not null").select("span_id", F.filter("parts", lambda p: F.size(p["tags"]) > 0).alias("good"))
    j = spans.join(good.hint("shuffle_hash"), "span_id", "left")
    enough = F.col("good").isNotNull() & (F.size("good") >= least)
    ids = F.transform(F.sequence(F.lit(1), F.size("good")), lambda k: F.col("span_id") * 100 + k)
    status = F.when(enough, "replaced").when(F.col("good").isNotNull(), "unrepairable")
    old = j.select("span_id", "chunk_id", "tags", "role", "search_class", status.alias("status"), F.when(enough, ids).alias("replaced_by"))
    new = j.filter(enough).select("span_id", "chunk_id", F.posexplode("good").alias("k", "p"))
    new = new.select((F.col("span_id") * 100 + F.col("k") + 1).alias("span_id"), "chunk_id", "p.tags", "p.role", F.coalesce("p.search_class", F.lit("N")).alias("search_class"), F.lit("repaired").alias("status"), F.lit(None).cast("array<bigint>").alias("replaced_by"))
    return old.unionByName(new)


def disambiguate(chunks: DataFrame, spans: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, spans) with the new tags of verdicts (chunk_id, new_tags): they go to the chunk and to its first span."""
    v = verdicts.filter(F.size("new_tags") > 0)
    add = lambda df: df.withColumn("status", F.when(F.col("new_tags").isNotNull(), "repaired")).withColumn("tags", F.when(F.col("new_tags").isNotNull(), F.array_union("tags", "new_tags")).otherwise(F.col("tags"))).drop("new_tags")
    first = spans.groupBy("chunk_id").agg(F.min("span_id").alias("span_id")).join(v, "chunk_id").select("span_id", "new_tags")
    return add(chunks.join(v, "chunk_id", "left")), add(spans.join(first, "span_id", "left"))


def retag(spans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """spans (span_id, chunk_id, start, end, tags, role, search_class) with the tags, first role and last search class of
    verdicts (chunk_id, place, start, end, tags, role, search_class): those of a verdict go to the chunk's spans of the same
    range or, where there is none, to all of them. Verdicts without tags count for nothing."""
    v = verdicts.filter(F.size("tags") > 0).select("chunk_id", "place", F.col("start").alias("vs"), F.col("end").alias("ve"), F.col("tags").alias("new"), F.col("role").alias("vr"), F.col("search_class").alias("vc"))
    met = spans.select("span_id", "chunk_id", "start", "end").join(v, "chunk_id").withColumn("same", (F.col("start") == F.col("vs")) & (F.col("end") == F.col("ve")))
    aimed = met.groupBy("chunk_id", "place").agg(F.max("same").alias("aimed"))
    hits = met.join(aimed, ["chunk_id", "place"]).filter(F.col("same") | ~F.col("aimed"))
    said = F.array_sort(F.collect_list(F.struct("place", "new", "vr", "vc")))
    by_span = hits.groupBy("span_id").agg(said.alias("said"))
    by_span = by_span.select(
        "span_id", F.array_distinct(F.flatten(F.transform("said", lambda x: x["new"]))).alias("new"), F.get(F.array_compact(F.transform("said", lambda x: x["vr"])), F.lit(0)).alias("vr"),
        F.try_element_at(F.filter(F.transform("said", lambda x: x["vc"]), lambda c: c != "N"), F.lit(-1)).alias("vc"),
    )
    j = spans.join(by_span, "span_id", "left")
    return j.select(
        "span_id", "chunk_id", F.when(F.col("new").isNull(), F.col("tags")).otherwise(F.array_union("tags", F.col("new"))).alias("tags"), F.coalesce("vr", "role").alias("role"),
        F.coalesce("vc", "search_class").alias("search_class"), F.when(F.col("new").isNotNull(), "repaired").alias("status"),
    )


#: Merges come first, since they move text between neighbours, then decompositions, then new tags.
SWEEP_ORDER = ["p2", "p1", "p3"]


def sweep(cands: DataFrame, ceiling: float, flush_every: int = 5) -> DataFrame:
    """Candidates (book_id, kind, chunk_id, cost, outcome) in the order they are worked off, until the cost of a book has
    reached the ceiling: with place (from 1), spent (before it) and flush, the number of the save that holds it."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SWEEP_ORDER]), F.col("kind"))
    placed = running(cands, "book_id", [rank, "chunk_id"], {"place": F.lit(1), "spent": F.col("cost")}, ("spent", lambda spent: spent < ceiling))
    placed = placed.withColumn("place", (F.col("place") + 1).cast("int"))
    return placed.withColumn("flush", F.floor((F.col("place") - 1) / flush_every) + 1)


def sweep_counts(worked: DataFrame) -> DataFrame:
    """(book_id, kind, outcome, n, cost): the counters of a sweep."""
    return worked.groupBy("book_id", "kind", "outcome").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
