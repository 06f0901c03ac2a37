"""Graph operators over edges (edge_id, from_chunk, to_chunk, relation, confidence, relevance, ...); z is the best letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkweave.functions.scales import path_weight
from inkweave.sources.tables import stage


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (chunk_id, other_id, direction, ...). Two equi-joinable sides take the place of an OR."""
    out = edges.withColumn("chunk_id", F.col("from_chunk")).withColumn("other_id", F.col("to_chunk")).withColumn("direction", F.lit("out"))
    back = edges.withColumn("chunk_id", F.col("to_chunk")).withColumn("other_id", F.col("from_chunk")).withColumn("direction", F.lit("in"))
    return out.unionByName(back)


def follow(edges: DataFrame, most: int = 50) -> DataFrame:
    """The best edges of each chunk in either direction: by confidence, then relevance, then id."""
    w = Window.partitionBy("chunk_id").orderBy(path_weight(F.col("confidence")), path_weight(F.col("relevance")), "edge_id", "direction")
    return both_ways(edges).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_edges: int = 10, targets: DataFrame | None = None) -> DataFrame:
    """Least weight from each seed to each chunk (of targets, where given) by at most max_edges edges: (seed, chunk_id,
    weight, path).

    One relaxation a round: only what the round before improved joins the edges, and the least weight by (seed, chunk)
    stays; equal weights keep the path that comes first. Every second round is a table in the shared folder; the rounds end
    when one of those improves nothing. With targets, chunks with a single neighbour that are neither seeds nor targets are left out: no
    path between others leads through them.
    """
    steps = both_ways(edges).groupBy("chunk_id", "other_id").agg(F.min(path_weight(F.col("confidence"))).alias("step"))
    steps = stage(steps, "steps")
    if targets is not None:
        inner = steps.filter("chunk_id <> other_id").groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id")
        kept = inner.union(seeds.select("chunk_id")).union(targets.select("chunk_id")).distinct()
        steps = stage(steps.join(kept, "chunk_id", "left_semi").join(kept.withColumnRenamed("chunk_id", "other_id"), "other_id", "left_semi"), "steps")
    reached = seeds.select(F.col("chunk_id").alias("seed"), "chunk_id", F.struct(F.lit(0).cast("long").alias("weight"), F.array("chunk_id").alias("path")).alias("best"), F.lit(True).alias("fresh"))
    for k in range(max_edges):
        ahead = F.struct((F.col("best.weight") + F.col("step")).alias("weight"), F.array_append("best.path", F.col("other_id")).alias("path"))
        further = reached.filter("fresh").join(steps, "chunk_id").select("seed", F.col("other_id").alias("chunk_id"), ahead.alias("best"), F.lit(None).cast(reached.schema["best"].dataType).alias("old"))
        every = reached.select("seed", "chunk_id", "best", F.col("best").alias("old")).unionByName(further)
        reached = every.groupBy("seed", "chunk_id").agg(F.min("best").alias("best"), F.min("old").alias("old"))
        reached = reached.select("seed", "chunk_id", "best", (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("fresh"))
        if k % 2 and k + 1 < max_edges:
            seen = Observation()
            reached = stage(reached.observe(seen, F.count_if("fresh").alias("n")), "paths")
            if not seen.get["n"]:
                break
    if targets is not None:
        reached = reached.join(targets.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return reached.select("seed", "chunk_id", "best.weight", "best.path")


def resolve_chains(nodes: DataFrame, following: DataFrame, max_hops: int = 8) -> DataFrame:
    """Where a chain of replacements ends: (id, resolved) for nodes (id) and following (id, next).

    After max_hops the chain stops where it is; a chain that comes back to a node it has seen gives the node itself.
    """
    nexts = following.select(F.col("id").alias("at"), F.col("next"))
    state = nodes.select("id", F.col("id").alias("at"), F.array("id").alias("seen"), F.lit(False).alias("cycle"))
    for _ in range(max_hops):
        moved = state.join(nexts, "at", "left")
        again = ~F.col("cycle") & F.coalesce(F.array_contains("seen", F.coalesce("next", F.lit(-1))), F.lit(False)) & F.col("next").isNotNull()
        going = F.col("next").isNotNull() & ~F.col("cycle") & ~again
        state = moved.select("id", F.when(going, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(going, F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"), (F.col("cycle") | again).alias("cycle"))
    return state.select("id", F.when(F.col("cycle"), F.col("id")).otherwise(F.col("at")).alias("resolved"))


def page_view(chunks: DataFrame, spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of all pages with their spans and best edges: of edges with one direction, relation and other chunk the
    best one is shown, in order of weight."""
    per = spans.groupBy("chunk_id").agg(F.count("*").alias("n_spans"), F.sum((F.col("search_class") != "N").cast("int")).alias("n_open"))
    order = F.struct(path_weight(F.col("confidence")).alias("weight"), path_weight(F.col("relevance")).alias("less"), "edge_id")
    best = both_ways(edges).groupBy("chunk_id", "direction", "relation", "other_id").agg(F.min(order).alias("b"))
    shown = F.struct("b.weight", "b.edge_id", "direction", "relation", "other_id")
    linked = best.groupBy("chunk_id").agg(F.array_sort(F.collect_list(shown)).alias("edges"))
    return chunks.join(per, "chunk_id", "left").join(linked, "chunk_id", "left")


def edge_dump(edges: DataFrame) -> DataFrame:
    """One edge for each source span and target book, by method (llm, lexical, note-citation), then id; edges without a
    span all stay."""
    rank = F.when(F.col("method") == "llm", 3).when(F.col("method") == "lexical", 2).when(F.col("method") == "note-citation", 1).otherwise(0)
    w = Window.partitionBy("from_span", "to_book").orderBy(F.desc(rank), "edge_id")
    best = edges.filter(F.col("from_span").isNotNull()).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
    return best.unionByName(edges.filter(F.col("from_span").isNull()))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_chunk").alias("chunk_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("to_chunk").alias("chunk_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("chunk_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


#: Relations read backwards, and those that carry over two steps.
RECIPROCAL = {"extends": "extended_by", "proves": "proved_by", "uses_definition": "defines_for", "prerequisite": "required_by", "equivalent": "equivalent"}
TRANSITIVE = ["prerequisite", "equivalent", "extends"]


def with_reciprocals(edges: DataFrame) -> DataFrame:
    """Extension: edges and their readings backwards, where a relation has one."""
    names = F.create_map(*[F.lit(x) for pair in RECIPROCAL.items() for x in pair])
    back = edges.select(F.col("to_chunk").alias("from_chunk"), F.col("from_chunk").alias("to_chunk"), F.try_element_at(names, F.col("relation")).alias("relation")).filter(F.col("relation").isNotNull())
    return edges.select("from_chunk", "to_chunk", "relation").unionByName(back)


def closure(edges: DataFrame, relation: str) -> DataFrame:
    """Extension: pairs connected by any number of edges of one relation: (from_chunk, to_chunk).

    Each round doubles the length of the paths, and is a table in the shared folder, until no pair is new.
    """
    pairs = stage(edges.filter(F.col("relation") == relation).select("from_chunk", "to_chunk").distinct(), "closure")
    n, before = pairs.count(), -1
    while n != before:
        ahead = pairs.select(F.col("from_chunk").alias("to_chunk"), F.col("to_chunk").alias("end"))
        pairs = stage(pairs.unionByName(pairs.join(ahead, "to_chunk").select("from_chunk", F.col("end").alias("to_chunk"))).distinct(), "closure")
        n, before = pairs.count(), n
    return pairs
