"""The dictionary of concepts: candidate definitions, the best of each concept, links from spans, resolution of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import concepts as C
from inkweave.functions import text as T
from inkweave.sources.tables import stage

DEFINES = r":=|\\mathrel\{\\mathop:\}=|\\equiv"


def with_concepts(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """rows once for each concept of their tag. Every different tag is looked up once, however many rows have it."""
    names = rows.select(tag).distinct().withColumn("concept", F.explode(C.concepts_of(F.col(tag))))
    return rows.join(names, tag)


def candidates(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(concept, tier, span_id, chunk_id, page_number, chunk_index) of everything that may define a concept.

    Tier 0: a definition chunk with a definition span, by the tags of the first such span and of the chunk. Tier 1: other
    definition spans, and spans with a defining sign. Tier 2: tags that end in _definition. chunks (chunk_id, page_number,
    chunk_index, structural_type, tags, text), spans (span_id, chunk_id, tags, role, span_text).
    """
    usable = chunks.filter(T.defines(F.col("text"))).select("chunk_id", "page_number", "chunk_index", "structural_type", F.col("tags").alias("chunk_tags"))
    signs = F.regexp_like("span_text", F.lit(DEFINES)).alias("signed")
    rows = spans.select("span_id", "chunk_id", "tags", "role", signs).join(usable, "chunk_id")
    # what four rules read is written once, without its texts
    rows = stage(rows, "defining")
    defining = F.col("role") == "definition"
    anchors = rows.filter(defining & (F.col("structural_type") == "definition")).groupBy("chunk_id", "page_number", "chunk_index")
    anchors = anchors.agg(F.min_by(F.struct("span_id", "tags"), "span_id").alias("a"), F.first("chunk_tags").alias("chunk_tags"))
    top = anchors.select("chunk_id", "page_number", "chunk_index", F.col("a.span_id"), F.array_union("a.tags", "chunk_tags").alias("tags"), F.lit(0).alias("tier"))
    keep = ["chunk_id", "page_number", "chunk_index", "span_id", "tags", "tier"]
    spoken = rows.filter(defining & (F.col("structural_type") != "definition")).withColumn("tier", F.lit(1)).select(keep)
    named = rows.withColumn("tags", F.transform(F.filter("tags", lambda t: t.endswith("_definition")), lambda t: F.regexp_replace(t, "_definition$", ""))).withColumn("tier", F.lit(2)).select(keep)
    signed = rows.filter("signed").withColumn("tier", F.lit(1)).select(keep)
    every = top.unionByName(spoken).unionByName(named).unionByName(signed)
    tags = every.withColumn("tag", F.explode("tags")).filter(C.is_concept_tag(F.col("tag")))
    return with_concepts(tags.drop("tags")).drop("tag")


def _order() -> Column:
    late = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 2**40).otherwise(F.col(c))
    return F.struct("tier", late("page_number").alias("p"), late("chunk_index").alias("i"), "span_id", "chunk_id")


def best(cands: DataFrame) -> DataFrame:
    """The best candidate of each concept: by tier, page, place; unknown or zero pages and places come last.

    A minimum of structs, summed up before the shuffle, so that a concept with very many candidates is no burden.
    """
    w = cands.groupBy("concept").agg(F.min_by(F.struct("tier", "span_id", "chunk_id", "page_number", "chunk_index"), _order()).alias("b"))
    return w.select("concept", "b.*")


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored definitions, replaced where a new one is strictly better, and new concepts."""
    fields = ["tier", "span_id", "chunk_id", "page_number", "chunk_index"]
    a, b = stored.select("concept", F.struct(*fields).alias("old")), new.select("concept", F.struct(*fields).alias("new"))
    both = a.join(b, "concept", "full")
    key = lambda s: F.struct(F.col(f"{s}.tier"), *[F.when(F.coalesce(F.col(f"{s}.{c}"), F.lit(0)) == 0, 2**40).otherwise(F.col(f"{s}.{c}")) for c in ("page_number", "chunk_index")])
    win = F.when(F.col("old").isNull(), F.col("new")).when(F.col("new").isNull(), F.col("old")).when(key("new") < key("old"), F.col("new")).otherwise(F.col("old"))
    return both.select("concept", win.alias("w")).select("concept", "w.*")


def links(spans: DataFrame, dictionary: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(span_id, chunk_id, target_chunk): spans to the definitions of their concepts, once for each target, not to their
    own chunk, and not where an edge (span_id, target_chunk) exists."""
    wanted = with_concepts(spans.select("span_id", "chunk_id", F.explode("tags").alias("tag")))
    found = wanted.join(dictionary.select("concept", F.col("chunk_id").alias("target_chunk")), "concept")
    found = found.filter(F.col("chunk_id") != F.col("target_chunk")).select("span_id", "chunk_id", "target_chunk").distinct()
    return found if existing is None else found.join(existing, ["span_id", "target_chunk"], "left_anti").select("span_id", "chunk_id", "target_chunk")


def gather(chunks: DataFrame, spans: DataFrame, dictionary: DataFrame, most_spoken: int = 20, most_signed: int = 10) -> DataFrame:
    """(concept, chunk_id, tier): where a concept may be defined, with the best tier of each chunk: what the dictionary
    (concept, chunk_id, tier) has, the first spans that define by role (tier 0 in a definition chunk, else 1), and the first
    with a defining sign (tier 1)."""
    tagged = spans.select("span_id", "chunk_id", "role", F.regexp_like("span_text", F.lit(DEFINES)).alias("signed"), F.explode("tags").alias("tag"))
    tagged = with_concepts(tagged.filter((F.col("role") == "definition") | F.col("signed"))).drop("tag").distinct()
    w = Window.partitionBy("concept").orderBy("span_id")
    first = lambda rows, most: rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).select("concept", "chunk_id")
    spoken = first(tagged.filter(F.col("role") == "definition"), most_spoken).join(chunks.select("chunk_id", "structural_type"), "chunk_id")
    spoken = spoken.select("concept", "chunk_id", F.when(F.col("structural_type") == "definition", 0).otherwise(1).alias("tier"))
    signed = first(tagged.filter("signed"), most_signed).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("concept", "chunk_id", F.lit(1).alias("tier"))
    every = dictionary.select("concept", "chunk_id", "tier").unionByName(spoken).unionByName(signed)
    return every.groupBy("concept", "chunk_id").agg(F.min("tier").alias("tier"))


def missing(spans: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Concepts that spans with a definition gap (or of class L) need and the dictionary lacks: (book_id, concept, n)."""
    open_ = spans.filter((F.col("gap_type") == "definition") | (F.col("search_class") == "L"))
    wanted = with_concepts(open_.select("book_id", "span_id", F.explode("tags").alias("tag"))).select("book_id", "span_id", "concept").distinct()
    return wanted.join(dictionary.select("concept"), "concept", "left_anti").groupBy("book_id", "concept").agg(F.count("*").alias("n"))


def resolve(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, concept, stage): concepts of free text. First the whole text; if that hits nothing in the dictionary,
    its synonym; else its single words but weak ones. Names that the dictionary lacks are dropped."""
    known = dictionary.select("concept")
    made = queries.select("query_id", T.snake_form(F.col("text")).alias("snake"), C.normal_term(T.hyphen_form(F.col("text"))).alias("synonym"), T.strong_tokens(T.tokens(F.col("text"))).alias("words"))
    stages = [
        C.concepts_of(F.col("snake")),
        C.concepts_of(F.replace(F.col("synonym"), F.lit(" "), F.lit("_"))),
        C.concepts_of_all(F.col("words")),
    ]
    left, out = made, None
    for k, names in enumerate(stages):
        hits = left.select("query_id", F.explode(names).alias("concept")).distinct().join(known, "concept").select("query_id", "concept", F.lit(k).alias("stage"))
        out = hits if out is None else out.unionByName(hits)
        left = left.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return out


def heuristic_score(kind: Column, tier: Column, preview: Column, structural_type: Column, page_number: Column) -> Column:
    """Score of a definition candidate by its source, tier, length, mathematics, type and place."""
    n = F.length(preview)
    score = (
        F.when(kind == "notes", 30).otherwise(0)
        + (2 - tier) * 10
        + F.when(n >= 300, 8).when(n >= 150, 4).when(n < 50, -5).otherwise(0)
        + F.when(F.contains(preview, F.lit("\\(")), 3).otherwise(0)
        + F.when(F.contains(preview, F.lit("\\[")), 5).otherwise(0)
        + F.when(F.regexp_like(preview, F.lit(r":=|\\equiv")), 6).otherwise(0)
        + F.when(structural_type == "definition", 5).when(structural_type == "theorem", 3).otherwise(0)
        - F.coalesce(page_number, F.lit(0)) * 0.05
    )
    return F.floor(score * 100 + 0.5) / 100


def ranked(cands: DataFrame, verdicts: DataFrame | None = None, most: int = 5) -> DataFrame:
    """The best ``most`` candidates (query_id, chunk_id, score) of each query; ranks in verdicts (query_id, chunk_id,
    verdict_rank) come first, then the score."""
    if verdicts is not None:
        cands = cands.join(verdicts, ["query_id", "chunk_id"], "left")
    else:
        cands = cands.withColumn("verdict_rank", F.lit(None).cast("int"))
    w = Window.partitionBy("query_id").orderBy(F.coalesce("verdict_rank", F.lit(99)), F.desc("score"), "chunk_id")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
