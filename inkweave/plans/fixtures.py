"""Tables and injected text that queries start from, built alike in Spark and in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.sources.tables import read, stage


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages")


# ── helpers for DuckDB SQL ──


def q(value: str) -> str:
    """A SQL string."""
    return "'" + value.replace("'", "''") + "'"


def duck_strip(expression: str) -> str:
    return rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"


def duck_chain(expression: str, steps: list[tuple[str, str]]) -> str:
    return reduce(lambda e, s: f"regexp_replace({e}, {q(s[0])}, {q(s[1])}, 'g')", steps, expression)


def duck_sentences(expression: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({expression}, '\.\s+', '.' || chr(1), 'g'), chr(1) || '|\n\n+'), lambda x: {duck_strip('x')}), lambda x: x <> '')"


def like_any(expression: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({expression}, {q(p)})" for p in patterns) + ")"


# ── spans and chunks out of documents ──

TAGS = [
    "hidden_zero_identity", "ym_amplitude_factor", "bcfw_shift", "uv_scaling_law", "soft_limit_check", "plain_note", "zero_causal_diamond_factorization",
    "kinematic_mesh_definition", "tr_phi3_conjecture", "local_term", "scaffolding_theorem", "string_amplitude_zero", "planar_variables",
]
ROLES = ["claim", "background", "definition", "proof", "result", "citation", "remark"]
CLASSES = ["N", "L", "I", "S", "B"]


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def duck_pick(values: list[str], number: str) -> str:
    return f"[{', '.join(q(v) for v in values)}][({number}) % {len(values)} + 1]"


def tag_of(number: Column, k: int) -> Column:
    return pick(TAGS, number * (2 * k + 1) + k)


DUCK = {"tag_of": lambda number, k: duck_pick(TAGS, f"{number} * {2 * k + 1} + {k}")}


def spans(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """One span for each sentence of the documents: (span_id, book_id, page_number, sentence, tags, role, search_class, gap_type, span_text).

    A document is a page of the book that its source is; its page number is its id. ``of`` are the documents with their sentences,
    if these are at hand.
    """
    cut, sentences = (documents(spark, sf), T.sentences(F.col("text"))) if of is None else (of, F.col("sentences"))
    found = cut.select("doc_id", F.col("source").alias("book_id"), F.posexplode(sentences).alias("at", "span_text"))
    n = F.col("doc_id") * 3 + F.col("at")
    return found.select(
        (F.col("doc_id") * 10_000 + F.col("at") + 1).alias("span_id"),
        "book_id",
        F.col("doc_id").alias("page_number"),
        (F.col("at") + 1).alias("sentence"),
        F.array(tag_of(n, 0), tag_of(n, 1)).alias("tags"),
        pick(ROLES, n).alias("role"),
        pick(CLASSES, n).alias("search_class"),
        F.when(n % len(CLASSES) == 1, pick(["definition", "derivation", "proof"], n)).alias("gap_type"),
        "span_text",
    )


_N = "(doc_id * 3 + pos)"
DUCK_SPANS = f"""(SELECT doc_id * 10000 + pos + 1 AS span_id, source AS book_id, doc_id AS page_number, (pos + 1)::int AS sentence, [{DUCK['tag_of'](_N, 0)}, {DUCK['tag_of'](_N, 1)}] AS tags,
 {duck_pick(ROLES, _N)} AS role, {duck_pick(CLASSES, _N)} AS search_class, CASE WHEN {_N} % {len(CLASSES)} = 1 THEN {duck_pick(['definition', 'derivation', 'proof'], _N)} END AS gap_type, s[pos + 1] AS span_text
 FROM (SELECT doc_id, source, s, unnest(range(0, len(s))) AS pos FROM (SELECT doc_id, source, {duck_sentences('text')} AS s FROM documents)))"""


def chunks(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Spans in chunks of eight by their place: (chunk_id, book_id, page_number, chunk_index, start, end, tags, structural_type, text, words).

    The full rules are those of operators.segments; this is the plain case in which only the cap fires. ``of`` are the spans, if
    they are at hand.
    """
    index = F.floor((F.col("sentence") - 1) / 8).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("sentence", "span_text", "tags")))
    grouped = (spans(spark, sf) if of is None else of).groupBy("book_id", "page_number", index.alias("chunk_index")).agg(ordered.alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["span_text"]), " ")
    return grouped.select(
        (F.col("page_number") * 1000 + F.col("chunk_index")).alias("chunk_id"),
        "book_id",
        "page_number",
        "chunk_index",
        F.col("s")[0]["sentence"].alias("start"),
        F.element_at("s", -1)["sentence"].alias("end"),
        F.array_distinct(F.flatten(F.transform("s", lambda x: x["tags"]))).alias("tags"),
        pick(["narrative", "definition", "theorem", "proof", "example"], F.col("page_number") + F.col("chunk_index")).alias("structural_type"),
        body.alias("text"),
        F.size(F.split(body, r"\s+")).alias("words"),
    )


DUCK_CHUNKS = rf"""(SELECT page_number * 1000 + ci AS chunk_id, book_id, page_number, ci AS chunk_index, min(sentence) AS start, max(sentence) AS "end",
 list_filter(flatten(list(tags ORDER BY sentence)), lambda x, i: list_position(flatten(list(tags ORDER BY sentence)), x) = i) AS tags,
 {duck_pick(['narrative', 'definition', 'theorem', 'proof', 'example'], 'page_number + ci')} AS structural_type, string_agg(span_text, ' ' ORDER BY sentence) AS text,
 len(string_split_regex(string_agg(span_text, ' ' ORDER BY sentence), '\s+')) AS words FROM (SELECT *, ((sentence - 1) // 8)::int AS ci FROM {DUCK_SPANS}) GROUP BY book_id, page_number, ci)"""


# ── edges between chunks ──

RELATIONS = ["proves", "extends", "assumes", "uses_definition", "contradicts", "prerequisite", "equivalent", "missing_proof", "annotates"]
METHODS = ["lexical", "llm", "note-citation"]


def letter(number: Column) -> Column:
    return F.char((number % 26 + 97).cast("long"))


def library(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(spans, chunks), each written once: texts are read and cut one time for all that follows."""
    made = stage(spans(spark, sf), "spans")
    return made, stage(chunks(spark, sf, made), "chunks")


def edges(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """One edge from each chunk (``of``, if they are at hand) to the first chunk of an earlier page (or its own), with letters and kinds by arithmetic."""
    n = F.col("page_number") + F.col("chunk_index")
    out = (chunks(spark, sf) if of is None else of).select(
        F.col("chunk_id").alias("edge_id"),
        F.col("chunk_id").alias("from_chunk"),
        F.when(n % 7 != 6, F.col("page_number") * 10_000 + F.col("chunk_index") * 8 + 1).alias("from_span"),
        F.col("book_id").alias("from_book"),
        F.col("page_number").alias("from_page"),
        F.least(F.col("page_number"), F.floor((F.col("page_number") * 3 + F.col("chunk_index")) / 4)).alias("to_page"),
        pick(RELATIONS, n).alias("relation"),
        letter(n * 5).alias("confidence"),
        letter(n * 11 + 3).alias("relevance"),
        pick(METHODS, n).alias("method"),
    )
    books = documents(spark, sf).select(F.col("doc_id").alias("to_page"), F.col("source").alias("to_book"))
    return out.join(books, "to_page").withColumn("to_chunk", F.col("to_page") * 1000)


_E = "(page_number + chunk_index)"
DUCK_EDGES = f"""(SELECT e.*, d.source AS to_book, to_page * 1000 AS to_chunk FROM (SELECT chunk_id AS edge_id, chunk_id AS from_chunk, CASE WHEN {_E} % 7 <> 6 THEN page_number * 10000 + chunk_index * 8 + 1 END AS from_span, book_id AS from_book,
 page_number AS from_page, least(page_number, (page_number * 3 + chunk_index) // 4) AS to_page, {duck_pick(RELATIONS, _E)} AS relation, chr(({_E} * 5 % 26 + 97)::int) AS confidence, chr((({_E} * 11 + 3) % 26 + 97)::int) AS relevance, {duck_pick(METHODS, _E)} AS method FROM {DUCK_CHUNKS}) e JOIN documents d ON d.doc_id = e.to_page)"""


def duck_weight(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({c}, '^[A-Za-z]') THEN 123 - ascii(lower({c})) END, 26)"
