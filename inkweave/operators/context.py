"""What a model is told: sources of page text, the scope of a question, rendered books, notes and overviews.

Everything is rendered by page or by line, never as one string for a whole book, so no row or task grows with a book.
Lines carry the keys that put them in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.operators.prefix import running
from inkweave.sources.tables import stage


def _given(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def _joined(*parts: Column) -> Column:
    """Parts on lines of their own; nulls are left out."""
    return F.concat_ws("\n", *parts)


def _lines(rows: Column, order: list[str]) -> Column:
    """An aggregate: the ``line`` of collected rows, in order, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, rows.alias("line")))), lambda x: x["line"]), "\n")


def picked_source(html: Column, raw: Column, processed: Column) -> Column:
    """struct<source,text>: the plain text of processed HTML, else the raw text; source is vision, raw, or skipped where
    the text is empty."""
    vision = F.coalesce(processed, F.lit(False)) & _given(html)
    text = F.when(vision, T.html_to_text(html, "spans")).otherwise(F.coalesce(raw, F.lit("")))
    return F.struct(F.when(text == "", "skipped").when(vision, "vision").otherwise("raw").alias("source"), text.alias("text"))


def scope(highlight: Column, book: Column, page: Column, collection: Column) -> Column:
    """highlight, page, book, collection or library: the narrowest that the question is anchored to."""
    in_book, on_page = _given(book), _given(book) & F.coalesce(page > 0, F.lit(False))
    return (
        F.when(on_page & _given(highlight), "highlight").when(on_page, "page").when(in_book, "book").when(_given(collection), "collection").otherwise("library")
    )


def token_estimate(text: Column) -> Column:
    """About four characters a token, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)


def page_context(pages: DataFrame, most: int = 3000) -> DataFrame:
    """(book_id, page_number, context) of pages (book_id, page_number, chapter, section, text) with a text: a title line and
    the first ``most`` characters."""
    title = F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.when(_given(F.col("chapter")), F.concat(F.lit(" — "), "chapter")).otherwise(""), F.when(_given(F.col("section")), F.concat(F.lit(" > "), "section")).otherwise(""))
    kept = pages.filter(_given(F.col("text")) & (F.col("page_number") >= 1))
    return kept.select("book_id", "page_number", _joined(F.concat(title, F.lit(":")), F.substring("text", 1, most)).alias("context"))


def chapter_lines(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, line) of pages that begin a chapter; in order of page they are the book's chapters."""
    line = F.concat(F.lit("  p."), F.col("page_number").cast("string"), F.lit(": "), "chapter", F.when(_given(F.col("section")), F.concat(F.lit(" > "), "section")).otherwise(""))
    return pages.filter(F.col("chapter").isNotNull()).select("book_id", "page_number", line.alias("line"))


def page_chunk_lines(chunks: DataFrame) -> DataFrame:
    """(book_id, page_number, context): a line for each chunk of a page, its type and its tags."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" tags: "), F.array_join("tags", ", "))).otherwise("")
    line = F.concat(F.lit("["), F.coalesce("structural_type", F.lit("unknown")), F.lit("]"), tags)
    return chunks.groupBy("book_id", "page_number").agg(_lines(line, ["chunk_index"]).alias("context"))


def highlight_chunk(highlights: DataFrame, chunks: DataFrame, probe: int = 50) -> DataFrame:
    """(highlight_id, chunk_id): the first chunk of the highlight's page that holds its first ``probe`` characters.

    highlights (highlight_id, book_id, page_number, highlight).
    """
    met = highlights.join(chunks.select("book_id", "page_number", "chunk_id", "chunk_index", "text"), ["book_id", "page_number"])
    hit = met.filter(F.contains("text", F.substring("highlight", 1, probe)))
    return hit.groupBy("highlight_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))


def short_middle(line: Column, most: int = 120, head: int = 80, tail: int = 40) -> Column:
    """A line; a longer one without its middle."""
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, head), F.lit("..."), F.right(line, F.lit(tail))))


def book_metadata(chunks: DataFrame, spans: DataFrame, edges: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """(book_id, page_number, block): for each page of a book its chunks with tags and text, their spans, and the spans'
    edges with a quote of where they lead. Pages in order make the book.

    spans (span_id, chunk_id, sentence, role, search_class, tags, span_text), edges (edge_id, from_span, to_chunk, to_book,
    relation, confidence). Chunks, spans and edges meet by equality; lists are those of one chunk.

    numbers (span_id, chunk_id, page_number) are those of all spans, where these come cheaply and spans know their book_id and
    page_number, the page being that of their chunk. What is dealt by page (chunks, spans) is then not dealt again: edges come to
    the pages of their spans. Pages that share the number of a chunk show the spans of each other, as without numbers.
    """
    s = lambda c: F.col(c).cast("string")
    if numbers is None:
        spans = spans.drop("book_id", "page_number").join(chunks.select("chunk_id", "page_number").distinct(), "chunk_id").withColumn("book_id", F.lit(None).cast("string"))
        numbers = spans
    else:
        met = numbers.select("chunk_id", "page_number").distinct().groupBy("chunk_id").agg(F.collect_set("page_number").alias("on")).filter(F.size("on") > 1)
        shared = met.select("chunk_id", F.explode("on").alias("page_number"), "on").select("chunk_id", "page_number", F.explode("on").alias("other")).filter("page_number <> other")
        shared = stage(shared, "shared")
        if not shared.isEmpty():
            everywhere = lambda rows: rows.unionByName(rows.join(shared, ["chunk_id", "page_number"]).withColumn("page_number", F.col("other")).drop("other"))
            spans, numbers = everywhere(spans), everywhere(numbers)
    target = chunks.select(F.col("chunk_id").alias("to_chunk"), F.col("page_number").alias("to_page"), F.col("structural_type").alias("to_type"), F.substring(T.squeeze(F.col("text")), 1, 200).alias("quote"))
    edge = F.concat(
        F.lit("          edge → "), "relation", F.lit(" (conf="), "confidence", F.lit(') target_book_id="'), "to_book", F.lit('" target_page='), s("to_page"), F.lit(" target_type="), F.coalesce("to_type", F.lit("?")),
        F.lit('\n            target_quote: "'), "quote", F.lit('"'),
    )
    begin = numbers.select("span_id", "page_number").repartition("span_id").dropDuplicates()
    linked = edges.select("edge_id", F.col("from_span").alias("span_id"), "to_chunk", "to_book", "relation", "confidence").join(begin, "span_id").join(target, "to_chunk")
    by_span = linked.repartition("page_number").groupBy("page_number", "span_id").agg(_lines(edge, ["edge_id"]).alias("edges"))
    # rows are gathered by page before they meet, by the page alone: neither side is dealt again, and no row is copied with a page's map
    of_spans = by_span.groupBy("page_number").agg(F.map_from_entries(F.collect_list(F.struct("span_id", "edges"))).alias("edges"))
    shown = F.concat(F.lit("      • span role="), "role", F.lit(" class="), "search_class", F.lit(" span_tags=["), F.array_join(F.slice("tags", 1, 8), ","), F.lit('] "'), short_middle(F.col("flat")), F.lit('"'))
    in_chunk = spans.withColumn("flat", T.squeeze(F.coalesce("span_text", F.lit("")))).groupBy("page_number", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "book_id", "span_id", shown.alias("shown")))).alias("spans"))
    on_page = in_chunk.filter(F.col("chunk_id").isNotNull()).groupBy("page_number").agg(F.collect_list(F.struct("chunk_id", "spans")).alias("c"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: _joined(x["shown"], F.try_element_at("edges", x["span_id"]))), "\n")
    of_chunks = on_page.join(of_spans.hint("shuffle_hash"), "page_number", "left").select("page_number", F.map_from_entries(F.transform("c", lambda c: F.struct(c["chunk_id"], listed(c["spans"])))).alias("spans"))
    flat = T.squeeze(F.col("text"))
    head = _joined(
        F.concat(F.lit("  Chunk #"), s("chunk_index"), F.lit(" ("), F.coalesce("structural_type", F.lit("unknown")), F.lit(")")),
        F.when(F.size("tags") > 0, F.concat(F.lit("    chunk_tags: "), F.array_join(F.slice("tags", 1, 20), ", "))),
        F.concat(F.lit('    chunk_text: "'), F.substring(flat, 1, 220), F.when(F.length("text") > 220, "…").otherwise(""), F.lit('"')),
    )
    heads = chunks.groupBy("book_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", head.alias("head")))).alias("c"))
    made = heads.hint("shuffle_hash").join(of_chunks, "page_number", "left")
    body = F.array_join(F.transform("c", lambda c: _joined(c["head"], F.try_element_at("spans", c["chunk_id"]))), "\n")
    return made.select("book_id", "page_number", _joined(F.concat(F.lit("  [Page "), s("page_number"), F.lit("]")), body).alias("block"))


def note_blocks(notes: DataFrame, body_chars: int = 800, quote_chars: int = 180) -> DataFrame:
    """(book_id, page_number, block): the notes of each page, oldest first, with the highlight that they are on.

    notes (note_id, book_id, page_number, created, title, content: HTML, highlight). Blocks of a book in order of page are
    its notes, those of all books the library's (with 600 and 160 characters there).
    """
    body = F.substring(T.html_to_text(F.coalesce("content", F.lit("")), "notes"), 1, body_chars)
    quote = F.substring(T.squeeze(F.coalesce("highlight", F.lit(""))), 1, quote_chars)
    note = _joined(
        F.concat(F.lit("    • Note"), F.when(_given(F.col("title")), F.concat(F.lit(' "'), "title", F.lit('"'))).otherwise("")),
        F.when(_given(F.col("highlight")), F.concat(F.lit('        on highlight: "'), quote, F.lit('"'))),
        F.when(body != "", F.concat(F.lit("        "), F.replace(body, F.lit("\n"), F.lit("\n        ")))),
    )
    made = notes.groupBy("book_id", "page_number").agg(_lines(note, ["created", "note_id"]).alias("body"))
    page = F.coalesce(F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.lit("?"))
    return made.select("book_id", "page_number", _joined(F.concat(F.lit("    [Page "), page, F.lit("]")), F.col("body")).alias("block"))


def overview_lines(books: DataFrame, most: int = 3) -> DataFrame:
    """(book_id, line) of books (book_id, title, author, concepts, status): id, title, author and the first concepts; books
    that only citations name are left out."""
    author = F.when(_given(F.col("author")), F.concat(F.lit(" ("), "author", F.lit(")"))).otherwise("")
    concepts = F.when(F.size("concepts") > 0, F.concat(F.lit(" ["), F.array_join(F.slice("concepts", 1, most), ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- id="), "book_id", F.lit(' "'), "title", F.lit('"'), author, concepts)
    return books.filter(~F.col("status").eqNullSafe("pending-citation")).select("book_id", line.alias("line"))


def collection_lines(collections: DataFrame, books: DataFrame) -> DataFrame:
    """(collection_id, book_id, line) of the books of each collection (collection_id, book_ids)."""
    line = F.concat(
        F.lit("  - id="), "book_id", F.lit(' | "'), "title", F.lit('"'), F.when(_given(F.col("author")), F.concat(F.lit(" by "), "author")).otherwise(""),
        F.when(F.col("page_count") > 0, F.concat(F.lit(" ("), F.col("page_count").cast("string"), F.lit(" pp.)"))).otherwise(""),
    )
    return collections.select("collection_id", F.explode("book_ids").alias("book_id")).join(books, "book_id").select("collection_id", "book_id", line.alias("line"))


def rematch_books(books: DataFrame, changed: DataFrame) -> DataFrame:
    """(book_id, changed_book): books of notes that link to a changed book (book_id) and so are matched again."""
    linked = books.filter(F.col("kind") == "notes").select("book_id", F.explode("linked_books").alias("changed_book"))
    return linked.join(changed.select(F.col("book_id").alias("changed_book")), "changed_book", "left_semi").distinct().select("book_id", "changed_book")


def within_calls(rows: DataFrame, by: str, order: list[str], calls: str, most: int = 200) -> DataFrame:
    """Rows in order until ``most`` calls are spent: a row is taken while fewer calls were spent before it. The order tells
    rows apart, and no task holds a whole group."""
    return running(rows, by, order, {"spent": F.col(calls)}, ("spent", lambda spent: spent < most))


def reloads(uses: DataFrame, by: str, at: str, ttl_seconds: int = 300) -> DataFrame:
    """(by, uses, loads): how often a cache that lives ttl_seconds loads, for uses at times: at the first use, and at the
    first after each load's end. Times of a key fold in order."""
    begin = F.struct(F.lit(0).cast("long").alias("loads"), F.lit(None).cast("double").alias("since"))

    def step(state, t):
        stale = state["since"].isNull() | (t - state["since"] >= ttl_seconds)
        return F.struct(F.when(stale, state["loads"] + 1).otherwise(state["loads"]).alias("loads"), F.when(stale, t).otherwise(state["since"]).alias("since"))

    times = F.array_sort(F.collect_list(F.col(at).cast("timestamp").cast("double")))
    return uses.groupBy(by).agg(times.alias("t")).select(by, F.size("t").cast("long").alias("uses"), F.aggregate("t", begin, step, lambda s: s["loads"]).alias("loads"))
