"""Bibliographies, citations and typed edges between books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import concepts as C
from inkweave.functions import identifiers as I
from inkweave.functions import scales as S
from inkweave.functions import text as T
from inkweave.sources.tables import stage


def tag_text_score(tags: Column, text: Column) -> Column:
    """How many tags a text bears out: as a phrase, or by a word for each longer part with the same first four letters."""

    def hits(v):
        def hit(tag):
            phrase = F.lower(F.replace(tag, F.lit("_"), F.lit(" ")))
            parts = F.filter(F.split(phrase, r"\s+"), lambda t: F.length(t) >= 4)
            return F.contains(v["low"], phrase) | ((F.size(parts) > 0) & F.forall(parts, lambda t: F.array_contains(v["starts"], F.substring(t, 1, 4))))

        return F.size(F.filter(tags, hit))

    starts = lambda low: F.array_distinct(F.transform(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))
    return T.once(F.lower(F.coalesce(text, F.lit(""))), lambda low: T.once(F.struct(low.alias("low"), starts(low).alias("starts")), hits))


def resolve_entries(entries: DataFrame, books: DataFrame) -> DataFrame:
    """entries (book_id, key, arxiv_id, doi, ...) with resolved_book: the book of that arXiv id, else of that DOI, but not
    the citing book. books (book_id, arxiv_id, doi)."""
    by = lambda c: books.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("book_id").alias(f"by_{c}"))
    both = entries.join(by("arxiv_id"), "arxiv_id", "left").join(by("doi"), "doi", "left")
    other = lambda c: F.when(F.col(c) != F.col("book_id"), F.col(c))
    return both.withColumn("resolved_book", F.coalesce(other("by_arxiv_id"), other("by_doi"))).drop("by_arxiv_id", "by_doi")


def stubs(entries: DataFrame) -> DataFrame:
    """Books to be created for unresolved entries with an id: one for each id, from its first entry."""
    found = entries.filter(F.col("resolved_book").isNull()).withColumn("identifier", F.coalesce("arxiv_id", "doi")).filter(F.col("identifier").isNotNull())
    return found.groupBy("identifier").agg(F.min(F.struct("book_id", "key")).alias("first"), F.count("*").alias("n")).select("identifier", "first.*", "n")


def reconcile(entries: DataFrame, replaced: DataFrame) -> DataFrame:
    """entries with references to stubs (stub, book) turned to the real book."""
    r = replaced.select(F.col("stub").alias("resolved_book"), F.col("book").alias("_real"))
    return entries.join(r, "resolved_book", "left").withColumn("resolved_book", F.coalesce("_real", "resolved_book")).drop("_real")


def without_bibliography(chunks: DataFrame, share: float = 0.6, shortest: int = 40) -> DataFrame:
    """Chunks but those that look like a bibliography, those of pages of which at least ``share`` do, and short ones."""
    marked = chunks.withColumn("_bib", I.looks_like_bibliography(F.col("text")))
    bad = marked.groupBy("book_id", "page_number").agg(F.avg(F.col("_bib").cast("int")).alias("r")).filter(F.col("r") >= share)
    left = marked.filter(~F.col("_bib") & (F.length(T.strip(F.col("text"))) >= shortest)).drop("_bib")
    return left.join(bad.select("book_id", "page_number"), ["book_id", "page_number"], "left_anti")


def complete_citations(pages: DataFrame, covered: DataFrame) -> DataFrame:
    """Synthetic spans for cited keys that no span covers: one for each sentence, with a tag for each key.

    pages (page_id, text), covered (page_id, key). (page_id, sentence from 1, keys in order, tags, text).
    """
    s = pages.select("page_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "text"))
    keyed = s.select("page_id", (F.col("at") + 1).alias("sentence"), "text", F.explode(I.citation_keys(F.col("text"))).alias("key"))
    first = keyed.groupBy("page_id", "key").agg(F.min_by(F.struct("sentence", "text"), "sentence").alias("f")).select("page_id", "key", "f.*")
    open_ = first.join(covered, ["page_id", "key"], "left_anti")
    made = open_.groupBy("page_id", "sentence", "text").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    tags = F.array_append(F.transform("keys", lambda k: F.concat(F.lit("citation_to_ref_"), k)), F.lit("auto_citation_span"))
    return made.withColumn("tags", tags)


def target_score(overlap: Column, direct: Column, text_hits: Column, page: Column, structural_type: Column, index: Column) -> Column:
    """How well a chunk answers a citing span."""
    boost = F.when(page == 1, 0.0).when(page == 2, 0.05).when(page == 3, 0.10).otherwise(0.15)
    kind = F.when(overlap >= 2, F.when(structural_type.isin("definition", "theorem", "lemma", "proposition"), 0.15).when(structural_type.isin("proof", "corollary"), 0.10).otherwise(0.0)).otherwise(0.0)
    order = F.greatest(F.lit(0.0), 0.01 - 0.00001 * F.coalesce(index, F.lit(0)))
    return overlap + boost + kind + order + F.least(F.lit(1.5), 0.4 * text_hits) + direct * 0.5


#: Characters of asking keys that are sent to all tasks; beyond that both sides are dealt by key.
SENT = 16_000_000
#: The key of every chunk, for tags that a text can bear out without having a word that begins like one of theirs.
ANY = "*"


def probes(tags: Column) -> Column:
    """array<struct<phrase,starts,key>> of tags: the phrase, the first four letters of its longer words, and the beginning of
    a word that every text has which bears the tag out (of the longest word behind a space), or null."""

    def probe(tag):
        phrase = F.lower(F.replace(tag, F.lit("_"), F.lit(" ")))
        return T.once(F.struct(phrase.alias("phrase"), F.split(phrase, r"\s+").alias("words")), parts)

    def parts(v):
        begin = lambda w: F.substring(w, 1, 4)
        # the first word may stand inside a longer one of the text, the others follow a space
        later = F.filter(F.slice(v["words"], F.lit(2), F.size(v["words"])), lambda w: F.regexp_like(w, F.lit("^[a-z0-9]{4}")))
        key = begin(F.array_max(F.transform(later, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
        starts = F.array_distinct(F.transform(F.filter(v["words"], lambda w: F.length(w) >= 4), begin))
        return F.struct(v["phrase"].alias("phrase"), starts.alias("starts"), key.alias("key"))

    return F.transform(tags, probe)


def best_targets(citing: DataFrame, chunks: DataFrame, least: float = 1.0) -> DataFrame:
    """The best chunk of the cited book for each citing span: (span_id, target_book, chunk_id, overlap, score).

    citing (span_id, target_book, tags); chunks (book_id, chunk_id, chunk_index, page_number, structural_type, tags, text).
    Spans with the same tags ask the same of a book, so each set of tags is answered once for each book. Asking sets meet
    chunks by shared concepts and by shared beginnings of words (four letters, those of tags against those of texts), both
    equi-joins within the book. While the asking keys are few they go to all tasks: a chunk is then scored where it is made,
    and no text is shuffled for it. citing is read twice. Ties go to the smaller id.
    """
    # longer than the beginning of a word, so never equal to one
    concept_keys = lambda c: F.transform(c, lambda x: F.concat(F.lit("concept:"), x))
    lower = lambda tags: F.transform(tags, F.lower)
    citing = citing.filter(F.size("tags") > 0).select("span_id", F.col("target_book").alias("book_id"), F.array_sort("tags").alias("own"))
    asks = citing.select("book_id", "own").distinct().withColumn("ask", F.monotonically_increasing_id())
    asks = asks.withColumn("own_concepts", C.concepts_of_all(F.col("own"))).withColumn("probes", probes(F.col("own"))).withColumn("own_low", lower("own"))
    word_keys = F.transform("probes", lambda p: F.coalesce(p["key"], F.lit(ANY)))
    asks = stage(asks.withColumn("own_keys", F.array_distinct(F.concat(concept_keys(F.col("own_concepts")), word_keys))), "asks")
    # a pair with several keys in common counts at the first of them: those before it are none of the chunk's
    asking = asks.select("*", F.posexplode("own_keys").alias("at", "k")).withColumn("earlier", F.slice("own_keys", F.lit(1), F.col("at"))).drop("at", "own", "own_keys")
    held = asking.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0

    # chunks without keys meet no one. Filters (or explode's own test, or one for nulls) Spark would move below what they test, and compute that twice
    bib = I.is_bibliography_text(F.col("text")).alias("bib")
    usable = chunks.select("book_id", "chunk_id", "chunk_index", "page_number", "structural_type", lower("tags").alias("tags"), C.concepts_of_all(F.col("tags")).alias("concepts"), F.lower("text").alias("low"), bib)
    starts = F.array_distinct(F.regexp_extract_all("low", F.lit("(?<![a-z0-9])[a-z0-9]{4}"), F.lit(0)))
    usable = usable.withColumn("keys", F.coalesce(F.when(~F.col("bib"), F.concat(concept_keys(F.col("concepts")), starts, F.array(F.lit(ANY)))), F.array().cast("array<string>"))).drop("bib")
    if held <= SENT:
        met = usable.withColumn("k", F.explode_outer("keys")).join(F.broadcast(asking), ["book_id", "k"]).filter(~F.arrays_overlap("earlier", "keys"))
    else:
        pairs = asking.select("book_id", "ask", "k").join(usable.select("book_id", "chunk_id", F.explode_outer("keys").alias("k")), ["book_id", "k"])
        met = pairs.select("book_id", "ask", "chunk_id").distinct().join(asks.drop("book_id"), "ask").join(usable, ["book_id", "chunk_id"])

    hit = lambda p: F.contains("low", p["phrase"]) | ((F.size(p["starts"]) > 0) & F.forall(p["starts"], lambda t: F.array_contains("keys", t)))
    overlap, direct = F.size(F.array_intersect("own_concepts", "concepts")), F.size(F.array_intersect("own_low", "tags"))
    full = met.withColumn("overlap", overlap).withColumn("hits", F.size(F.filter("probes", hit)))
    score = target_score(F.col("overlap"), direct, F.col("hits"), F.col("page_number"), F.col("structural_type"), F.col("chunk_index"))
    scored = full.select("ask", "chunk_id", "overlap", F.when((F.col("overlap") > 0) | (F.col("hits") > 0), F.round(score, 6)).alias("score"))
    best = scored.groupBy("ask").agg(F.max(F.struct("score", (-F.col("chunk_id")).alias("minus"), "overlap")).alias("b")).filter(F.col("b.score") >= least)
    best = best.join(asks.select("ask", "book_id", "own"), "ask").select("book_id", "own", (-F.col("b.minus")).alias("chunk_id"), "b.overlap", "b.score")
    return citing.join(best, ["book_id", "own"]).select("span_id", F.col("book_id").alias("target_book"), "chunk_id", "overlap", "score")


def lexical_edges(targets: DataFrame, spans: DataFrame) -> DataFrame:
    """One edge for each (source book, target chunk): the winner by confidence, relation, score, earlier sentence, then id;
    the other spans are related spans. spans (span_id, book_id, role, sentence)."""
    rows = targets.join(spans, "span_id").withColumn("relation", S.role_relation(F.col("role"))).withColumn("confidence", S.overlap_letter(F.col("overlap")))
    # the winner is a minimum of structs, summed up before the shuffle; nothing is sorted by target
    order = F.struct((-S.low_is_best_rank(F.col("confidence"))).alias("c"), (-S.relation_rank(F.col("relation"))).alias("r"), (-F.col("score")).alias("s"), "sentence", "span_id")
    win = F.min_by(F.struct("span_id", "relation", "confidence", "score", "target_book"), order).alias("w")
    made = rows.groupBy("book_id", "chunk_id").agg(win, F.array_sort(F.collect_list("span_id")).alias("all"))
    return made.select("book_id", "chunk_id", "w.*", F.array_remove("all", F.col("w.span_id")).alias("related"))


def funnel_edges(found: DataFrame, verdicts: DataFrame, shown: int = 12) -> DataFrame:
    """Edges out of ranked candidates (query_id, id, cosine, rank) and four-letter verdicts (query_id, verdict): the letter
    picks among the first ``shown``; rejections, weak letters and weak products go."""
    v = verdicts.withColumn("v", S.decode_pick(F.col("verdict"))).filter(F.col("v").isNotNull() & ~F.col("v.rejected"))
    picked = v.select("query_id", F.col("v.index").alias("rank"), "v.relation", "v.confidence", "v.relevance").filter(F.col("rank") <= shown)
    return found.join(picked, ["query_id", "rank"]).filter(S.passes_floor(F.col("confidence"), F.col("relevance")))


def ranked_by_verdict(found: DataFrame, verdicts: DataFrame, shown: int = 26) -> DataFrame:
    """The candidates (query_id, id, rank) that a ranking verdict (query_id, verdict: pairs of letters, one for the candidate
    and one for the confidence) names among the first ``shown``, with their place in it: (query_id, id, place, confidence)."""
    named = verdicts.select("query_id", F.posexplode(S.decode_ranking(F.col("verdict"))).alias("k", "x"))
    named = named.select("query_id", F.col("x.index").alias("rank"), (F.col("k") + 1).alias("place"), "x.confidence").filter(F.col("rank") <= shown)
    return found.join(named, ["query_id", "rank"]).select("query_id", "id", "place", "confidence")


def classified(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pairs (query_id, id) with the relation, confidence and relevance that a verdict of three letters (query_id, verdict)
    gives them; the first of a verdict counts."""
    first = verdicts.select("query_id", F.get(S.decode_classification(F.col("verdict")), F.lit(0)).alias("x")).filter("x is not null")
    return pairs.join(first, "query_id").select("query_id", "id", "x.relation", "x.confidence", "x.relevance")


def page_tags(chunks: DataFrame, per_chunk: int = 6, most: int = 8) -> DataFrame:
    """The most frequent tags of each page (first ones of each chunk), as one line; ties in alphabetical order."""
    t = chunks.select("book_id", "page_number", F.explode(F.slice("tags", 1, per_chunk)).alias("tag")).groupBy("book_id", "page_number", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("book_id", "page_number").orderBy(F.desc("n"), "tag")
    top = t.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy("book_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ", ").alias("tags"))


def score_coverage(items: DataFrame, edges: DataFrame, target_window: int = 1, source_window: int = 5, strict: bool = False) -> DataFrame:
    """(item_id, status): COVERED, PARTIAL, WRONG_TARGET or MISSING by edges (source_page, target_page, relation) near an
    item's pages. items (item_id, target_pages, source_pages). Windows become equi-joins on the pages inside them."""
    near = lambda c, n: F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p - n, p + n))))
    i = items.withColumn("t", near("target_pages", target_window)).withColumn("s", near("source_pages", source_window))
    pages = edges.groupBy("source_page", "target_page").agg(F.max((F.col("relation") != "annotates").cast("int")).alias("typed"))
    by_target = i.select("item_id", "s", F.explode("t").alias("target_page")).join(pages, "target_page").withColumn("from_source", F.array_contains("s", F.col("source_page")))
    ok = F.col("from_source") & ((F.col("typed") == 1) | F.lit(not strict))
    on = by_target.groupBy("item_id").agg(F.max(ok.cast("int")).alias("covered"))
    sources = pages.select("source_page").distinct()
    seen = i.select("item_id", F.explode("s").alias("source_page")).join(sources, "source_page", "left_semi").select("item_id").distinct().withColumn("seen", F.lit(1))
    rows = i.join(on, "item_id", "left").join(seen, "item_id", "left")
    status = (
        F.when(F.size("target_pages") == 0, F.when(F.col("seen") == 1, "COVERED").otherwise("MISSING"))
        .when(F.col("covered").isNull(), F.when(F.col("seen") == 1, "WRONG_TARGET").otherwise("MISSING"))
        .when(F.col("covered") == 1, "COVERED")
        .otherwise("PARTIAL")
    )
    return rows.select("item_id", status.alias("status"))
