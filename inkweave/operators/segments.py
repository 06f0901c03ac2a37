"""Spans into chunks and chunk order: the fold, links, contents, roll-ups, and the span language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions.text import starts_with_anaphor, strip
from inkweave.operators.prefix import running

BOUNDARIES = ["theorem", "definition", "lemma", "proposition", "corollary", "proof", "example", "remark"]
ROLES = ["claim", "background", "conjecture", "result", "review", "definition", "equation", "application", "citation", "preview", "proof", "remark", "example", "figure_ref"]


def tag_type(tag: Column) -> Column:
    """The structural type that a tag names, or null."""
    return (
        F.when((tag == "theorem") | tag.endswith("_theorem") | (tag == "lemma"), "theorem")
        .when((tag == "definition") | tag.endswith("_definition"), "definition")
        .when(tag == "proof", "proof")
        .when((tag == "example") | tag.endswith("_example"), "example")
        .when(tag == "remark", "remark")
        .when(tag == "notation", "notation")
        .when((tag == "equation") | tag.endswith("_equation"), "equation")
    )


def tags_type(tags: Column) -> Column:
    """The first structural type among tags in order, or null."""
    return F.get(F.array_compact(F.transform(tags, tag_type)), F.lit(0))


def note_type(notes: Column, start: Column, end: Column) -> Column:
    """Kind of the first page annotation (struct<kind,start>) of a structural kind inside sentences start to end."""
    return F.get(F.filter(notes, lambda a: a["start"].between(start, end) & a["kind"].isin(BOUNDARIES)), F.lit(0))["kind"]


def fold_chunks(spans: DataFrame, cap: int = 8, gap: int = 3) -> DataFrame:
    """Chunk numbers of spans: (book_id, page_number, span_id, chunk_index from 0 on each page).

    spans has book_id, page_number, span_id, start, end, tags, span_text, declarative (boolean) and notes, the page's
    annotations. Rules in order: a span that overlaps the one before or starts with a reference back stays; one at a
    structural annotation starts a chunk, unless it is the proof of the theorem or definition before it; then a gap of more
    than ``gap`` sentences, a chunk of ``cap`` spans, or a declarative tag start one. A page change always does, so a page
    is folded by itself and no task needs more than a page's spans.
    """
    one = F.struct("start", "end", "span_id", starts_with_anaphor(F.col("span_text")).alias("back"), "declarative", tags_type(F.col("tags")).alias("kind"))
    page = spans.groupBy("book_id", "page_number").agg(F.array_sort(F.collect_list(one)).alias("s"), F.first("notes").alias("notes"))
    begin = F.expr("named_struct('index', -1, 'size', 0, 'first', 0, 'last', 0, 'kind', cast(null as string), 'out', cast(array() as array<struct<span_id:bigint,chunk_index:int>>))")

    def step(a, x):
        here = F.get(F.filter(F.col("notes"), lambda n: (n["start"] == x["start"]) & n["kind"].isin(BOUNDARIES)), F.lit(0))["kind"]
        current = F.coalesce(a["kind"], note_type(F.col("notes"), a["first"], a["last"]), F.lit("narrative"))
        structural = here.isNotNull()
        breaks = (
            F.when(a["index"] < 0, True)
            .when(x["start"] <= a["last"], False)
            .when(x["back"], False)
            .when(structural, ~((here == "proof") & current.isin("theorem", "definition")))
            .otherwise((x["start"] - a["last"] > gap) | (a["size"] >= cap) | x["declarative"])
        )
        index = F.when(breaks, a["index"] + 1).otherwise(a["index"])
        return F.struct(
            index.alias("index"),
            F.when(breaks, F.lit(1)).otherwise(a["size"] + 1).alias("size"),
            F.when(breaks, x["start"]).otherwise(a["first"]).alias("first"),
            x["end"].alias("last"),
            F.when(breaks, x["kind"]).otherwise(F.coalesce(a["kind"], x["kind"])).alias("kind"),
            F.array_append(a["out"], F.struct(x["span_id"].alias("span_id"), index.alias("chunk_index"))).alias("out"),
        )

    return page.select("book_id", "page_number", F.explode(F.aggregate("s", begin, step, lambda a: a["out"])).alias("x")).select("book_id", "page_number", "x.*")


def build_chunks(spans: DataFrame, numbered: DataFrame) -> DataFrame:
    """Chunks of numbered spans: range, tags and classes in first-seen order, unresolved flag, type, text, words."""
    keys = ["book_id", "page_number", "chunk_index"]
    rows = spans.join(numbered, ["book_id", "page_number", "span_id"])
    parts = F.array_sort(F.collect_list(F.struct("start", "end", "span_id", "tags", "search_class", "span_text")))
    made = rows.groupBy(*keys).agg(parts.alias("s"), F.first("notes").alias("notes"))
    start, end = F.col("s")[0]["start"], F.element_at("s", -1)["end"]
    tags = F.flatten(F.transform("s", lambda x: x["tags"]))
    text = F.array_join(F.transform("s", lambda x: x["span_text"]), " ")
    return made.select(
        *keys,
        start.alias("start"),
        end.alias("end"),
        F.transform("s", lambda x: x["span_id"]).alias("span_ids"),
        F.array_distinct(tags).alias("tags"),
        F.filter(F.array_distinct(F.transform("s", lambda x: x["search_class"])), lambda c: c != "N").alias("classes"),
        F.exists("s", lambda x: x["search_class"] != "N").alias("unresolved"),
        F.coalesce(tags_type(tags), note_type(F.col("notes"), start, end), F.lit("narrative")).alias("structural_type"),
        text.alias("text"),
        F.when(strip(text) == "", 0).otherwise(F.size(F.split(strip(text), r"\s+"))).alias("words"),
    )


def link_neighbours(chunks: DataFrame, by: str = "page_number", order: str = "chunk_index") -> DataFrame:
    """chunks with the ids of the chunks before and after on the same page."""
    w = Window.partitionBy("book_id", by).orderBy(order)
    return chunks.withColumn("prev_id", F.lag("chunk_id").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))


def neighbour_text(chunks: DataFrame, n: int = 2) -> DataFrame:
    """chunks with the ids of up to n chunks before and after on the page, in order."""
    w = Window.partitionBy("book_id", "page_number").orderBy("chunk_index")
    before, after = F.collect_list("chunk_id").over(w.rowsBetween(-n, -1)), F.collect_list("chunk_id").over(w.rowsBetween(1, n))
    return chunks.withColumn("before", before).withColumn("after", after)


def contents(pages: DataFrame) -> DataFrame:
    """Sections under the latest chapter of their group: (group_id, chapter, chapter_page, sections array of titles).

    pages (group_id, page_number, chapter, section). Sections before any chapter stand alone.
    """
    w = Window.partitionBy("group_id").orderBy("page_number")
    rows = pages.withColumn("chapter_page", F.last(F.when(F.col("chapter").isNotNull(), F.col("page_number")), True).over(w)).withColumn("under", F.last("chapter", True).over(w))
    listed = rows.filter(F.col("chapter").isNotNull() | F.col("section").isNotNull())
    alone = F.when(F.col("under").isNull(), F.col("page_number"))
    sections = F.array_sort(F.collect_list(F.when(F.col("under").isNotNull() & F.col("section").isNotNull(), F.struct("page_number", "section"))))
    made = listed.groupBy("group_id", F.coalesce("chapter_page", alone).alias("at")).agg(F.coalesce(F.first("under", True), F.first("section", True)).alias("title"), sections.alias("s"))
    return made.select("group_id", F.col("at").alias("page_number"), "title", F.transform("s", lambda x: x["section"]).alias("sections"))


def rollup(pages: DataFrame, most_topics: int = 20, most_concepts: int = 30) -> DataFrame:
    """Per group: distinct topics and concepts in first-seen order, cut to a number, and the last known level."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "topics", "concepts", "level")))
    made = pages.groupBy("group_id").agg(ordered.alias("p"))
    distinct = lambda c, n: F.slice(F.array_distinct(F.flatten(F.transform("p", lambda x: x[c]))), 1, n)
    level = F.try_element_at(F.array_compact(F.transform("p", lambda x: x["level"])), F.lit(-1))
    return made.select("group_id", distinct("topics", most_topics).alias("topics"), distinct("concepts", most_concepts).alias("concepts"), level.alias("level"))


_CLASS = r"^[LISB][a-z]?$"
_DECLARATIVE = r"^[pacerqskxdv]\d+(\.\d+)?$"
_TAG = r"^[a-z][a-z0-9_]*$"


def parse_spans(lines: Column, lenient: bool = False) -> Column:
    """array<struct> of the span lines of a text: range, tags, role, declarative tags, search class, confidence, gap.

    The last role, class, confidence and gap of a line win. The lenient reading, for repairs, has no declarative tags and
    skips a line that starts with CONFIDENCE.
    """
    rows = F.transform(F.split(F.coalesce(lines, F.lit("")), "\n"), strip)
    skipped = F.lit(lenient)
    rows = F.filter(rows, lambda r: (r != "") & ~r.startswith("#") & ~r.startswith("//") & ~(skipped & r.startswith("CONFIDENCE")))
    cut = F.filter(F.transform(rows, lambda r: F.split(r, r"\s+")), lambda p: (F.size(p) >= 2) & F.regexp_like(p[0], F.lit(r"^\d+")))

    def span(parts):
        rest = F.slice(parts, F.lit(2), F.size(parts))
        is_class = lambda t: F.regexp_like(t, F.lit(_CLASS))
        is_declarative = lambda t: F.regexp_like(t, F.lit(_DECLARATIVE))
        is_role = lambda t: t.isin(ROLES)
        tags = F.filter(rest, lambda t: F.regexp_like(t, F.lit(_TAG)) & ~is_class(t) & ~is_declarative(t) & ~is_role(t))
        classes = F.filter(rest, is_class)
        last = F.try_element_at(classes, F.lit(-1))
        suffix = F.substring(last, 2, 1)
        gap = lambda t: F.when(t == "Ld", "definition").when(t == "Lv", "derivation").when(t == "Lp", "proof")
        confidence = F.when((F.size(classes) > 0) & (suffix != "") & ~last.startswith("S") & gap(last).isNull(), suffix)
        declared = F.transform(
            F.filter(rest, is_declarative),
            lambda t: F.struct(
                F.substring(t, 1, 1).alias("kind"),
                F.regexp_extract(t, r"^.(\d+)", 1).cast("int").alias("chunk"),
                F.coalesce(F.nullif(F.regexp_extract(t, r"[.](\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("tag"),
            ),
        )
        bounds = F.split(parts[0], "-")
        return F.struct(
            F.regexp_extract(bounds[0], r"^(\d+)", 1).cast("int").alias("start"),
            F.regexp_extract(F.element_at(bounds, -1), r"^(\d+)", 1).cast("int").alias("end"),
            tags.alias("tags"),
            F.try_element_at(F.filter(rest, is_role), F.lit(-1)).alias("role"),
            (F.slice(declared, 1, 0) if lenient else declared).alias("declared"),
            F.coalesce(F.substring(last, 1, 1), F.lit("N")).alias("search_class"),
            confidence.alias("confidence"),
            F.try_element_at(F.array_compact(F.transform(classes, gap)), F.lit(-1)).alias("gap"),
        )

    return F.transform(cut, span)


def render_span(s: Column) -> Column:
    """The line of a span struct; parse_spans reads it back."""
    bounds = F.when(s["start"] == s["end"], s["start"].cast("string")).otherwise(F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    declared = F.array_join(F.transform(s["declared"], lambda d: F.concat(d["kind"], d["chunk"].cast("string"), F.lit("."), d["tag"].cast("string"))), " ")
    gap = F.when(s["gap"] == "definition", "Ld").when(s["gap"] == "derivation", "Lv").when(s["gap"] == "proof", "Lp")
    other = F.concat(s["search_class"], F.coalesce(s["confidence"], F.lit("?")))
    code = F.when(s["search_class"] == "N", "").when(s["search_class"] == "S", "S").when(s["search_class"] == "L", F.coalesce(gap, other)).otherwise(other)
    return F.array_join(F.filter(F.array(bounds, F.array_join(s["tags"], " "), F.coalesce(s["role"], F.lit("")), declared, code), lambda x: x != ""), " ")


def enriched(tags: Column, role: Column, declared: Column, search_class: Column) -> Column:
    """Whether a span carries more than its range."""
    return (F.size(tags) > 0) | role.isNotNull() | (F.size(declared) > 0) | (search_class != "N")


def sessions(pages: DataFrame, size: int = 8) -> DataFrame:
    """pages with the number of their session: a new one every ``size`` pages of a book."""
    placed = running(pages, "book_id", ["page_number"], {"session": F.lit(1)})
    return placed.withColumn("session", F.floor(F.col("session") / size).cast("int"))


def kept_pass(passes: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, pass, ratio): which of a page's tries stays. passes (page, pass, n_spans, ratio): the second one stands in for
    an empty first one; the third for a first one whose enriched share is below ``least``, if its own is higher."""
    try_ = lambda k, c: F.max(F.when(F.col("pass") == k, F.col(c)))
    one = passes.groupBy("page").agg(try_(1, "n_spans").alias("n"), *[try_(k, "ratio").alias(f"r{k}") for k in (1, 2, 3)])
    kept = F.when((F.col("n") == 0) & F.col("r2").isNotNull(), 2).when((F.col("n") > 0) & (F.col("r1") < least) & F.coalesce(F.col("r3") > F.col("r1"), F.lit(False)), 3).otherwise(1)
    return one.select("page", kept.alias("pass"), F.when(kept == 2, F.col("r2")).when(kept == 3, F.col("r3")).otherwise(F.col("r1")).alias("ratio"))
