"""Statistics, samples, quality detectors, repairs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.operators.prefix import running


def summary(value: Column) -> list[Column]:
    """Aggregates of a distribution: mean, median, population deviation, least, most, count."""
    return [F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n")]


def hashed_order(key: Column, seed: int) -> Column:
    """A fixed random order that other engines can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def random_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(hashed_order(F.col(key), seed), key).limit(n)


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """A proportional sample with at least one row of each stratum, cut or filled to the total in the fixed order.

    Ranks inside strata come from a window that keeps no more than total rows of each; sizes are summed up by stratum.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_all", F.sum("_size").over(Window.partitionBy()))  # one row a stratum
    want = F.greatest(F.lit(1), F.floor(F.col("_size") * total / F.col("_all") + 0.5))
    w = Window.partitionBy(stratum).orderBy(hashed_order(F.col(key), seed), key)
    ranked = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= total).join(sizes, stratum)
    chosen = ranked.withColumn("_picked", F.when(F.col("_rank") <= want, 0).otherwise(1))
    return chosen.orderBy("_picked", hashed_order(F.col(key), seed), key).limit(total).drop("_rank", "_size", "_all", "_picked")


def dense_single(chunks: DataFrame, per_chunk: DataFrame, tags: int = 3, words: int = 25) -> DataFrame:
    """Chunks of one span that holds too much. per_chunk (chunk_id, n_spans, n_tags, span_text)."""
    j = chunks.join(per_chunk, "chunk_id")
    return j.filter((F.col("n_spans") == 1) & ((F.col("n_tags") >= tags) | (F.col("words") >= words)) & ~F.contains("span_text", F.lit(":=")))


def orphans(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks that begin with a reference back, aren't structural, and that no edge reaches."""
    c = chunks.filter(T.starts_with_anaphor(F.col("text")) & ~F.col("structural_type").isin("theorem", "definition", "proof"))
    return c.join(edges.select(F.col("to_chunk").alias("chunk_id")), "chunk_id", "left_anti")


def isolated(chunks: DataFrame, edges: DataFrame, words: int = 10) -> DataFrame:
    """Chunks without tags (or only 'narrative') and without edges, of some length."""
    bare = (F.size("tags") == 0) | ((F.size("tags") == 1) & (F.col("tags")[0] == "narrative"))
    ends = edges.select(F.explode(F.array("from_chunk", "to_chunk")).alias("chunk_id"))
    return chunks.filter(bare & (F.col("words") >= words)).join(ends, "chunk_id", "left_anti")


def triage(decision: Column, confidence: Column, merge: float = 0.85, review: float = 0.60) -> Column:
    return F.when(decision != "MERGE", "keep").when(confidence >= merge, "merge").when(confidence >= review, "review").otherwise("uncertain")


def apply_merges(chunks: DataFrame, merges: DataFrame) -> DataFrame:
    """Chunks after merges (chunk_id, into): the text and range of a merged chunk go to its target; it stays, marked.

    Targets of merges aren't merged themselves.
    """
    moved = chunks.join(merges, "chunk_id").select(F.col("into").alias("chunk_id"), F.struct("start", "end", "text").alias("m"))
    more = moved.groupBy("chunk_id").agg(F.array_sort(F.collect_list("m")).alias("more"))
    j = chunks.join(more, "chunk_id", "left").join(merges, "chunk_id", "left")
    grown = F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat_ws(" ", F.col("text"), F.array_join(F.transform("more", lambda x: x["text"]), " ")))
    end = F.greatest("end", F.coalesce(F.array_max(F.transform("more", lambda x: x["end"])), F.col("end")))
    return j.withColumn("text", grown).withColumn("end", end).withColumn("status", F.when(F.col("into").isNotNull(), "merged").when(F.col("more").isNotNull(), "grown")).drop("more")


#: The six axes of a verdict.
AXES = ["faithfulness", "coverage", "granularity", "tags", "relations", "clarity"]


def verdict_problem(axes: dict[str, Column], total: Column, grade: Column) -> Column:
    """Why a verdict isn't valid, or null."""
    problem = F.lit(None).cast("string")
    for grade_, most, label in [(grade, 9, "grade"), (total, 18, "total")]:
        problem = F.when(grade_.isNull() | ~grade_.between(0, most), f"{label} out of range").otherwise(problem)
    for name, value in reversed(axes.items()):
        problem = F.when(value.isNull() | ~value.between(0, 3), f"axis {name} out of range or missing").otherwise(problem)
    return problem


def within_running_budget(rows: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order until the budget is used up: the first that doesn't fit ends the list. The order tells rows apart, sizes
    aren't negative, and no task holds a whole group."""
    found = running(rows, by, order, {"used": F.col(size)}, ("used", lambda used: used <= budget))
    return found.withColumn("used", F.col("used") + F.col(size)).filter(F.col("used") <= budget)


def within_greedy_budget(groups: DataFrame, sections: str, budget: int, reserved: str | None = None) -> DataFrame:
    """Sections (array of struct<priority,id,size>) of each group that a greedy choice takes in order of priority: one that
    doesn't fit is passed over, smaller ones after it may still fit. (..., taken array of ids, used). The column named in
    reserved is used up beforehand."""
    spent = F.col(reserved).cast("long") if reserved else F.lit(0).cast("long")
    begin = F.struct(spent.alias("used"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def step(a, x):
        fits = a["used"] + x["size"] <= budget
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["taken"], x["id"])).otherwise(a["taken"]).alias("taken"))

    return groups.withColumn("_b", F.aggregate(F.array_sort(sections), begin, step)).withColumn("used", F.col("_b.used")).withColumn("taken", F.col("_b.taken")).drop("_b", sections)


def recent_turns(turns: DataFrame, most_text: int = 20) -> DataFrame:
    """The last text turns of each conversation with the tool turns among them; a leading run of tool turns goes.

    turns (conv_id, turn, kind).
    """
    text = (F.col("kind") != "tool").cast("int")
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = turns.withColumn("_seen", F.sum(text).over(back)).filter((F.col("_seen") <= most_text))
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.col("_all") > most_text
    all_ = turns.groupBy("conv_id").agg(F.sum(text).alias("_all"))
    kept = kept.withColumn("_begun", F.sum(text).over(ahead)).join(all_, "conv_id")
    first_is_tool = F.first(F.col("kind") == "tool").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = kept.withColumn("_lead", cut & first_is_tool)
    return kept.filter((F.col("_begun") > 0) | ~F.col("_lead")).drop("_seen", "_begun", "_all", "_lead")


def quote_place(container: Column, quote: Column) -> Column:
    """struct<pass,words>: how a quote is found in a text: by the longest of its beginnings (all words, 40, 30, 20, 15, 10, 6,
    4, 3) that occurs (pass 1), else by its letters and digits alone, 20 to 6 of them (pass 2), else pass 0."""
    c, q = T.quote_form(container), T.quote_form(quote)
    bare = lambda x: F.regexp_replace(x, "[^a-z0-9]+", "")
    found = lambda way, words: F.struct(F.lit(way).alias("pass"), words.alias("words"))

    def by_letters(b):
        probe = F.get(F.filter(F.array(*[F.lit(n) for n in range(20, 4, -2)]), lambda n: F.contains(b["c"], F.substring(b["q"], F.lit(1), n))), F.lit(0))
        return T.once(F.when(F.length(b["q"]) >= 8, probe), lambda p: F.when(p.isNotNull(), found(2, p)).otherwise(found(0, F.lit(0))))

    def by_words(v):
        sizes = F.filter(F.array_distinct(F.concat(F.array(F.size(v["words"])), F.array(*[F.lit(n) for n in (40, 30, 20, 15, 10, 6, 4, 3)]))), lambda n: (n >= 2) & (n <= F.size(v["words"])))
        hit = F.get(F.filter(sizes, lambda n: F.contains(v["c"], F.array_join(F.slice(v["words"], F.lit(1), n), " "))), F.lit(0))
        letters = F.struct(bare(v["c"]).alias("c"), bare(v["q"]).alias("q"))
        return T.once(hit, lambda h: F.when(h.isNotNull(), found(1, h)).otherwise(T.once(letters, by_letters)))

    return T.once(F.struct(c.alias("c"), q.alias("q"), F.filter(F.split(q, " "), lambda w: w != "").alias("words")), by_words)


CITE = r'\[\[cite\s+bookId="([^"]+)"\s+page="([^"]+)"\]\]((?:[^\[]++|\[(?!\[/cite\]\]))*+)\[\[/cite\]\]'


def cited(text: Column) -> Column:
    """array<struct<book,page,quote>> of the citation tags in a text."""
    parts = [F.regexp_extract_all(text, F.lit(CITE), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("b", "p", "t"), strict=True)]), lambda z: F.struct(z["b"].alias("book"), z["p"].alias("page"), T.strip(z["t"]).alias("quote")))


def overlapping(highlights: DataFrame, spans: DataFrame, width: int = 500) -> DataFrame:
    """highlights (page_id, highlight_id, start, end) with the spans (page_id, span_id, start, end) that they overlap.

    A range join by cells of ``width`` characters: both sides go to the cells they touch, meet there by equality, and a
    pair counts in the first cell that it shares.
    """
    cells = lambda s, e: F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))
    h = highlights.select("page_id", "highlight_id", F.col("start").alias("hs"), F.col("end").alias("he")).withColumn("cell", F.explode(cells("hs", "he")))
    s = spans.select("page_id", "span_id", F.col("start").alias("ss"), F.col("end").alias("se")).withColumn("cell", F.explode(cells("ss", "se")))
    j = h.join(s, ["page_id", "cell"]).filter((F.col("se") > F.col("hs")) & (F.col("ss") < F.col("he")))
    return j.filter(F.col("cell") == F.greatest(F.floor(F.col("hs") / width), F.floor(F.col("ss") / width))).select("page_id", "highlight_id", "span_id")
