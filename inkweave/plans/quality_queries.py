"""Queries over statistics, quality, budgets, quotes, conversations, ingestion and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.operators import ingest, quality as Q
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK_CHUNKS, DUCK_EDGES, DUCK_SPANS, chunks, documents, duck_pick, duck_sentences, edges, pick, q, read, spans
from inkweave.streaming import progress

_SUMMARY = "round(avg({0}), 6) AS mean, round(quantile_cont({0}::double, 0.5), 6) AS median, round(stddev_pop({0}), 6) AS stddev, min({0}) AS least, max({0}) AS most, count({0}) AS n"


def _rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query("distribution_summary", "K4", f"SELECT source, {_SUMMARY.format('n_chars')} FROM documents GROUP BY 1")
def distribution_summary(spark, sf):
    return _rounded(documents(spark, sf).groupBy("source").agg(*Q.summary(F.col("n_chars"))), "mean", "median", "stddev")


@query("book_stats", "K5", f"""WITH c AS (SELECT page_number, count(*) AS n FROM {DUCK_CHUNKS} GROUP BY 1), p AS (SELECT source, doc_id, strlen(text) AS b, coalesce(n, 0) AS n FROM documents LEFT JOIN c ON page_number = doc_id)
SELECT source, {_SUMMARY.format("p.n")}, sum(b)::bigint AS bytes, round(count(*) * 0.012, 6) AS cost FROM p GROUP BY 1""")
def book_stats(spark, sf):
    per = chunks(spark, sf).groupBy(F.col("page_number").alias("doc_id")).agg(F.count("*").alias("k"))
    p = documents(spark, sf).select("source", "doc_id", F.octet_length("text").alias("b")).join(per, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    made = p.groupBy("source").agg(*Q.summary(F.col("k")), F.sum("b").alias("bytes"), (F.count("*") * 0.012).alias("cost"))
    return _rounded(made, "mean", "median", "stddev", "cost")


_SCORED = "(SELECT doc_id, quality * 5 + doc_id % 5 AS grade, [doc_id % 4, doc_id // 3 % 4, doc_id // 5 % 4, doc_id // 7 % 4, doc_id // 11 % 4, doc_id // 13 % 5] AS axes FROM labels)"


def _scored(spark, sf):
    n = F.col("doc_id")
    axes = [n % 4, *[F.floor(n / d) % 4 for d in (3, 5, 7, 11)], F.floor(n / 13) % 5]
    return read(spark, sf, "labels").select("doc_id", (F.col("quality") * 5 + n % 5).alias("grade"), *[a.alias(name) for a, name in zip(axes, Q.AXES, strict=True)])


@query("score_summary", "K6 K7", f"SELECT round(avg(grade), 6) AS mean, round(quantile_cont(grade::double, 0.1), 6) AS p10, round(quantile_cont(grade::double, 0.5), 6) AS p50, round(quantile_cont(grade::double, 0.9), 6) AS p90, count(*) FILTER (grade < 5) AS below, round(avg(axes[2]), 6) AS coverage FROM {_SCORED}")
def score_summary(spark, sf):
    p = lambda x: F.round(F.percentile("grade", x), 6)
    return _scored(spark, sf).agg(F.round(F.avg("grade"), 6).alias("mean"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.sum((F.col("grade") < 5).cast("int")).alias("below"), F.round(F.avg("coverage"), 6).alias("coverage"))


@query("verdict_validate", "K8", f"""SELECT doc_id, CASE WHEN axes[6] > 3 THEN 'axis clarity out of range or missing' WHEN total > 18 THEN 'total out of range' WHEN grade > 9 THEN 'grade out of range' END AS problem, total <> list_sum(axes) AS mismatch
 FROM (SELECT *, list_sum(axes) + CASE WHEN doc_id % 8 = 0 THEN 10 ELSE 0 END AS total FROM {_SCORED})""")
def verdict_validate(spark, sf):
    rows = _scored(spark, sf)
    total = sum((F.col(a) for a in Q.AXES), F.lit(0))
    rows = rows.withColumn("total", total + F.when(F.col("doc_id") % 8 == 0, 10).otherwise(0))
    return rows.select("doc_id", Q.verdict_problem({a: F.col(a) for a in Q.AXES}, F.col("total"), F.col("grade")).alias("problem"), (F.col("total") != total).alias("mismatch"))


@query("random_sample", "K9", "SELECT doc_id FROM documents ORDER BY md5(doc_id::varchar || ':7'), doc_id LIMIT 50")
def random_sample(spark, sf):
    return Q.random_sample(documents(spark, sf).select("doc_id"), "doc_id", 50, 7)


@query("stratified_sample", "K12", f"""WITH e AS (SELECT edge_id, relation || '|' || CASE WHEN confidence >= 's' THEN 'high' WHEN confidence >= 'j' THEN 'mid' ELSE 'low' END AS s FROM {DUCK_EDGES}),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(edge_id::varchar || ':3'), edge_id) AS k, count(*) OVER (PARTITION BY s) AS size, count(*) OVER () AS all_ FROM e)
SELECT edge_id, s AS stratum FROM r WHERE k <= 100 ORDER BY CASE WHEN k <= greatest(1, floor(size * 100 / all_::double + 0.5)) THEN 0 ELSE 1 END, md5(edge_id::varchar || ':3'), edge_id LIMIT 100""")
def stratified_sample(spark, sf):
    from inkweave.functions.scales import tier

    e = edges(spark, sf).select("edge_id", F.concat_ws("|", "relation", tier(F.col("confidence"))).alias("stratum"))
    return Q.stratified_sample(e, "stratum", "edge_id", 100, 3).select("edge_id", "stratum")


@query("skip_existing", "K10", f"SELECT chunk_id FROM {DUCK_CHUNKS} WHERE page_number NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf):
    return chunks(spark, sf).join(read(spark, sf, "labels").select(F.col("doc_id").alias("page_number")), "page_number", "left_anti").select("chunk_id")


@query("audit_metrics", "K13", f"SELECT relation, count(*) AS n, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'wrong') AS wrong, round(count(*) FILTER (v = 'correct') / count(*)::double, 6) AS \"precision\" FROM (SELECT relation, {duck_pick(['correct', 'borderline', 'wrong'], 'edge_id * 7')} AS v FROM {DUCK_EDGES}) GROUP BY 1")
def audit_metrics(spark, sf):
    e = edges(spark, sf).withColumn("v", pick(["correct", "borderline", "wrong"], F.col("edge_id") * 7))
    is_ = lambda v: F.sum((F.col("v") == v).cast("int"))
    return e.groupBy("relation").agg(F.count("*").alias("n"), is_("correct").alias("correct"), is_("wrong").alias("wrong"), F.round(is_("correct") / F.count("*"), 6).alias("precision"))


@query("note_counts", "K1", "SELECT d.source, coalesce(n, 0) AS n, last FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN (SELECT source, count(*) AS n, max(doc_id) AS last FROM documents WHERE n_chars > 1000 AND lang = 'en' GROUP BY 1) USING (source)")
def note_counts(spark, sf):
    docs = documents(spark, sf)
    per = docs.filter("n_chars > 1000 and lang = 'en'").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    return docs.select("source").distinct().join(per, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), "last")


@query("sidebar_topk", "K24", "SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 100 = 7 THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def sidebar_topk(spark, sf):
    w = Window.partitionBy("source").orderBy(F.when(F.col("doc_id") % 100 == 7, 0).otherwise(1), F.desc("n_chars"), "doc_id")
    return documents(spark, sf).select("source", "doc_id", F.row_number().over(w).alias("rank")).filter("rank <= 5")


@query("cost_accounting", "K23", "SELECT day, cost, spent FROM (SELECT day, cost, round(sum(cost) OVER (ORDER BY day), 4) AS spent FROM (SELECT date_trunc('day', ts) AS day, round(sum(value * 3 + 15 * (event_id % 100)) / 1e6, 4) AS cost FROM events GROUP BY 1)) WHERE spent <= 5")
def cost_accounting(spark, sf):
    """Cost a day at prices per million, for as long as a ceiling isn't passed."""
    per = read(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.sum(F.col("value") * 3 + (F.col("event_id") % 100) * 15) / 1e6, 4).alias("cost"))
    spent = F.round(F.sum("cost").over(Window.orderBy("day")), 4)  # one row a day
    return per.withColumn("spent", spent).filter("spent <= 5").select(F.col("day").cast("timestamp_ntz").alias("day"), "cost", "spent")


_DENSE = f"(SELECT *, CASE WHEN page_number % 6 = 2 THEN 'This ' || text ELSE text END AS t FROM {DUCK_CHUNKS})"


@query("detect_dense", "K15", f"SELECT chunk_id FROM {DUCK_CHUNKS} c JOIN (SELECT page_number * 1000 + (sentence - 1) // 8 AS chunk_id, count(*) AS n, any_value(len(tags)) AS k, any_value(span_text) AS t FROM {DUCK_SPANS} GROUP BY 1) s USING (chunk_id) WHERE n = 1 AND (k >= 3 OR words >= 25) AND NOT contains(s.t, ':=')")
def detect_dense(spark, sf):
    s = spans(spark, sf).withColumn("chunk_id", F.col("page_number") * 1000 + F.floor((F.col("sentence") - 1) / 8))
    per = s.groupBy("chunk_id").agg(F.count("*").alias("n_spans"), F.first(F.size("tags")).alias("n_tags"), F.first("span_text").alias("span_text"))
    return Q.dense_single(chunks(spark, sf), per).select("chunk_id")


@query("detect_orphan", "K16", f"SELECT chunk_id FROM {_DENSE} WHERE list_contains([{', '.join(q(a) for a in T.ANAPHORS)}], lower(regexp_extract(t, '^\\p{{L}}+'))) AND structural_type NOT IN ('theorem', 'definition', 'proof') AND chunk_id NOT IN (SELECT to_chunk FROM {DUCK_EDGES})")
def detect_orphan(spark, sf):
    c = chunks(spark, sf).withColumn("text", F.when(F.col("page_number") % 6 == 2, F.concat(F.lit("This "), "text")).otherwise(F.col("text")))
    return Q.orphans(c, edges(spark, sf)).select("chunk_id")


@query("detect_isolated", "K17", f"SELECT chunk_id FROM (SELECT *, CASE WHEN page_number % 3 = 0 THEN ['narrative'] ELSE tags END AS g FROM {DUCK_CHUNKS}) WHERE len(g) = 1 AND g[1] = 'narrative' AND words >= 10 AND chunk_id NOT IN (SELECT to_chunk FROM {DUCK_EDGES} WHERE relation = 'extends') AND chunk_id NOT IN (SELECT from_chunk FROM {DUCK_EDGES} WHERE relation = 'extends')")
def detect_isolated(spark, sf):
    c = chunks(spark, sf).withColumn("tags", F.when(F.col("page_number") % 3 == 0, F.array(F.lit("narrative"))).otherwise(F.col("tags")))
    return Q.isolated(c, edges(spark, sf).filter("relation = 'extends'")).select("chunk_id")


@query("review_triage", "K21", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'keep' WHEN c >= 0.85 THEN 'merge' WHEN c >= 0.6 THEN 'review' ELSE 'uncertain' END AS outcome FROM (SELECT doc_id, (doc_id % 41) / 40.0 AS c FROM documents)")
def review_triage(spark, sf):
    n = F.col("doc_id")
    return documents(spark, sf).select("doc_id", Q.triage(F.when(n % 3 == 0, "KEEP").otherwise("MERGE"), (n % 41) / 40.0).alias("outcome"))


@query("repair_merge", "K20", f"""WITH c AS MATERIALIZED (SELECT * FROM {DUCK_CHUNKS}), m AS (SELECT chunk_id, chunk_id - 1 AS into_ FROM c WHERE chunk_index % 3 = 1)
SELECT c.chunk_id, greatest(c."end", coalesce(n."end", 0)) AS "end", md5(CASE WHEN n.chunk_id IS NULL THEN c.text ELSE c.text || ' ' || n.text END) AS text_md5, CASE WHEN c.chunk_index % 3 = 1 THEN 'merged' WHEN n.chunk_id IS NOT NULL THEN 'grown' END AS status FROM c LEFT JOIN m ON m.into_ = c.chunk_id LEFT JOIN c n ON n.chunk_id = m.chunk_id""")
def repair_merge(spark, sf):
    c = chunks(spark, sf)
    merges = c.filter("chunk_index % 3 = 1").select("chunk_id", (F.col("chunk_id") - 1).alias("into"))
    return Q.apply_merges(c, merges).select("chunk_id", "end", F.md5("text").alias("text_md5"), "status")


# ── budgets, conversations, quotes ──


@query("budget_running", "I8", f"SELECT from_book, edge_id, used::bigint AS used FROM (SELECT from_book, edge_id, sum(length(relation) * 10 + edge_id % 50) OVER (PARTITION BY from_book ORDER BY edge_id) AS used FROM {DUCK_EDGES}) WHERE used <= 5000")
def budget_running(spark, sf):
    e = edges(spark, sf).withColumn("size", F.length("relation") * 10 + F.col("edge_id") % 50)
    return Q.within_running_budget(e, "from_book", ["edge_id"], "size", 5000).select("from_book", "edge_id", "used")


@query("budget_greedy", "I10", """WITH RECURSIVE s AS (SELECT doc_id // 10 AS g, doc_id AS id, n_chars // 4 AS size, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id % 3, doc_id) AS k FROM documents),
w AS (SELECT g, 0::bigint AS k, 0::bigint AS used, ''::varchar AS taken FROM (SELECT DISTINCT g FROM s) UNION ALL SELECT s.g, s.k, CASE WHEN used + size <= 3000 THEN used + size ELSE used END, CASE WHEN used + size <= 3000 THEN taken || id || ',' ELSE taken END FROM w JOIN s ON s.g = w.g AND s.k = w.k + 1)
SELECT g AS group_id, arg_max(used, k) AS used, arg_max(taken, k) AS taken FROM w GROUP BY 1""")
def budget_greedy(spark, sf):
    n = F.col("doc_id")
    section = F.struct((n % 3).alias("priority"), n.alias("id"), F.floor(F.col("n_chars") / 4).alias("size"))
    groups = documents(spark, sf).groupBy(F.floor(n / 10).alias("group_id")).agg(F.collect_list(section).alias("sections"))
    made = Q.within_greedy_budget(groups, "sections", 3000)
    return made.select("group_id", "used", F.array_join(F.transform("taken", lambda x: F.concat(x.cast("string"), F.lit(","))), "").alias("taken"))


_TURNS = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE 'text' END AS kind FROM conversations)"


@query("history_slice", "I17", f"""WITH t AS (SELECT *, sum((kind <> 'tool')::int) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS seen FROM {_TURNS}), k AS (SELECT * FROM t WHERE seen <= 3),
b AS (SELECT *, sum((kind <> 'tool')::int) OVER (PARTITION BY conv_id ORDER BY turn) AS begun FROM k), n AS (SELECT conv_id, sum((kind <> 'tool')::int) AS all_ FROM {_TURNS} GROUP BY 1) SELECT conv_id, turn, kind FROM b JOIN n USING (conv_id) WHERE begun > 0 OR all_ <= 3""")
def history_slice(spark, sf):
    turns = read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "tool").otherwise("text").alias("kind"))
    return Q.recent_turns(turns, 3).select("conv_id", "turn", "kind")


@query("quote_locate", "J1 J2", r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS c FROM documents), e AS (SELECT doc_id, c, string_split(c, ' ') AS w FROM d),
f AS (SELECT doc_id, c, CASE doc_id % 3 WHEN 0 THEN array_to_string(w[2:13], ' ') WHEN 1 THEN array_to_string(w[2:9], ' ') || ' zzz qqq zzz' ELSE 'qq' || replace(array_to_string(w[2:4], ''), '.', '') END AS quote FROM e),
g AS (SELECT *, list_filter(string_split(quote, ' '), lambda x: x <> '') AS qw, regexp_replace(c, '[^a-z0-9]', '', 'g') AS bc, regexp_replace(quote, '[^a-z0-9]', '', 'g') AS bq FROM f),
h AS (SELECT doc_id, list_filter(list_filter([len(qw), 40, 30, 20, 15, 10, 6, 4, 3], lambda n: n >= 2 AND n <= len(qw)), lambda n: contains(c, array_to_string(qw[1:n], ' ')))[1] AS hit, length(bq) AS lb, list_filter([20, 18, 16, 14, 12, 10, 8, 6], lambda n: contains(bc, bq[1:n]))[1] AS probe FROM g)
SELECT doc_id, CASE WHEN hit IS NOT NULL THEN 1 WHEN lb >= 8 AND probe IS NOT NULL THEN 2 ELSE 0 END AS pass, CASE WHEN hit IS NOT NULL THEN hit WHEN lb >= 8 AND probe IS NOT NULL THEN probe ELSE 0 END AS words FROM h""")
def quote_locate(spark, sf):
    n = F.col("doc_id")
    d = documents(spark, sf).select("doc_id", "text", F.split(T.quote_form(F.col("text")), " ").alias("w"))
    join = lambda k, s=" ": F.array_join(F.slice("w", 2, k), s)
    quote = F.when(n % 3 == 0, join(12)).when(n % 3 == 1, F.concat(join(8), F.lit(" zzz qqq zzz"))).otherwise(F.concat(F.lit("qq"), F.replace(join(3, ""), F.lit("."), F.lit(""))))
    return d.select("doc_id", Q.quote_place(F.col("text"), quote).alias("p")).select("doc_id", "p.pass", "p.words")


@query("citation_tags", "J6", """SELECT doc_id, b AS book, p::varchar AS page, md5(text) AS quote_md5, b IN (SELECT DISTINCT source FROM documents) AS known FROM (SELECT doc_id, text, unnest(['src' || (doc_id % 25), 'none']) AS b, unnest([doc_id, 7]) AS p FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents))""")
def citation_tags(spark, sf):
    n = F.col("doc_id").cast("string")
    t = F.concat(F.lit('see [[cite bookId="src'), (F.col("doc_id") % 25).cast("string"), F.lit('" page="'), n, F.lit('"]]'), "text", F.lit('[[/cite]] and [[cite bookId="none" page="7"]] '), "text", F.lit(" [[/cite]]"))
    docs = documents(spark, sf)
    tags = docs.select("doc_id", F.explode(Q.cited(t)).alias("c")).select("doc_id", "c.*")
    books = docs.select(F.col("source").alias("book")).distinct().withColumn("known", F.lit(True))
    tags = tags.select("doc_id", "book", "page", F.md5("quote").alias("quote_md5"))
    return tags.join(books, "book", "left").select("doc_id", "book", "page", "quote_md5", F.coalesce("known", F.lit(False)).alias("known"))


@query("citation_guard", "I15", """SELECT doc_id, kind, value FROM (SELECT doc_id, 'cite_tag' AS kind, 'b' || (doc_id % 9) AS value FROM documents WHERE doc_id % 9 >= 5 UNION ALL SELECT doc_id, 'possessive_author', ['Adams', 'Baker', 'Clark'][doc_id % 3 + 1] AS value FROM documents WHERE doc_id % 3 <> 1
 UNION ALL SELECT doc_id, 'author_chapter_ref', ['Dirac', 'Baker'][doc_id % 2 + 1] FROM documents WHERE doc_id % 2 = 0)""")
def citation_guard(spark, sf):
    """Cited books that don't exist, and authors that none of the books has, in injected claims."""
    n = F.col("doc_id")
    name = lambda names: pick(names, n)
    claim = F.concat(F.lit('[[cite bookId="b'), (n % 9).cast("string"), F.lit('" '), name(["Adams", "Baker", "Clark"]), F.lit("'s Theorem, "), name(["Dirac", "Baker"]), F.lit(" Ch. 4"))
    rows = documents(spark, sf).select("doc_id", claim.alias("t"))
    found = lambda kind, p: F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(found("cite_tag", r'\[\[cite bookId="([^"]+)"'), found("possessive_author", r"([A-Z][a-z]{2,})'s\s+[A-Z]"), found("author_chapter_ref", r"([A-Z][a-z]{2,})\s+(?:Ch\.|Chapter|§|Sec\.)\s*[\dIVXivx]"))
    claims = rows.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.*", F.when(F.col("x.kind") == "cite_tag", F.col("x.value")).otherwise(F.lower("x.value")).alias("name"))
    known = spark.createDataFrame([(f"b{k}",) for k in range(5)] + [("baker",)], "name string")
    return claims.join(known, "name", "left_anti").select("doc_id", "kind", "value")


_OFFSETS = f"""of AS (WITH RECURSIVE d AS (SELECT doc_id, text, {duck_sentences('text')} AS s FROM documents), w AS (SELECT doc_id, text, s, 1 AS k, position(s[1] IN text) - 1 AS a FROM d WHERE len(s) > 0
 UNION ALL SELECT doc_id, text, s, k + 1, a + length(s[k]) + position(s[k + 1] IN substring(text, (a + length(s[k]) + 1)::bigint)) - 1 FROM w WHERE k < len(s)) SELECT doc_id, k, a, a + length(s[k]) AS b FROM w)"""


def _placed(spark, sf):
    d = documents(spark, sf)
    at = d.select(F.col("doc_id").alias("page_id"), F.posexplode(T.sentence_offsets(F.col("text"))).alias("k", "x"))
    return at.select("page_id", (F.col("page_id") * 10_000 + F.col("k") + 1).alias("span_id"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


@query("highlight_span_overlap", "I18", f"WITH {_OFFSETS}, h AS (SELECT doc_id, j, (n_chars * j // 5)::bigint AS hs, least(n_chars, n_chars * j // 5 + 30 + doc_id % 90)::bigint AS he FROM documents, (SELECT unnest([0, 1, 3]) AS j)) SELECT doc_id AS page_id, j AS highlight_id, doc_id * 10000 + k AS span_id FROM h JOIN of USING (doc_id) WHERE b > hs AND a < he")
def highlight_span_overlap(spark, sf):
    h = documents(spark, sf).select(F.col("doc_id").alias("page_id"), "n_chars", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("highlight_id"))
    start = F.floor(F.col("n_chars") * F.col("highlight_id") / 5)
    h = h.select("page_id", "highlight_id", start.alias("start"), F.least("n_chars", start + 30 + F.col("page_id") % 90).alias("end"))
    return Q.overlapping(h, _placed(spark, sf))


@query("span_enrichment", "I19", f"SELECT s.span_id, e.edge_id, e.to_book, CASE WHEN length(t) <= 150 THEN t ELSE left(t, 149) || '…' END AS snippet FROM {DUCK_SPANS} s JOIN {DUCK_EDGES} e ON e.from_span = s.span_id JOIN (SELECT chunk_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM {DUCK_CHUNKS}) c ON c.chunk_id = e.to_chunk")
def span_enrichment(spark, sf):
    c = chunks(spark, sf).select(F.col("chunk_id").alias("to_chunk"), T.preview(F.col("text"), 150).alias("snippet"))
    e = edges(spark, sf).select(F.col("from_span").alias("span_id"), "edge_id", "to_book", "to_chunk")
    return spans(spark, sf).select("span_id").join(e, "span_id").join(c, "to_chunk").select("span_id", "edge_id", "to_book", "snippet")


@query("highlight_remap", "I20", "SELECT doc_id, position(h IN t) - 1 AS start_at, CASE WHEN position(h IN t) > 0 THEN position(h IN t) - 1 + length(h) ELSE -1 END AS end_at FROM (SELECT doc_id, 'New page. ' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS t, substring(text, 11, 25) AS h FROM documents)")
def highlight_remap(spark, sf):
    """Where a highlight (characters 10 to 35 of the old text) stands in the new text of its page."""
    t = F.concat(F.lit("New page. "), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")))
    at = F.call_function("locate", F.substring("text", 11, 25), t)
    return documents(spark, sf).select("doc_id", (at - 1).alias("start_at"), F.when(at > 0, at - 1 + F.length(F.substring("text", 11, 25))).otherwise(-1).alias("end_at"))


@query("book_render", "I11", f"""SELECT page_number, md5(string_agg('[' || chunk_index || '] ' || structural_type || ': ' || CASE WHEN length(t) <= 200 THEN t ELSE left(t, 199) || '…' END, chr(10) ORDER BY chunk_index)) AS rendered FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM {DUCK_CHUNKS}) GROUP BY 1""")
def book_render(spark, sf):
    line = F.concat(F.lit("["), F.col("chunk_index").cast("string"), F.lit("] "), "structural_type", F.lit(": "), T.preview(F.col("text"), 200))
    made = chunks(spark, sf).groupBy("page_number").agg(F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line")))).alias("l"))
    return made.select("page_number", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("rendered"))


@query("context_blocks", "I13", f"""WITH b AS (SELECT book_id, list(DISTINCT tag ORDER BY tag)[:50] AS tags FROM (SELECT book_id, unnest(tags) AS tag FROM {DUCK_CHUNKS}) GROUP BY 1) SELECT book_id, array_to_string(tags, ',') AS tags, len(tags) AS n FROM b""")
def context_blocks(spark, sf):
    t = chunks(spark, sf).select("book_id", F.explode("tags").alias("tag")).distinct().groupBy("book_id").agg(F.slice(F.array_sort(F.collect_list("tag")), 1, 50).alias("tags"))
    return t.select("book_id", F.array_join("tags", ",").alias("tags"), F.size("tags").cast("long").alias("n"))


# ── ingestion and streams ──


@query("content_dedup", "A7 A8", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def content_dedup(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return ingest.new_content(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "text", "doc_id").select("doc_id", "content_hash")


@query("upsert_by_key", "A9 A12", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000, 0 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def upsert_by_key(spark, sf):
    docs = documents(spark, sf).select("doc_id", "n_chars")
    changed = docs.filter("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"))
    return ingest.upsert(docs, changed.unionByName(docs.filter("doc_id % 6 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit(0).cast("long").alias("n_chars"))), "doc_id")


@query("replace_by_key", "A10 A20", "SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en') GROUP BY 1")
def replace_by_key(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "lang")
    return ingest.replace_by(docs, docs.filter("source in ('src1', 'src2') and lang = 'en'"), "source").groupBy("source").agg(F.count("*").alias("n"))


@query("swap_commit_gate", "A11", """WITH a AS (SELECT doc_id, source, doc_id % 13 = 0 OR (source = 'src3' AND doc_id % 4 = 3) AS failed FROM documents), r AS (SELECT source FROM a GROUP BY 1 HAVING count(*) < 20 OR avg(failed::int) <= 0.1)
SELECT source, count(*) AS n FROM (SELECT source FROM documents WHERE source NOT IN (SELECT source FROM r) UNION ALL SELECT source FROM a WHERE source IN (SELECT source FROM r) AND NOT failed) GROUP BY 1""")
def swap_commit_gate(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source")
    arriving = docs.withColumn("failed", (F.col("doc_id") % 13 == 0) | ((F.col("source") == "src3") & (F.col("doc_id") % 4 == 3)))
    return ingest.guarded_swap(docs, arriving, "source", "failed").groupBy("source").agg(F.count("*").alias("n"))


@query("cascade_delete", "A13", f"SELECT 'chunks' AS tbl, count(*) AS n FROM {DUCK_CHUNKS} WHERE book_id <> 'src4' UNION ALL SELECT 'pages', count(*) FROM documents WHERE source <> 'src4'")
def cascade_delete(spark, sf):
    gone = documents(spark, sf).filter("source = 'src4'").select(F.col("source").alias("book_id")).distinct()
    left = ingest.cascade({"chunks": chunks(spark, sf).select("book_id"), "pages": documents(spark, sf).select(F.col("source").alias("book_id"))}, gone, "book_id")
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in left.items()]
    return counted[0].unionByName(counted[1])


@query("empty_page_select", "A18 A1 A4", "SELECT page_id FROM pages WHERE page_id % 5 = 0 OR length(html) < 1500 OR regexp_matches(url, '(?i)EDU')")
def empty_page_select(spark, sf):
    p = read(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")))
    return p.filter((F.coalesce("html", F.lit("")) == "") | (F.length("html") < 1500) | F.col("url").rlike("(?i)EDU")).select("page_id")


@query("figure_page_select", "A19 A17", "SELECT DISTINCT page_id FROM (SELECT page_id FROM pages WHERE contains(html, '<nav') UNION ALL SELECT page_id FROM pages WHERE page_id % 7 = 0 AND page_id % 14 <> 0)")
def figure_page_select(spark, sf):
    p = read(spark, sf, "pages")
    names = p.filter("page_id % 7 = 0").select(F.concat(F.lit("x/page-"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    done = p.filter("page_id % 14 = 0").select(F.col("page_id").cast("int").alias("page_number"))
    on_disk = ingest.unprocessed_pages(names, done).select(F.col("page_number").cast("long").alias("page_id"))
    return p.filter(F.contains("html", F.lit("<nav"))).select("page_id").union(on_disk).distinct()


@query("json_fields", "C28", "SELECT event_id, try_cast(json_extract_string(j, '$.k') AS bigint) AS k FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS j FROM events)")
def json_fields(spark, sf):
    """Fields of JSON inside code fences; text that is no JSON gives null."""
    fenced = F.when(F.col("event_id") % 10 == 0, "no json").otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    bare = T.strip(F.regexp_replace(fenced, r"^```(?:json)?\s*|\s*```$", ""))
    return read(spark, sf, "events").select("event_id", F.from_json(bare, "k long")["k"].alias("k"))


@query("progress_windows", "A15 (batch)", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def progress_windows(spark, sf):
    made = progress.windowed(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("progress_stream", "A15", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def progress_stream(spark, sf):
    made = progress.run_once(spark, f"{sf}/events.parquet")
    return made.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
