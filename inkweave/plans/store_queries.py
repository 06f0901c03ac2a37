"""Queries over stored structures: a vector index, partitioned tables, blobs, prices as of a time, roll-ups, sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.operators import asof, markers, partitions, quotes, sketches, vector_index
from inkweave.operators import vectors as V
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import documents, duck_chain, pages, read
from inkweave.sources import blobs
from inkweave.sources.tables import shared_folder


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("vector_index_topk", "G2 G21 I1")
def vector_index_topk(spark, sf):
    """The 20 nearest of all ids divisible by 100 through the index; the number of lists to probe is found on some of them."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    index = vector_index.build(rows, _folder(spark, "vector-index"))
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(64)
    probes = vector_index.calibrate(index, some, V.top_k(rows, some, 20), 20)
    return vector_index.top_k(index, asked, 20, probes).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


# ── partitions ──

_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query("partition_replace", "A10 A11", """WITH a AS (SELECT doc_id, source, lang, n_chars < 200 AS failed FROM documents WHERE source IN ('src1', 'src2', 'src3')),
g AS (SELECT source FROM a GROUP BY 1 HAVING count(*) < 20 OR avg(failed::int) <= 0.1), k AS (SELECT DISTINCT source FROM a WHERE NOT failed AND source IN (FROM g))
SELECT doc_id, source, 'old' AS version FROM documents WHERE source NOT IN (FROM k) UNION ALL SELECT doc_id, source, 'new' FROM a WHERE NOT failed AND source IN (FROM k)""")
def partition_replace(spark, sf):
    """Three sources arrive again; short documents count as failed, and a source with too many of them keeps what it has."""
    path = _folder(spark, "by-source")
    docs = documents(spark, sf).select("doc_id", "source", "n_chars")
    partitions.store(docs.select("doc_id", "source", F.lit("old").alias("version")), path, "source")
    arriving = docs.filter("source in ('src1', 'src2', 'src3')").select("doc_id", "source", F.lit("new").alias("version"), (F.col("n_chars") < 200).alias("failed"))
    partitions.replace(arriving.select("doc_id", "source", "version", "failed"), path, "source", F.col("failed"))
    return spark.read.parquet(path).select("doc_id", "source", "version")


_OLD, _NEW = "pages", "spans"


@query("library_reextract", "A20 A11", f"""WITH p AS (SELECT page_id, {_HOST} AS book, {duck_chain('html', T.HTML_TO_TEXT[_OLD])} AS old, {duck_chain('html', T.HTML_TO_TEXT[_NEW])} AS new FROM pages),
a AS (SELECT *, length(new) < 400 AS failed FROM p), g AS (SELECT book FROM a GROUP BY 1 HAVING count(*) < 20 OR avg(failed::int) <= 0.1), k AS (SELECT DISTINCT book FROM a WHERE NOT failed AND book IN (FROM g))
SELECT book, page_id, 'old' AS version, md5(old) AS text_md5 FROM a WHERE book NOT IN (FROM k) UNION ALL SELECT book, page_id, 'new', md5(new) FROM a WHERE NOT failed AND book IN (FROM k)""")
def library_reextract(spark, sf):
    """The text of all books (hosts) is extracted again by another pipeline and replaces theirs, behind the error gate; a page
    that comes out short counts as failed."""
    path = _folder(spark, "library")
    p = pages(spark, sf).select("page_id", F.expr(_HOST).alias("book"), "html")
    partitions.store(p.select("page_id", "book", F.lit("old").alias("version"), T.html_to_text(F.col("html"), _OLD).alias("text")), path, "book")
    again = p.select("page_id", "book", F.lit("new").alias("version"), T.html_to_text(F.col("html"), _NEW).alias("text"))
    partitions.replace(again, path, "book", F.length("text") < 400)
    return spark.read.parquet(path).select(F.col("book").cast("string").alias("book"), "page_id", "version", F.md5("text").alias("text_md5"))


# ── blobs ──


@query("blob_round_trip", "A5 A6 A17", "SELECT 'en/page-' || page_id || '.html' AS key, octet_length(encode(html))::bigint AS length, sha256(html) AS content_sha256 FROM pages WHERE length(html) >= 3000")
def blob_round_trip(spark, sf):
    """Pages as blobs: written, read through the fallback of a folder that isn't there, without those read before (the short
    ones)."""
    folder = _folder(spark, "blobs")
    key = F.concat(F.lit("en/page-"), F.col("page_id").cast("string"), F.lit(".html"))
    p = pages(spark, sf).select(key.alias("key"), F.col("html").cast("binary").alias("content"), F.length("html").alias("n"))
    blobs.write_blobs(p, folder)
    found = blobs.unread(blobs.read_blobs(spark, f"{folder}-absent", folder, "page-*.html"), p.filter("n < 3000"))
    return found.select("key", "length", F.sha2("content", 256).alias("content_sha256"))


# ── prices, roll-ups, sketches ──


@query("price_as_of", "K23", """SELECT e.event_id, e.user_id, p.value AS price, coalesce(e.value * p.value, 0.0) AS cost FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND e.ts >= p.ts""")
def price_as_of(spark, sf):
    """Each click at the price of its user's last purchase before it."""
    e = read(spark, sf, "events")
    prices = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts", "value")
    priced = asof.as_of(clicks, prices, "user_id", "ts", ["price"])
    return priced.select("event_id", "user_id", "price", asof.cost(F.col("value"), F.col("price")).alias("cost"))


@query("library_rollup", "K5 K7 K13", """SELECT source, lang, grouping(source, lang)::bigint AS level, count(*) AS n, sum(n_chars)::bigint AS chars, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most
FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""")
def library_rollup(spark, sf):
    """Sizes of texts by source and language, source, language, and over the library, in one pass."""
    sets = documents(spark, sf).groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang")
    return sets.agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
    )


@query("sketch_merge", "K3 K4 K6")
def sketch_merge(spark, sf):
    """Distinct users, quantiles of values and the most frequent users of all events, from sketches stored by day."""
    folder = _folder(spark, "sketches")
    sketches.by_day(read(spark, sf, "events"), "ts", "user_id", "value").write.parquet(folder)
    month = spark.read.parquet(folder).withColumn("month", F.trunc("day", "month"))
    out = sketches.figures(sketches.merged(month, "month"), [0.1, 0.5, 0.9], 3)
    return out.withColumn("top", F.transform("top", lambda x: x["item"]))


# ── quotes and markers in the whole library ──


@query("quote_search", "J1 I5", r"""WITH d AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS w FROM documents),
a AS (SELECT doc_id AS quote_id, CASE WHEN doc_id % 200 = 0 THEN w[2:25] ELSE list_concat(w[2:12], ['zzz', 'qqq']) END AS q FROM d WHERE doc_id % 100 = 0),
b AS (SELECT quote_id, q, unnest(list_distinct(list_filter([len(q), 40, 30, 20, 15, 10, 6, 4, 3], lambda n: n >= 3 AND n <= len(q)))) AS words FROM a),
h AS (SELECT quote_id, words, doc_id AS page_id, unnest(list_filter(list_filter(range(1, len(w) + 1), lambda i: w[i] = q[1]), lambda i: w[i:i + words - 1] = q[1:words])) - 1 AS start FROM b JOIN d ON list_contains(w, q[1]))
SELECT quote_id, words, page_id, start FROM h QUALIFY words = max(words) OVER (PARTITION BY quote_id)""")
def quote_search(spark, sf):
    """24 words of every hundredth document are found in the library, in it and in its copies; every second quote ends in words
    that no document has."""
    folder = _folder(spark, "quotes")
    docs = documents(spark, sf).select(F.col("doc_id").alias("page_id"), "text")
    quotes.store(docs, folder)
    w = quotes.words_of(F.col("text"))
    quote = F.when(F.col("page_id") % 200 == 0, F.slice(w, 2, 24)).otherwise(F.concat(F.slice(w, 2, 11), F.array(F.lit("zzz"), F.lit("qqq"))))
    asked = docs.filter("page_id % 100 = 0").select(F.col("page_id").alias("quote_id"), F.array_join(quote, " ").alias("quote"))
    return quotes.search(spark, folder, asked)


@query("marker_scan", "E3 F8 G6", r"""WITH m AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS marker FROM benchmark)
SELECT doc_id AS text_id, marker AS marker_id FROM documents JOIN m ON length(marker) >= 4 AND contains(text, marker)""")
def marker_scan(spark, sf):
    """All words of the benchmark of four characters or more, as markers, in all documents."""
    words = read(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("marker")).filter(F.length("marker") >= 4).distinct()
    texts = documents(spark, sf).select(F.col("doc_id").alias("text_id"), "text")
    return markers.found(texts, words.select(F.col("marker").alias("marker_id"), "marker"))
