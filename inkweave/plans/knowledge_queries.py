"""Queries over the dictionary and over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import concepts as C
from inkweave.functions import text as T
from inkweave.operators import dictionary as D
from inkweave.operators import vectors as V
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK, DUCK_CHUNKS, DUCK_SPANS, chunks, documents, duck_pick, library, pick, q, read, spans, tag_of
from inkweave.plans.text_queries import _DUCK_SYNONYMS, _HYPHEN, _SNAKE, _TOKENS, duck_concepts
from inkweave.sources.tables import stage

_CID = "page_number * 1000 + (sentence - 1) // 8"


def _spans(spark, sf, of=None):
    text = F.concat(F.col("span_text"), F.when((F.col("page_number") * 3 + F.col("sentence")) % 31 == 0, " x := y").otherwise(""))
    return (spans(spark, sf) if of is None else of).withColumn("chunk_id", F.col("page_number") * 1000 + F.floor((F.col("sentence") - 1) / 8)).withColumn("span_text", text)


_ANAPHOR = "^\\s*(these|this|that|those|it|they|them|such|hence|thus|therefore|so|consequently|accordingly|moreover|furthermore)\\b"
_CANDS = f"""sp AS MATERIALIZED (SELECT *, {_CID} AS chunk_id, span_text || CASE WHEN (page_number * 3 + sentence) % 31 = 0 THEN ' x := y' ELSE '' END AS t FROM {DUCK_SPANS}),
ch AS MATERIALIZED (SELECT chunk_id, page_number, chunk_index, structural_type, tags AS chunk_tags FROM {DUCK_CHUNKS} WHERE trim(text) <> '' AND NOT regexp_matches(text, {q('(?i)' + _ANAPHOR)})),
rw AS (SELECT sp.span_id, sp.tags, sp.role, sp.t, ch.* FROM sp JOIN ch USING (chunk_id)),
an AS (SELECT chunk_id, page_number, chunk_index, min(span_id) AS span_id, arg_min(tags, span_id) AS tags, any_value(chunk_tags) AS chunk_tags FROM rw WHERE role = 'definition' AND structural_type = 'definition' GROUP BY 1, 2, 3),
ev AS (SELECT chunk_id, page_number, chunk_index, span_id, list_distinct(list_concat(tags, chunk_tags)) AS tags, 0 AS tier FROM an
 UNION ALL SELECT chunk_id, page_number, chunk_index, span_id, tags, 1 FROM rw WHERE role = 'definition' AND structural_type <> 'definition'
 UNION ALL SELECT chunk_id, page_number, chunk_index, span_id, list_transform(list_filter(tags, lambda x: suffix(x, '_definition')), lambda x: regexp_replace(x, '_definition$', '')), 2 FROM rw
 UNION ALL SELECT chunk_id, page_number, chunk_index, span_id, tags, 1 FROM rw WHERE contains(t, ':=')),
tg AS (SELECT * EXCLUDE (tags), unnest(tags) AS tag FROM ev),
map_ AS (SELECT tag, {duck_concepts('tag')} AS cs FROM (SELECT DISTINCT tag FROM tg)),
cand AS MATERIALIZED (SELECT chunk_id, page_number, chunk_index, span_id, tier, unnest(cs) AS concept FROM tg JOIN map_ USING (tag) WHERE regexp_matches(tag, '^[a-z][a-z0-9_]+$'))"""
_LATE = "CASE WHEN coalesce({0}, 0) = 0 THEN 1099511627776 ELSE {0} END"
_BEST = f"best AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY tier, {_LATE.format('page_number')}, {_LATE.format('chunk_index')}, span_id, chunk_id) AS r FROM cand) WHERE r = 1)"


def _library(spark, sf):
    """(chunks, spans) out of one reading of the texts."""
    s, c = library(spark, sf)
    return c, _spans(spark, sf, s)


def _dictionary(spark, sf):
    return D.best(D.candidates(*_library(spark, sf)))


@query("definition_candidates", "F2 F3", f"WITH {_CANDS} SELECT concept, tier, count(*) AS n FROM cand GROUP BY 1, 2")
def definition_candidates(spark, sf):
    return D.candidates(chunks(spark, sf), _spans(spark, sf)).groupBy("concept", "tier").agg(F.count("*").alias("n"))


@query("dictionary_best", "F4 F5", f"WITH {_CANDS}, {_BEST} SELECT concept, tier, span_id, chunk_id, page_number FROM best")
def dictionary_best(spark, sf):
    return _dictionary(spark, sf).select("concept", "tier", "span_id", "chunk_id", "page_number")


@query("dictionary_merge", "F5 F7 A9", f"""WITH {_CANDS}, {_BEST},
old AS (SELECT concept, tier, span_id, chunk_id, page_number, chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY tier, {_LATE.format('page_number')}, {_LATE.format('chunk_index')}, span_id, chunk_id) AS r FROM cand WHERE page_number % 2 = 0 AND tier > 0) WHERE r = 1)
SELECT coalesce(b.concept, o.concept) AS concept, CASE WHEN o.concept IS NULL OR (b.tier, {_LATE.format('b.page_number')}, {_LATE.format('b.chunk_index')}) < (o.tier, {_LATE.format('o.page_number')}, {_LATE.format('o.chunk_index')}) THEN b.span_id ELSE o.span_id END AS span_id FROM best b FULL JOIN old o USING (concept)""")
def dictionary_merge(spark, sf):
    cands = D.candidates(*_library(spark, sf))
    return D.merge(D.best(cands.filter("page_number % 2 = 0 and tier > 0")), D.best(cands)).select("concept", "span_id")


@query("definition_links", "F6 F13", f"""WITH {_CANDS}, {_BEST}, mp AS (SELECT tag, {duck_concepts('tag')} AS cs FROM (SELECT DISTINCT unnest(tags) AS tag FROM sp)),
w AS (SELECT DISTINCT span_id, s.chunk_id, unnest(cs) AS concept FROM (SELECT span_id, chunk_id, unnest(tags) AS tag FROM sp) s JOIN mp USING (tag))
SELECT span_id, target_chunk FROM (SELECT DISTINCT w.span_id, w.chunk_id, b.chunk_id AS target_chunk FROM w JOIN best b USING (concept) WHERE w.chunk_id <> b.chunk_id) WHERE NOT (span_id % 3 = 0)""")
def definition_links(spark, sf):
    """Every third span has its edges already."""
    chunks_, spans_ = _library(spark, sf)
    made = stage(D.best(D.candidates(chunks_, spans_)), "dictionary")  # a row for each concept, read twice
    existing = D.links(spans_.filter("span_id % 3 = 0"), made).select("span_id", "target_chunk")
    return D.links(spans_, made, existing).select("span_id", "target_chunk")


@query("definition_gather", "F9", f"""WITH {_CANDS}, {_BEST}, mp AS (SELECT tag, {duck_concepts('tag')} AS cs FROM (SELECT DISTINCT unnest(tags) AS tag FROM sp)),
tg2 AS (SELECT DISTINCT span_id, chunk_id, role, signed, unnest(cs) AS concept FROM (SELECT span_id, chunk_id, role, contains(t, ':=') AS signed, unnest(tags) AS tag FROM sp) JOIN mp USING (tag) WHERE role = 'definition' OR signed),
al AS (SELECT chunk_id, structural_type FROM {DUCK_CHUNKS}), sk AS (SELECT concept, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY span_id) AS k FROM tg2 WHERE role = 'definition') WHERE k <= 20), sg AS (SELECT concept, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY span_id) AS k FROM tg2 WHERE signed) WHERE k <= 10)
SELECT concept, chunk_id, min(tier) AS tier FROM (SELECT concept, chunk_id, tier FROM best UNION ALL SELECT concept, chunk_id, CASE WHEN structural_type = 'definition' THEN 0 ELSE 1 END FROM sk JOIN al USING (chunk_id) UNION ALL SELECT concept, chunk_id, 1 FROM sg) GROUP BY 1, 2""")
def definition_gather(spark, sf):
    chunks_, spans_ = _library(spark, sf)
    return D.gather(chunks_, spans_, D.best(D.candidates(chunks_, spans_)))


@query("missing_definitions", "F13", f"""WITH {_CANDS}, {_BEST}, mp AS (SELECT tag, {duck_concepts('tag')} AS cs FROM (SELECT DISTINCT unnest(tags) AS tag FROM sp)),
w AS (SELECT DISTINCT span_id, book_id, unnest(cs) AS concept FROM (SELECT span_id, book_id, unnest(tags) AS tag FROM sp WHERE gap_type = 'definition' OR search_class = 'L') JOIN mp USING (tag))
SELECT book_id, concept, count(*) AS n FROM w WHERE concept NOT IN (SELECT concept FROM best WHERE concept NOT IN ('bcfw', 'splitting', 'hidden_zeros')) GROUP BY 1, 2""")
def missing_definitions(spark, sf):
    chunks_, spans_ = _library(spark, sf)
    return D.missing(spans_, D.best(D.candidates(chunks_, spans_)).filter("concept not in ('bcfw', 'splitting', 'hidden_zeros')"))


_SYNONYM = f"coalesce({_DUCK_SYNONYMS}[{_HYPHEN}], {_HYPHEN})"
_ASKED = ["Hidden Zeros", "BCFW shifts", "non-adjacent Britto–Cachazo shifts", "soft limit check", "qft", "nothing known", "the scaffolding theorem", "Kinematic Mesh!", "UV scaling law", "string amplitudes"]


@query("concept_resolve", "F8", f"""WITH known AS (SELECT unnest([{', '.join(q(c) for c in C.CONCEPTS)}]) AS concept), texts AS (SELECT DISTINCT t FROM (SELECT {duck_pick(_ASKED, 'doc_id')} AS t FROM documents)),
f AS (SELECT t, {_SNAKE} AS snake, {_SYNONYM} AS synonym, list_filter({_TOKENS}, lambda w: NOT list_contains([{', '.join(q(w) for w in T.WEAK_TOKENS)}], w)) AS words FROM texts),
n AS (SELECT DISTINCT t, stage, concept FROM (SELECT t, 0 AS stage, unnest({duck_concepts('snake')}) AS concept FROM f UNION ALL SELECT t, 1, unnest({duck_concepts("replace(synonym, ' ', '_')")}) FROM f UNION ALL SELECT t, 2, unnest({duck_concepts('w')}) FROM (SELECT t, unnest(words) AS w FROM f)) JOIN known USING (concept)),
b AS (SELECT * EXCLUDE (least_stage) FROM (SELECT *, min(stage) OVER (PARTITION BY t) AS least_stage FROM n) WHERE stage = least_stage)
SELECT doc_id AS query_id, concept, stage FROM documents JOIN b ON b.t = {duck_pick(_ASKED, 'doc_id')}""")
def concept_resolve(spark, sf):
    queries = documents(spark, sf).select(F.col("doc_id").alias("query_id"), pick(_ASKED, F.col("doc_id")).alias("text"))
    names = spark.createDataFrame([(c,) for c in C.CONCEPTS], "concept string")
    return D.resolve(queries, names)


@query("definition_rank", "F10 F11", r"""WITH c AS (SELECT doc_id, page_id_ AS query_id, kind, tier, t, st, page FROM (SELECT doc_id, doc_id // 20 AS page_id_, CASE WHEN doc_id % 7 = 0 THEN 'notes' ELSE 'paper' END AS kind, doc_id % 3 AS tier, text || CASE WHEN doc_id % 5 = 0 THEN ' \(x\) := 1' ELSE '' END AS t,
 CASE WHEN doc_id % 4 = 0 THEN 'definition' WHEN doc_id % 4 = 1 THEN 'theorem' ELSE 'narrative' END AS st, doc_id % 50 AS page FROM documents)),
s AS (SELECT *, floor(((CASE WHEN kind = 'notes' THEN 30 ELSE 0 END + (2 - tier) * 10 + CASE WHEN length(t) >= 300 THEN 8 WHEN length(t) >= 150 THEN 4 WHEN length(t) < 50 THEN -5 ELSE 0 END + CASE WHEN contains(t, '\(') THEN 3 ELSE 0 END + CASE WHEN contains(t, '\[') THEN 5 ELSE 0 END
 + CASE WHEN contains(t, ':=') THEN 6 ELSE 0 END + CASE st WHEN 'definition' THEN 5 WHEN 'theorem' THEN 3 ELSE 0 END)::double - page::double * 0.05::double) * 100 + 0.5) / 100 AS score FROM c WHERE length(trim(t)) >= 25)
SELECT query_id, doc_id AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 20 = 13 THEN 1 ELSE 99 END, score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def definition_rank(spark, sf):
    """The five best definitions among twenty pages; a verdict puts one of them first."""
    n = F.col("doc_id")
    t = F.concat("text", F.when(n % 5 == 0, " \\(x\\) := 1").otherwise(""))
    score = D.heuristic_score(F.when(n % 7 == 0, "notes").otherwise("paper"), n % 3, F.col("t"), F.when(n % 4 == 0, "definition").when(n % 4 == 1, "theorem").otherwise("narrative"), n % 50)
    c = documents(spark, sf).select("doc_id", t.alias("t")).filter(F.length(F.trim("t")) >= 25).select(F.floor(n / 20).alias("query_id"), n.alias("chunk_id"), score.alias("score"))
    verdicts = documents(spark, sf).filter(n % 20 == 13).select(F.floor(n / 20).alias("query_id"), n.alias("chunk_id"), F.lit(1).alias("verdict_rank"))
    return D.ranked(c, verdicts).select("query_id", "chunk_id", "score", "rank")


@query("concept_span_count", "F12", f"SELECT concept, count(*) AS n FROM (SELECT span_id, unnest(list_filter(['hidden', 'zero', 'SHIFT', 'mesh'], lambda c: len(list_filter(tags, lambda t: regexp_matches(t, '(?i)' || c))) > 0)) AS concept FROM {DUCK_SPANS}) GROUP BY 1")
def concept_span_count(spark, sf):
    names = F.array(*[F.lit(x) for x in ("hidden", "zero", "SHIFT", "mesh")])
    hit = F.filter(names, lambda c: F.exists("tags", lambda t: F.regexp_like(t, F.concat(F.lit("(?i)"), c))))
    return spans(spark, sf).select(F.explode(hit).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


# ── vectors ──


def _rows(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, sf):
    return _rows(spark, sf).filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vector", "label")


_PAIRS = "pr AS MATERIALIZED (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS la, b.label AS lb, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def _ranked(source: str, k: int, where: str = "true") -> str:
    return f"SELECT query_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


def _shown(found):
    return found.select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def _show(sql: str, with_: str = _PAIRS) -> str:
    return f"WITH {with_} SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM ({sql})"


@query("vector_topk", "I1 G1 G2", _show(_ranked("pr", 20)))
def vector_topk(spark, sf):
    return _shown(V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 20))


@query("vector_topk_filtered", "I1", _show(_ranked("pr", 20, "lb % 2 = 0 AND cosine >= 0")))
def vector_topk_filtered(spark, sf):
    return _shown(V.top_k(_rows(spark, sf).filter("label % 2 = 0").drop("label"), _asked(spark, sf).drop("label"), 20, least=0.0))


@query("knn_join", "G2 G21", _show(_ranked("pr", 15, "la = lb")))
def knn_join(spark, sf):
    return _shown(V.top_k(_rows(spark, sf), _asked(spark, sf), 15, within="label"))


@query("hybrid_candidates", "G4 G16", _show(_ranked(f"(SELECT DISTINCT query_id, id, cosine FROM ({_ranked('pr', 25)}) UNION SELECT query_id, id, cosine FROM ({_ranked('pr', 15, 'la = lb')}))", 25)))
def hybrid_candidates(spark, sf):
    overall = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 25)
    return _shown(V.hybrid(overall, V.top_k(_rows(spark, sf), _asked(spark, sf), 15, within="label")))


@query("cosine_floor", "G5", _show(f"SELECT * EXCLUDE (best) FROM (SELECT *, max(cosine) OVER (PARTITION BY query_id) AS best FROM ({_ranked('pr', 25)})) WHERE best >= 0.45"))
def cosine_floor(spark, sf):
    return _shown(V.above_floor(V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 25), 0.45))


@query("prefilter_fallback", "G3", f"""WITH p AS (SELECT doc_id // 16 AS pool, doc_id AS id, {DUCK['tag_of']('doc_id', 1)} AS tag FROM documents), s AS (SELECT doc_id // 16 AS pool, doc_id AS query_id, {DUCK['tag_of']('doc_id', 2)} AS tag FROM documents WHERE doc_id % 16 = 0),
j AS (SELECT query_id, id, len(list_intersect({duck_concepts('s.tag')}, {duck_concepts('p.tag')})) > 0 AS hit, count(*) OVER (PARTITION BY query_id) AS n FROM s JOIN p USING (pool)),
k AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY query_id) AS hits FROM j) SELECT query_id, id FROM k WHERE hit OR (hits = 0 AND n < 30)""")
def prefilter_fallback(spark, sf):
    """Of a small pool those that share a concept with the asking row, or all if none does."""
    from pyspark.sql import Window

    n = F.col("doc_id")
    docs = documents(spark, sf)
    p = docs.select(F.floor(n / 16).alias("pool"), n.alias("id"), C.concepts_of(tag_of(n, 1)).alias("theirs"))
    s = docs.filter(n % 16 == 0).select(F.floor(n / 16).alias("pool"), n.alias("query_id"), C.concepts_of(tag_of(n, 2)).alias("own"))
    w = Window.partitionBy("query_id")
    j = s.join(p, "pool").withColumn("hit", F.arrays_overlap("own", "theirs")).withColumn("hits", F.sum(F.col("hit").cast("int")).over(w)).withColumn("n", F.count("*").over(w))
    return j.filter(F.col("hit") | ((F.col("hits") == 0) & (F.col("n") < 30))).select("query_id", "id")


@query("retrieval_reordered", "G26", f"WITH {_PAIRS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 7, id) AS place FROM ({_ranked('pr', 10)})")
def retrieval_reordered(spark, sf):
    """The ten nearest, then in reading order (page, place)."""
    from pyspark.sql import Window

    found = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 10)
    return found.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id") % 7, "id")).alias("place"))
