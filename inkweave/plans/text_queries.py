"""Queries over text expressions, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import concepts, identifiers, text
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK, documents, duck_chain, duck_sentences, duck_strip, like_any, pages, q


def _docs(spark, sf):
    return documents(spark, sf)


@query("sentence_split", "C1", f"SELECT doc_id, i AS sentence, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {duck_sentences('text')} AS s FROM documents))")
def sentence_split(spark, sf):
    found = _docs(spark, sf).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("at", "text"))
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("sentence"), "text")


@query("sentence_slice", "C3 C16", f"SELECT doc_id, array_to_string(s[2:4], ' ') AS text FROM (SELECT doc_id, {duck_sentences('text')} AS s FROM documents)")
def sentence_slice(spark, sf):
    return _docs(spark, sf).select("doc_id", text.sentence_slice(text.sentences(F.col("text")), F.lit(2), F.lit(4)).alias("text"))


@query("sentence_offsets", "C2", f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {duck_sentences('text')} AS s FROM documents),
w AS (SELECT doc_id, text, s, 1 AS k, position(s[1] IN text) - 1 AS start_at FROM d WHERE len(s) > 0
 UNION ALL SELECT doc_id, text, s, k + 1, start_at + length(s[k]) + position(s[k + 1] IN substring(text, (start_at + length(s[k]) + 1)::bigint)) - 1 FROM w WHERE k < len(s))
SELECT doc_id, k AS sentence, start_at, start_at + length(s[k]) AS end_at FROM w""")
def sentence_offsets(spark, sf):
    at = _docs(spark, sf).select("doc_id", F.posexplode(text.sentence_offsets(F.col("text"))).alias("k", "x"))
    return at.select("doc_id", (F.col("k") + 1).alias("sentence"), F.col("x.start").cast("long").alias("start_at"), F.col("x.end").cast("long").alias("end_at"))


@query("offset_to_sentence", "C4", r"SELECT doc_id, k AS part, len(string_split_regex(substring(text, 1, (n_chars * k // 4)::bigint), '\.\s+|\n\n+')) - 1 AS sentence FROM documents, (SELECT unnest([1, 2, 3]) AS k)")
def offset_to_sentence(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text", "n_chars", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("part"))
    return docs.select("doc_id", "part", text.sentence_at(F.col("text"), F.floor(F.col("n_chars") * F.col("part") / 4).cast("int")).alias("sentence"))


def _html(way: str, number: int, covers: str):
    @query(f"html_to_text_v{number}", covers, f"SELECT page_id, {duck_chain('html', text.HTML_TO_TEXT[way])} AS text FROM pages")
    def run(spark, sf):
        return pages(spark, sf).select("page_id", text.html_to_text(F.col("html"), way).alias("text"))


for _n, (_way, _covers) in enumerate([("spans", "B12"), ("pages", "B13"), ("repair", "B14"), ("notes", "B15"), ("reprocess", "B15b")], 1):
    _html(_way, _n, _covers)


@query("heading_extract", "B16", "SELECT page_id, nullif(regexp_extract(html, '<h2[^>]*>([^<]+)</h2>', 1), '') AS chapter, nullif(regexp_extract(html, '<h1[^>]*>([^<]+)</h1>', 1), '') AS title, nullif(regexp_extract(html, '<h3[^>]*>([^<]+)</h3>', 1), '') AS section FROM pages")
def heading_extract(spark, sf):
    h = lambda n: text.first_heading(F.col("html"), n)
    return pages(spark, sf).select("page_id", h(2).alias("chapter"), h(1).alias("title"), h(3).alias("section"))


@query("display_math_wrap", "B17", r"""
WITH m AS (SELECT doc_id, '<p>' || text || '</p><p> \[x_' || doc_id || ' = 1\] </p> y \[z\]' || CASE WHEN doc_id % 4 = 0 THEN '<div class="math-display">w</div>' ELSE '' END AS html FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(html, '<div\s+class=["'']math-display["'']') THEN html ELSE
 regexp_replace(regexp_replace(html, '<p[^>]*>\s*(\\\[[\s\S]*?\\\])\s*</p>', '<div class="math-display">\1</div>', 'g'), '\\\[([\s\S]*?)\\\]', '<div class="math-display">\\[\1\\]</div>', 'g') END AS html FROM m""")
def display_math_wrap(spark, sf):
    mark = F.when(F.col("doc_id") % 4 == 0, '<div class="math-display">w</div>').otherwise("")
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><p> \\[x_"), F.col("doc_id").cast("string"), F.lit(" = 1\\] </p> y \\[z\\]"), mark)
    return _docs(spark, sf).select("doc_id", text.wrap_display_math(html).alias("html"))


# lines of every look, by arithmetic on the document's id
_LINES = [
    "INTRODUCTION", "III. Results of the scan", "3. Discussion", "3.2 Sheaves", "A. Proof of it", "FIG. 2 A mesh", "B = x + 1", "f(x) = y", "α β γ = δ", "(8)", "", "@@FS18@@ Chapter 2",
    "MAIN RESULTS AND NOTES", "Section 4 and more", "plain words of a line", "Table 3: numbers", "x_1 = [a + b] * {c - d}", "Remarks",
]


def _lines(spark, sf):
    line = F.element_at(F.array(*[F.lit(x) for x in _LINES]), (F.col("doc_id") % len(_LINES) + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.posexplode(F.array_append(F.split("text", "\n"), line)).alias("line_number", "line"))


_DUCK_LINES = f"(SELECT doc_id, i - 1 AS line_number, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_append(string_split(text, chr(10)), [{', '.join(q(x) for x in _LINES)}][doc_id % {len(_LINES)} + 1]) AS l FROM documents)))"
_DUCK_BARE = duck_strip(f"regexp_replace(line, {q(text.FONT_MARK)}, '')")
_SPLIT_BARE = r"string_split_regex(bare, '\s+')"
_DUCK_EQUATION = (
    f"(length(bare) BETWEEN 5 AND 100 AND len(list_filter({_SPLIT_BARE}, lambda w: regexp_matches(w, '^[a-zA-Z]{{3,}}$'))) < 3 AND "
    f"(len(regexp_extract_all(bare, {q(text.MATH_SIGNS)})) / length(bare) > 0.15 OR {like_any('bare', text.EQUATION_STARTS)} OR "
    f"(contains(bare, '=') AND len(regexp_extract_all(bare, {q(text.EQUATION_SIGNS)})) > 3 AND length(bare) < 80)))"
)
_DUCK_HEADING = (
    f"(length(bare) BETWEEN 6 AND 100 AND (regexp_matches(bare, {q(text.KNOWN_HEADINGS)}) OR (regexp_matches(bare, '^[A-Z][A-Z\\s\\-,]+[A-Z]$') AND length(bare) >= 10 AND "
    f"len(list_filter({_SPLIT_BARE}, lambda w: length(w) >= 3)) >= 2) OR {like_any('line', text.SECTION_STARTS)}))"
)
_DUCK_SUBHEADING = f"(length(bare) BETWEEN 1 AND 100 AND {like_any('bare', text.SUBSECTION_STARTS)})"
_DUCK_BARES = f"(SELECT doc_id, line_number, line, {_DUCK_BARE} AS bare FROM {_DUCK_LINES})"


@query("heading_classify", "B11", f"SELECT doc_id, line_number, {_DUCK_HEADING} AS heading, {_DUCK_SUBHEADING} AS subheading FROM {_DUCK_BARES}")
def heading_classify(spark, sf):
    return _lines(spark, sf).select("doc_id", F.col("line_number").cast("long").alias("line_number"), text.is_heading(F.col("line")).alias("heading"), text.is_subheading(F.col("line")).alias("subheading"))


@query("equation_classify", "B10", f"SELECT doc_id, line_number, coalesce({_DUCK_EQUATION}, false) AS equation FROM {_DUCK_BARES}")
def equation_classify(spark, sf):
    return _lines(spark, sf).select("doc_id", F.col("line_number").cast("long").alias("line_number"), F.coalesce(text.is_equation(F.col("line")), F.lit(False)).alias("equation"))


@query("line_kinds", "B9", f"""SELECT doc_id, line_number, CASE WHEN bare = '' THEN 'blank' WHEN {_DUCK_HEADING} THEN 'heading' WHEN {_DUCK_SUBHEADING} THEN 'subheading'
 WHEN regexp_matches(bare, {q(text.CAPTION)}) THEN 'caption' WHEN {_DUCK_EQUATION} THEN 'equation' ELSE 'text' END AS kind FROM {_DUCK_BARES}""")
def line_kinds(spark, sf):
    return _lines(spark, sf).select("doc_id", F.col("line_number").cast("long").alias("line_number"), text.line_kind(F.col("line")).alias("kind"))


_ONE_LINE = duck_strip(r"regexp_replace(text, '\s+', ' ', 'g')")


@query("preview_text", "C25 J5", f"SELECT doc_id, CASE WHEN length(t) <= 140 THEN t ELSE left(t, 139) || '…' END AS preview FROM (SELECT doc_id, {_ONE_LINE} AS t FROM documents)")
def preview_text(spark, sf):
    return _docs(spark, sf).select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("sentence_separator", "C24", r"""
WITH p AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM (SELECT doc_id, text || CASE WHEN doc_id % 6 = 0 THEN ' $x$' ELSE '' END AS text FROM documents))
SELECT doc_id, CASE WHEN regexp_matches(text, '\\\(|\\\[|\$') OR len(s) <= 1 THEN text ELSE
 array_to_string(list_concat(list_transform(s[1:len(s) - 1], lambda x: regexp_replace(x, '[.!?]\s*$', '') || ';;'), [s[len(s)]]), ' ') END AS text FROM p""")
def sentence_separator(spark, sf):
    source = F.concat(F.col("text"), F.when(F.col("doc_id") % 6 == 0, " $x$").otherwise(""))
    return _docs(spark, sf).select("doc_id", source.alias("t")).select("doc_id", text.mark_sentences(F.col("t")).alias("text"))


_HYPHENED = "(SELECT doc_id, replace(text, ' ', CASE WHEN doc_id % 3 = 0 THEN '–' WHEN doc_id % 3 = 1 THEN '-' ELSE ' ' END) || '!' AS t FROM documents)"


def _hyphened(spark, sf):
    mark = F.when(F.col("doc_id") % 3 == 0, "–").when(F.col("doc_id") % 3 == 1, "-").otherwise(" ")
    return _docs(spark, sf).select("doc_id", F.concat(F.replace(F.col("text"), F.lit(" "), mark), F.lit("!")).alias("t"))


_PLAIN = "lower(translate(t, '‐‑‒–—−', '------'))"
_SNAKE = rf"replace({duck_strip(rf'''regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[-]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')''')}, ' ', '_')"
_TOKENS = rf"list_filter(string_split_regex(regexp_replace(regexp_replace({_PLAIN}, '[-]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 2)"


@query("snake_form", "E7", f"SELECT doc_id, {_SNAKE} AS snake FROM {_HYPHENED}")
def snake_form(spark, sf):
    return _hyphened(spark, sf).select("doc_id", text.snake_form(F.col("t")).alias("snake"))


_HYPHEN = duck_strip(rf"regexp_replace(regexp_replace({_PLAIN}, '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')")


@query("hyphen_form", "E8", f"SELECT doc_id, {_HYPHEN} AS hyphen FROM {_HYPHENED}")
def hyphen_form(spark, sf):
    return _hyphened(spark, sf).select("doc_id", text.hyphen_form(F.col("t")).alias("hyphen"))


@query("tokenise", "E9 E10", f"SELECT doc_id, array_to_string({_TOKENS}, ' ') AS tokens, len(list_filter({_TOKENS}, lambda w: NOT list_contains([{', '.join(q(w) for w in text.WEAK_TOKENS)}], w))) AS strong FROM {_HYPHENED}")
def tokenise(spark, sf):
    t = text.tokens(F.col("t"))
    return _hyphened(spark, sf).select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(text.strong_tokens(t)).cast("long").alias("strong"))


@query("anaphor_starts", "C18 F1", f"""SELECT doc_id, lower(regexp_extract(t, '^\\p{{L}}+')) AS word, list_contains([{', '.join(q(w) for w in text.ANAPHORS)}], lower(regexp_extract(t, '^\\p{{L}}+'))) AS anaphor,
 t <> '' AND NOT regexp_matches(t, {q('(?i)^' + chr(92) + 's*(' + '|'.join(text.ANAPHORS) + ')' + chr(92) + 'b')}) AS defines
 FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Hence ' WHEN doc_id % 4 = 1 THEN 'this, ' ELSE '' END || text AS t FROM documents)""")
def anaphor_starts(spark, sf):
    t = F.concat(F.when(F.col("doc_id") % 4 == 0, "Hence ").when(F.col("doc_id") % 4 == 1, "this, ").otherwise(""), F.col("text"))
    docs = _docs(spark, sf).select("doc_id", t.alias("t"))
    return docs.select("doc_id", text.first_word(F.col("t")).alias("word"), text.starts_with_anaphor(F.col("t")).alias("anaphor"), text.defines(F.col("t")).alias("defines"))


@query("paragraph_fallback", "J7", r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\n\n+'),
 lambda p: regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: p <> ''), lambda p: '<p>' || p || '</p>'), '') AS html
 FROM (SELECT doc_id, replace(text, '. ', ' <&> .' || chr(10) || chr(10)) AS t FROM documents)""")
def paragraph_fallback(spark, sf):
    t = F.replace(F.col("text"), F.lit(". "), F.lit(" <&> .\n\n"))
    return _docs(spark, sf).select("doc_id", text.paragraphs_html(t).alias("html"))


# ── annotations ──

_PHRASES = [p for p, _ in text.MISSING_PROOF]
_ANNOTATED = f"""(SELECT doc_id, text || ' ' || [{', '.join(q(p) for p in _PHRASES)}][doc_id % 11 + 1] || '. See [AM, Ch. ' || (doc_id % 5) || '] and [Har77]. Theorem ' || (doc_id % 9) || '.2 holds. Clearly so' || chr(10) || 'x (' || (doc_id % 7) || '.1)' || chr(10) || 'end' AS t FROM documents)"""


def _annotated(spark, sf):
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 11 + 1).cast("int"))
    digit = lambda n: (F.col("doc_id") % n).cast("string")
    t = F.concat(F.col("text"), F.lit(" "), phrase, F.lit(". See [AM, Ch. "), digit(5), F.lit("] and [Har77]. Theorem "), digit(9), F.lit(".2 holds. Clearly so\nx ("), digit(7), F.lit(".1)\nend"))
    return _docs(spark, sf).select("doc_id", t.alias("t"))


def _duck_matches(pattern: str, group: int, kind: str, value: str | None = None) -> str:
    """Every match with its sentence, by walking from match to match."""
    return rf"""SELECT doc_id, {q(kind)} AS kind, {value or 'v[k]'} AS value, len(string_split_regex(substring(t, 1, gap::bigint), '\.\s+|\n\n+')) - 1 AS sentence FROM (
 SELECT doc_id, t, v, k, list_sum(list_transform(range(1, k + 1), lambda j: length(pieces[j]))) + coalesce(list_sum(list_transform(range(1, k), lambda j: length(m[j]))), 0) AS gap FROM (
 SELECT doc_id, t, v, m, string_split_regex(t, {q(pattern)}) AS pieces, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, t, regexp_extract_all(t, {q(pattern)}, {group}) AS v, regexp_extract_all(t, {q(pattern)}, 0) AS m FROM {_ANNOTATED})))"""


_SCANS = {
    "missing_proof_scan": ("C5", " UNION ALL ".join(_duck_matches(f"(?i){p}", 0, "missing_proof", q(label)) for label, p in text.MISSING_PROOF)),
    "citation_scan": ("C6", _duck_matches(text.CITATION_KEY, 1, "citation")),
    "named_env_scan": ("C7", _duck_matches(text.NAMED_ENVIRONMENT, 1, "named")),
    "equation_number_scan": ("C8", _duck_matches(text.EQUATION_NUMBER, 1, "equation_number")),
}


def _scan(name: str):
    t = F.col("t")
    return {
        "missing_proof_scan": lambda: text.missing_proofs(t),
        "citation_scan": lambda: text.matches(t, text.CITATION_KEY, 1, "citation"),
        "named_env_scan": lambda: text.matches(t, text.NAMED_ENVIRONMENT, 1, "named"),
        "equation_number_scan": lambda: text.matches(t, text.EQUATION_NUMBER, 1, "equation_number"),
    }[name]()


def _register(name: str, covers: str, sql: str):
    @query(name, covers, sql)
    def run(spark, sf):
        return _annotated(spark, sf).select("doc_id", F.explode(_scan(name)).alias("x")).select("doc_id", "x.kind", "x.value", F.col("x.sentence").cast("long").alias("sentence"))


for _name, (_covers, _sql) in _SCANS.items():
    _register(_name, _covers, _sql)


@query("page_annotations", "C9", f"SELECT doc_id, kind, count(*) AS n FROM ({' UNION ALL '.join(sql for _, sql in _SCANS.values())}) GROUP BY doc_id, kind")
def page_annotations(spark, sf):
    counted = _annotated(spark, sf).select("doc_id", text.annotation_counts(F.col("t")).alias("found"))
    return counted.select("doc_id", F.explode("found").alias("x")).filter("x.n > 0").groupBy("doc_id", F.col("x.kind").alias("kind")).agg(F.sum("x.n").alias("n"))


_SUBJECTS = ["Hidden zero of it", "the splitting", "ABHY and associahedron", "soft limit", "Yang-Mills", "plain", "causal diamond", "uniqueness of factorization"]
_SUBJECT = f"(SELECT doc_id, [{', '.join(q(s) for s in _SUBJECTS)}][doc_id % 8 + 1] || ' ' || text AS t FROM documents)"


def _subjects(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in _SUBJECTS]), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", F.concat(s, F.lit(" "), F.col("text")).alias("t"))


_FOUND_TAGS = ", ".join(f"CASE WHEN regexp_matches(t, {q('(?i)' + p)}) THEN {q(tag)} END" for p, tag in text.PHRASE_TAGS)


@query("phrase_tags", "C23", f"SELECT doc_id, array_to_string(list_concat(['splitting'], list_filter([{_FOUND_TAGS}], lambda x: x IS NOT NULL AND x <> 'splitting')), ',') AS tags FROM {_SUBJECT}")
def phrase_tags(spark, sf):
    return _subjects(spark, sf).select("doc_id", F.array_join(text.with_phrase_tags(F.array(F.lit("splitting")), F.col("t")), ",").alias("tags"))


@query("model_route", "G27", f"SELECT doc_id, CASE WHEN {like_any('t', ['(?i)' + p for p in text.STRONG_MODEL])} THEN 'strong' ELSE 'standard' END AS tier FROM {_SUBJECT}")
def model_route(spark, sf):
    return _subjects(spark, sf).select("doc_id", text.model_tier(F.col("t")).alias("tier"))


# ── identifiers ──

_RAW_IDS = ["arXiv:2312.16282v3", "hep-th/0403047", "math.AG/0512411", "15", "arxiv 0704.0001].", "x2312.16282"]
_RAW_DOIS = ["https://doi.org/10.1007/JHEP03(2025)154", "doi: 10.1103/PhysRevD.1.", "10.99/abc", "http://dx.doi.org/10.12345/ABC,"]


@query("arxiv_normalise", "D-1", rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)^[a-z\-]+(\.[A-Z]{{2}})?/\d{{7}}$') THEN lower(t) WHEN regexp_matches(t, '^\d{{4}}\.\d{{4,5}}$') THEN t END AS arxiv_id
 FROM (SELECT doc_id, {duck_strip(r"regexp_replace(regexp_replace(regexp_replace(r, '(?i)^arxiv\s*[:\s]+', ''), '(?i)v\d+$', ''), '[.,;)\]]+$', '')")} AS t FROM (SELECT doc_id, [{', '.join(q(x) for x in _RAW_IDS)}][doc_id % 6 + 1] AS r FROM documents))""")
def arxiv_normalise(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW_IDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", raw.alias("r")).select("doc_id", identifiers.arxiv_id(F.col("r")).alias("arxiv_id"))


@query("doi_normalise", "D-2", rf"""SELECT doc_id, CASE WHEN regexp_matches(t, '^10\.\d{{4,9}}/') THEN lower(t) END AS doi FROM (SELECT doc_id,
 {duck_strip(r"regexp_replace(regexp_replace(regexp_replace(r, '(?i)^doi\s*[:\s]+', ''), '(?i)^https?://(dx\.)?doi\.org/', ''), '[.,;)\]]+$', '')")} AS t FROM (SELECT doc_id, [{', '.join(q(x) for x in _RAW_DOIS)}][doc_id % 4 + 1] AS r FROM documents))""")
def doi_normalise(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW_DOIS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", raw.alias("r")).select("doc_id", identifiers.doi(F.col("r")).alias("doi"))


@query("first_identifier", "D-3 D-6", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2' || (100 + doc_id % 900) || '.' || (10000 + doc_id) WHEN doc_id % 3 = 1 THEN 'hep-th/' || (1000000 + doc_id) END AS arxiv_id,
 CASE WHEN doc_id % 2 = 0 THEN '10.1007/jhep03(2025)' || doc_id END AS doi FROM documents""")
def first_identifier(spark, sf):
    number = F.col("doc_id")
    arxiv = F.when(number % 3 == 0, F.concat(F.lit(" arXiv:2"), (number % 900 + 100).cast("string"), F.lit("."), (number + 10000).cast("string"), F.lit("v2"))).when(number % 3 == 1, F.concat(F.lit(" [hep-th/"), (number + 1000000).cast("string"), F.lit("]"))).otherwise("")
    doi = F.when(number % 2 == 0, F.concat(F.lit(" https://doi.org/10.1007/JHEP03(2025)"), number.cast("string"), F.lit("."))).otherwise("")
    docs = _docs(spark, sf).select("doc_id", F.concat(F.col("text"), doi, arxiv).alias("t"))
    return docs.select("doc_id", identifiers.first_arxiv_id(F.col("t")).alias("arxiv_id"), identifiers.first_doi(F.col("t")).alias("doi"))


@query("citation_keys", "D-11", """
WITH k AS (SELECT doc_id, doc_id % 7 + 1 AS a FROM documents)
SELECT doc_id, array_to_string(list_transform(list_distinct_in_order, lambda x: x::varchar), ',') AS keys FROM (
 SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (SELECT doc_id, list_concat([a], range(a + 1, a + 4), [5, a], [22]) AS l FROM k))""")
def citation_keys(spark, sf):
    a = (F.col("doc_id") % 7 + 1)
    s = lambda c: c.cast("string")
    t = F.concat(F.col("text"), F.lit(" ["), s(a), F.lit("] and ["), s(a + 1), F.lit("-"), s(a + 3), F.lit("], [5, "), s(a), F.lit("] [22, 23-25] [31-26] [1 2]"))
    return _docs(spark, sf).select("doc_id", F.array_join(identifiers.citation_keys(t), ",").alias("keys"))


_BIB_LINES = ["[3] A. Author, A title", "[12] short", "→ an arrow", "name@host.org", "write to me.x@a.bc about it", "plain text of some length with [4] inside it"]


@query("bib_line_filter", "D-12 D-13", rf"""SELECT doc_id, (length(t) < 30 AND regexp_matches(t, '^\s*\[\d+\]')) OR regexp_matches(t, '^\s*\[\d+\]\s+[A-Z]\.\s*[A-Z\-]') OR regexp_matches(t, '^\s*[→•]') OR regexp_matches(t, '^\s*[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}')
 OR (regexp_matches(t, '[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}') AND len(string_split_regex(t, '\s+')) < 18) AS is_line,
 len(regexp_extract_all(t, '\[\d+\]')) >= 4 OR (len(regexp_extract_all(t, '\[\d+\]')) >= 2 AND len(regexp_extract_all(t, '\[\d+\]')) * 200 > length(t)) OR regexp_matches(t, '^\s*\[\d+\]\s+[A-Z]\.\s*[A-Z\-]') AS is_chunk
 FROM (SELECT doc_id, [{', '.join(q(x) for x in _BIB_LINES)}][doc_id % 6 + 1] || CASE WHEN doc_id % 5 = 0 THEN ' [1] [2]' ELSE '' END AS t FROM documents)""")
def bib_line_filter(spark, sf):
    line = F.element_at(F.array(*[F.lit(x) for x in _BIB_LINES]), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = _docs(spark, sf).select("doc_id", F.concat(line, F.when(F.col("doc_id") % 5 == 0, " [1] [2]").otherwise("")).alias("t"))
    return docs.select("doc_id", identifiers.is_bibliography_line(F.col("t")).alias("is_line"), identifiers.is_bibliography_text(F.col("t")).alias("is_chunk"))


# ── concepts ──

_TERMS = [" QFT ", "sheaf", "Yang-Mills", "unknown term", "bcfw shift", "Scheme"]
_DUCK_SYNONYMS = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in concepts.SYNONYMS.items()) + "}"


@query("synonym_map", "E1 E2", f"SELECT doc_id, coalesce({_DUCK_SYNONYMS}[t], t) AS term FROM (SELECT doc_id, trim(lower([{', '.join(q(x) for x in _TERMS)}][doc_id % 6 + 1])) AS t FROM documents)")
def synonym_map(spark, sf):
    term = F.element_at(F.array(*[F.lit(x) for x in _TERMS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", concepts.normal_term(term).alias("term"))


def duck_concepts(tag: str) -> str:
    found = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({tag}), {q(m)})' for m in markers)} THEN {q(name)} END" for name, markers in concepts.CONCEPTS.items())
    return f"(CASE WHEN len(list_filter([{found}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{found}], lambda x: x IS NOT NULL) ELSE [lower({tag})] END)"


@query("marker_concepts", "E3 E4", f"SELECT tag, array_to_string({duck_concepts('tag')}, ',') AS concepts, count(*) AS n FROM (SELECT {DUCK['tag_of']('doc_id', 1)} AS tag FROM documents) GROUP BY 1, 2")
def marker_concepts(spark, sf):
    from inkweave.plans.fixtures import tag_of

    tags = _docs(spark, sf).select(tag_of(F.col("doc_id"), 1).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).select("tag", F.array_join(concepts.concepts_of(F.col("tag")), ",").alias("concepts"), "n")


@query("concept_overlap", "E6 E5", f"""SELECT doc_id, len(list_intersect({duck_concepts('a')}, {duck_concepts('b')})) AS shared, lower(a) = lower(b) OR len(list_intersect({duck_concepts('a')}, {duck_concepts('b')})) > 0 AS same
 FROM (SELECT doc_id, {DUCK['tag_of']('doc_id', 1)} AS a, {DUCK['tag_of']('doc_id', 2)} AS b FROM documents)""")
def concept_overlap(spark, sf):
    from inkweave.plans.fixtures import tag_of

    rows = _docs(spark, sf).select("doc_id", tag_of(F.col("doc_id"), 1).alias("a"), tag_of(F.col("doc_id"), 2).alias("b"))
    rows = rows.select("doc_id", "a", "b", concepts.concepts_of(F.col("a")).alias("ca"), concepts.concepts_of(F.col("b")).alias("cb"))
    return rows.select("doc_id", concepts.overlap(F.col("ca"), F.col("cb")).cast("long").alias("shared"), ((F.lower("a") == F.lower("b")) | F.arrays_overlap("ca", "cb")).alias("same"))
