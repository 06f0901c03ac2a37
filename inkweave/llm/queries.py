"""The thin queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.llm import op1_sentencepiece, op10_embeddings, op11_phrases, op12_bpe, op13_variants, op2_fingerprint, op3_ppm, op4_packing, op5_repeats, op6_quality, op7_language, op8_toxicity, op9_jaccard
from inkweave.llm.common import table


def op1_sentencepiece_codec(spark, sf_dir):
    return op1_sentencepiece.round_trip(table(spark, sf_dir, "documents"), op1_sentencepiece.default_model())


def op2_document_fingerprints(spark, sf_dir):
    return op2_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op3_ppm_scoring(spark, sf_dir):
    return op3_ppm.score(table(spark, sf_dir, "documents"))


def packed_rows(docs):
    """The digest of the packed pieces of docs: the ids themselves are left out of the shuffle."""
    cut = op4_packing.pieces(docs, op4_packing.default_vocabulary())
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return op4_packing.pack(cut, op4_packing.tasks_for(docs))


def op4_best_fit_packing(spark, sf_dir):
    return packed_rows(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark, sf_dir):
    kept = op5_repeats.remove(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_classifier(spark, sf_dir):
    scored = op6_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_language_id(spark, sf_dir):
    return op7_language.predict(table(spark, sf_dir, "documents"))


def op8_toxicity_score(spark, sf_dir):
    scored = op8_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_jaccard_join(spark, sf_dir):
    return op9_jaccard.link(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark, sf_dir):
    return op10_embeddings.link(table(spark, sf_dir, "embeddings"))


def op11_phrase_collocations(spark, sf_dir):
    return op11_phrases.mine(table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark, sf_dir):
    return op12_bpe.round_trip(table(spark, sf_dir, "documents"), op12_bpe.default_vocabulary())


def op13_spelling_variants(spark, sf_dir):
    return op13_variants.group(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece_codec": op1_sentencepiece_codec,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_ppm_scoring": op3_ppm_scoring,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_language_id": op7_language_id,
    "op8_toxicity_score": op8_toxicity_score,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_embedding_links": op10_embedding_links,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_spelling_variants": op13_spelling_variants,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PHRASES = f"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents)),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM pieces),
runs AS (
  SELECT lang, size, array_to_string(ws[k:k + size - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3)) AS s(size) WHERE k + size - 1 <= len(ws)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM runs GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a
  FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM candidates WHERE size = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT w.lang, w.phrase, w.a, w.l, w.r, w.score
  FROM worst w LEFT JOIN longer g ON w.size = 2 AND g.lang = w.lang AND g.phrase = w.phrase
  WHERE g.a IS NULL OR 100 * g.a < 50 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""

# crc32 by its table, a byte at a time
_VARIANTS = f"""
WITH table8 AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
found AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM found),
hashed AS (
  SELECT run, n, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, table8),
spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words),
less AS (SELECT DISTINCT word, substr(word, 1, k - 1) || substr(word, k + 1) AS cut FROM places),
holes AS (SELECT word, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS hole FROM places),
pairs AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.cut
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.cut),
best AS (
  SELECT p.word, count(*) AS n_near, arg_min(p.other, (-w.n, p.other)) AS near, max(w.n) AS near_n
  FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form,
         CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (
  WITH RECURSIVE up(word, root, depth) AS (
    SELECT word, word, 0 FROM forms
    UNION ALL SELECT up.word, f.form, depth + 1 FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
  SELECT word, arg_max(root, depth) AS root FROM up GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM forms f JOIN led l ON l.word = f.word
"""

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op11_phrase_collocations": _PHRASES, "op13_spelling_variants": _VARIANTS}
