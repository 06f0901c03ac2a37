"""Queries over page layout: every word of every document becomes an item with a place by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.operators import layout
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import documents


def _items(spark, sf):
    """Even documents in two columns of five words a line, odd ones in one of twelve; every 17th line in a large font."""
    words = documents(spark, sf).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", rf"[{layout.BLANK}]+")).alias("i", "str"))
    two = F.col("page_id") % 2 == 0
    line = F.when(two, F.floor(F.col("i") / 5)).otherwise(F.floor(F.col("i") / 12))
    w = words.withColumn("line", line).withColumn("two", two)
    head = F.col("two") & (F.col("line") < 2)
    x = F.when(head, (F.col("i") % 5) * 110.0 + F.col("line") * 7).when(F.col("two"), (F.col("line") % 2) * 300.0 + (F.col("i") % 5) * 25.0).otherwise((F.col("i") % 12) * 45.0)
    y = F.when(F.col("two"), 90000.0 - 12 * F.floor(F.col("line") / 2) - (F.col("line") % 2) * 6).otherwise(90000.0 - 14 * F.col("line") - F.when(F.col("line") % 6 == 5, 16.0).otherwise(0.0))
    return w.select("page_id", x.alias("x"), y.alias("y"), F.when(F.col("i") % 4 == 3, 39.0).otherwise(25.0).alias("w"), F.when(F.col("line") % 17 == 3, 16.0).otherwise(10.0).alias("font"), "str")


_ITEMS = r"""w AS (SELECT doc_id AS page_id, i - 1 AS i, s[i] AS str, doc_id % 2 = 0 AS two FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\s+') AS s FROM documents))),
l AS (SELECT *, CASE WHEN two THEN i // 5 ELSE i // 12 END AS line FROM w),
items AS MATERIALIZED (SELECT page_id, CASE WHEN two AND line < 2 THEN (i % 5) * 110.0 + line * 7 WHEN two THEN (line % 2) * 300.0 + (i % 5) * 25.0 ELSE (i % 12) * 45.0 END::double AS x,
 CASE WHEN two THEN 90000.0 - 12 * (line // 2) - (line % 2) * 6 ELSE 90000.0 - 14 * line - CASE WHEN line % 6 = 5 THEN 16.0 ELSE 0 END END::double AS y, CASE WHEN i % 4 = 3 THEN 39.0 ELSE 25.0 END::double AS w, CASE WHEN line % 17 = 3 THEN 16.0 ELSE 10.0 END::double AS font, str FROM l)"""
_GUTTERS = f"""{_ITEMS}, wd AS (SELECT * FROM items WHERE str <> ''), bd AS (SELECT page_id, min(x) AS min_x, max(x) AS max_x FROM wd GROUP BY 1 HAVING count(*) >= 20 AND max(x) - min(x) >= 200),
bk AS (SELECT page_id, min_x, max_x, ceil((max_x - min_x) / 5)::int AS nb, floor((x - min_x) / 5)::int AS b FROM wd JOIN bd USING (page_id)), ct AS (SELECT page_id, b, count(*) AS k FROM bk WHERE b < nb GROUP BY 1, 2),
gr AS (SELECT page_id, min_x, max_x, unnest(range(floor(ceil((max_x - min_x) / 5) * 0.3)::int, floor(ceil((max_x - min_x) / 5) * 0.7)::int)) AS i FROM bd),
sm AS (SELECT gr.page_id, min_x, max_x, i, coalesce(sum(k), 0) AS s FROM gr LEFT JOIN ct ON ct.page_id = gr.page_id AND abs(ct.b - gr.i) <= 1 GROUP BY 1, 2, 3, 4),
gu AS MATERIALIZED (SELECT page_id, min_x, max_x, min_x + (i + 0.5) * 5 AS gutter FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY s, i) AS r FROM sm) WHERE r = 1 AND s <= 5)"""


@query("gutter_histogram", "B2", f"WITH {_GUTTERS} SELECT page_id, gutter::double AS gutter FROM gu")
def gutter_histogram(spark, sf):
    return layout.gutters(_items(spark, sf)).select("page_id", F.col("gutter").cast("double").alias("gutter"))


@query("column_split", "B4 B7", f"""WITH {_GUTTERS}, sd AS (SELECT page_id, floor(y + 0.5) AS line, bool_or(x < gutter - 10) AS l, bool_or(x > gutter + 10) AS r FROM wd JOIN gu USING (page_id) GROUP BY 1, 2),
rn AS (SELECT *, sum((l = r)::int) OVER (PARTITION BY page_id ORDER BY line DESC) AS run FROM sd), st AS (SELECT page_id, max(top) AS start FROM (SELECT page_id, run, max(line) AS top FROM rn WHERE l <> r GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
lb AS (SELECT page_id, CASE WHEN y > start + 2 THEN 'header' WHEN x < gutter THEN 'left' ELSE 'right' END AS part FROM wd JOIN gu USING (page_id) JOIN st USING (page_id)),
ok AS (SELECT page_id FROM lb GROUP BY 1 HAVING count(*) FILTER (part = 'left') >= 3 AND count(*) FILTER (part = 'right') >= 3) SELECT page_id, part, count(*) AS n FROM lb WHERE page_id IN (SELECT page_id FROM ok) GROUP BY 1, 2""")
def column_split(spark, sf):
    return layout.columns(_items(spark, sf)).groupBy("page_id", "part").agg(F.count("*").alias("n"))


@query("line_build", "B5", rf"""WITH {_ITEMS}, g AS (SELECT *, floor(y * 2 + 0.5) / 2 AS k, x - lag(x + w) OVER (PARTITION BY page_id, floor(y * 2 + 0.5) ORDER BY x, w, font, str) AS gap FROM items WHERE length(str) > 0),
n AS (SELECT page_id, k AS y, max(font) AS font, regexp_replace(trim(string_agg(CASE WHEN gap > font * 0.3 THEN ' ' ELSE '' END || str, '' ORDER BY x, w, font, str)), '\s{{2,}}', ' ', 'g') AS text FROM g GROUP BY 1, 2),
f AS (SELECT * FROM n WHERE text <> '' AND NOT (length(text) <= 2 AND regexp_matches(text, '^[0-9∗†‡§¶]+$'))),
b AS (SELECT *, lag(y) OVER q - y AS gap, lag(font) OVER q AS pf FROM f WINDOW q AS (PARTITION BY page_id ORDER BY y DESC))
SELECT page_id, md5(string_agg(CASE WHEN gap > least(pf, font) * 1.35 * 1.8 OR abs(pf - font) > 3 THEN chr(10) ELSE '' END || CASE WHEN font > 13 THEN '@@FS' || floor(font + 0.5)::int || '@@ ' ELSE '' END || text, chr(10) ORDER BY y DESC)) AS text_md5 FROM b GROUP BY 1""")
def line_build(spark, sf):
    return layout.page_text(layout.lines(_items(spark, sf))).select("page_id", F.md5("text").alias("text_md5"))


@query("anchored_lines", "B6", rf"""WITH RECURSIVE {_ITEMS}, ins AS MATERIALIZED (SELECT * FROM items WHERE x + w / 2 BETWEEN 0 AND 330), h AS MATERIALIZED (SELECT page_id, y, row_number() OVER (PARTITION BY page_id ORDER BY y DESC) AS k FROM (SELECT DISTINCT page_id, y - (page_id % 3) * 0 AS y FROM ins)),
a AS (SELECT page_id, y, k, y AS anchor FROM h WHERE k = 1 UNION ALL SELECT h.page_id, h.y, h.k, CASE WHEN a.anchor - h.y > 8 THEN h.y ELSE a.anchor END FROM a JOIN h ON h.page_id = a.page_id AND h.k = a.k + 1)
SELECT page_id, anchor AS y, md5(trim(regexp_replace(string_agg(str, ' ' ORDER BY x, y DESC, str), '\s+', ' ', 'g'))) AS text_md5 FROM ins JOIN a USING (page_id, y) GROUP BY 1, 2""")
def anchored_lines(spark, sf):
    return layout.anchored_lines(_items(spark, sf), 0, 330, 8).select("page_id", "y", F.md5("text").alias("text_md5"))


@query("figure_boxes", "B18 (geometry)", """SELECT page_id, k AS figure, greatest(0, floor(least(l, r) / 100 * 1200 + 0.5)::int) AS "left", greatest(0, floor((least(t, b) - 1) / 100 * 1600 + 0.5)::int) AS top, least(1200, floor(greatest(l, r) / 100 * 1200 + 0.5)::int) AS "right", least(1600, floor((greatest(t, b) + 1) / 100 * 1600 + 0.5)::int) AS bottom, 'Fig. ' || page_id AS caption
 FROM (SELECT page_id, k, (page_id * 7 % 100)::double AS l, (page_id * k % 100)::double AS t, (page_id * 13 % 100)::double AS r, 99.5::double AS b FROM pages, (SELECT unnest([1, 2]) AS k))""")
def figure_boxes(spark, sf):
    """Two placed figures and one without a place are put before each page's HTML."""
    n = F.col("page_id")
    s = lambda c: c.cast("string")
    figure = lambda k: F.concat(F.lit('<figure class="page-figure" data-bbox="'), s(n * 7 % 100), F.lit(", "), s(n * k % 100), F.lit(","), s(n * 13 % 100), F.lit(', 99.5"><figcaption>Fig. <b>'), s(n), F.lit("</b></figcaption></figure>"))
    from inkweave.plans.fixtures import pages

    html = F.concat(figure(1), F.lit('<figure class="page-figure"></figure>'), figure(2), F.col("html"))
    made = layout.figure_boxes(pages(spark, sf).select("page_id", html.alias("html")), 1200, 1600)
    return made.withColumn("caption", F.regexp_replace("caption", r"\s+", " "))


def _duck_sides(low: str, high: str, first: str, second: str) -> tuple[str, str]:
    held = lambda d: f"greatest(-({high} - {low}) * 0.5, least({d}, ({high} - {low}) * 0.4))"
    wanted, spare = f"(greatest({held(first)}, 0) + greatest({held(second)}, 0))", f"greatest({high} - {low} - 60, 0)"
    inwards = lambda d: f"CASE WHEN {held(d)} > 0 AND {wanted} > {spare} THEN {held(d)} * {spare} / {wanted} ELSE {held(d)} END"
    return f"({low} + {inwards(first)})", f"({high} - {inwards(second)})"


def _duck_judged() -> str:
    sql = "WITH a0 AS (SELECT page_id, (page_id * 7 % 300)::int AS l, (page_id * 11 % 400)::int AS t, (400 + page_id * 13 % 700)::int AS r, (500 + page_id * 17 % 900)::int AS b, 0 AS bl, 0 AS bt, 0 AS br, 0 AS bb, NULL::int AS score, 0 AS tries, false AS done FROM pages)"
    for k, by in enumerate([2.5, 1.5, 1.0]):
        score = f"CASE WHEN page_id % 13 = {k} THEN NULL ELSE ((page_id * 31 + {k} * 17) % 101)::int END"
        above, below, at_left, at_right = (f"((page_id * {m} + {k}) % {n} - {o})::double" for m, n, o in ((3, 9, 4), (5, 11, 3), (19, 200, 60), (23, 150, 90)))
        (top, bottom), (left, right) = _duck_sides("t", "b", f"{above} * {25 * by}", f"{below} * {25 * by}"), _duck_sides("l", "r", at_left, at_right)
        sql += f""", s{k} AS (SELECT *, {score} AS sc, done OR least(r - l, b - t) < 30 AS stop FROM a{k}), x{k} AS (SELECT *, NOT stop AND (tries = 0 OR coalesce(sc > coalesce(score, -1), false)) AS better FROM s{k}),
 a{k + 1} AS (SELECT page_id, CASE WHEN stop THEN l ELSE greatest(0, floor({left} + 0.5)::int) END AS l, CASE WHEN stop THEN t ELSE greatest(0, floor({top} + 0.5)::int) END AS t, CASE WHEN stop THEN r ELSE least(1200, floor({right} + 0.5)::int) END AS r, CASE WHEN stop THEN b ELSE least(1600, floor({bottom} + 0.5)::int) END AS b,
 CASE WHEN better THEN l ELSE bl END AS bl, CASE WHEN better THEN t ELSE bt END AS bt, CASE WHEN better THEN r ELSE br END AS br, CASE WHEN better THEN b ELSE bb END AS bb, CASE WHEN better THEN sc ELSE score END AS score, CASE WHEN stop THEN tries ELSE tries + 1 END AS tries, stop OR sc IS NULL OR sc >= 95 AS done FROM x{k})"""
    return sql + ' SELECT page_id, 1 AS figure, bl AS "left", bt AS top, br AS "right", bb AS bottom, score, tries AS attempts, coalesce(score < 50, false) AS abandoned FROM a3'


@query("figure_judged", "B18 (judge)", _duck_judged())
def figure_judged(spark, sf):
    """Three verdicts for each page's figure; in some an attempt has no score."""
    from inkweave.plans.fixtures import pages

    n = F.col("page_id")
    whole = lambda c: c.cast("int")
    verdict = lambda k: F.struct(
        F.when(n % 13 != k, whole((n * 31 + k * 17) % 101)).alias("score"), *[((n * m + k) % r - o).cast("double").alias(name) for name, m, r, o in (("above", 3, 9, 4), ("below", 5, 11, 3), ("left", 19, 200, 60), ("right", 23, 150, 90))]
    )
    boxes = pages(spark, sf).select("page_id", F.lit(1).alias("figure"), whole(n * 7 % 300).alias("left"), whole(n * 11 % 400).alias("top"), whole(n * 13 % 700 + 400).alias("right"), whole(n * 17 % 900 + 500).alias("bottom"), F.array(*[verdict(k) for k in range(3)]).alias("verdicts"))
    return layout.judged_boxes(boxes, 1200, 1600)
