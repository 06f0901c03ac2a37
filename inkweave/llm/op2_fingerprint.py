"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions are used. Words (runs without white space, unchanged) give shingles of five consecutive words,
or one shingle of all words where there are fewer. Each shingle is hashed once: the top bits name one of BINS bins, and
a bin keeps its smallest hash. An empty bin takes the value of the first filled bin in its own probe order, a
permutation of all bins given by a start and an odd step that come from a hash of the bin's number. The low BITS bits of
each bin, two hexadecimal digits, are the fingerprint. Chance agreement of so few bits is taken out of the likeness.

Equal texts have equal fingerprints; a text without words has a fingerprint of zeros, and two such texts have likeness
1. Null texts count as empty. Ties of doc_id are ordered by a hash of the text, then by text; a null id comes last in
descending order. A single
document is followed by itself. An empty table gives no rows. Only doc_id and text are read. Very long texts cost
n log n in their words and are held as one array, as any row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import SPACE

BINS, BITS, WORDS = 256, 8, 5
PROBES = 8


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mixed(x: int) -> int:
    """A 64-bit mix of a small number (two multiplications with shifts)."""
    x = (x + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


STARTS = [_mixed(j) % BINS for j in range(BINS)]
STEPS = [_mixed(j + BINS) % BINS | 1 for j in range(BINS)]
INVERSES = [pow(s, -1, BINS) for s in STEPS]


def _numbers(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def shingles(text: Column) -> Column:
    """Non-negative 63-bit hashes of the shingles of a text, with repeats."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    many = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WORDS),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]).bitwiseAND(F.lit(2**63 - 1)),
    )
    few = lambda h: F.array(F.xxhash64(h).bitwiseAND(F.lit(2**63 - 1)))
    return let(hashed, lambda h: F.when(F.size(h) >= WORDS, many(h)).when(F.size(h) > 0, few(h)).otherwise(F.expr("array(cast(null as bigint))")))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 63 - 8).cast("int")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(2**BITS - 1)).cast("int")


def _slots(least: Column) -> Column:
    """The bins' values in order, -1 where a bin is empty; least: the smallest hash of each filled bin, ascending."""

    def run(x, i):
        gap = _bin(x) - F.when(i == 0, F.lit(0)).otherwise(_bin(F.get(least, i - 1)) + 1)
        return F.concat(F.array_repeat(F.lit(-1), gap), F.array(_low(x)))

    rest = F.array_repeat(F.lit(-1), F.lit(BINS - 1) - _bin(F.element_at(least, -1)))
    return F.concat(F.flatten(F.transform(least, run)), rest)


def _dense(least: Column, slots: Column) -> Column:
    """The slots with empty bins filled. After a few probes the rank of each filled bin in the probe order decides."""
    starts, steps, inverses = _numbers(STARTS), _numbers(STEPS), _numbers(INVERSES)

    def filled(v, j):
        start, step, inverse = F.get(starts, j), F.get(steps, j), F.get(inverses, j)
        tries = []
        for a in range(PROBES):
            seen = F.get(slots, (start + step * a).bitwiseAND(F.lit(BINS - 1)))
            tries.append(F.when(seen >= 0, seen))
        ranked = F.transform(least, lambda x: ((_bin(x) - start) * inverse).bitwiseAND(F.lit(BINS - 1)) * 2**BITS + _low(x))
        return F.when(v >= 0, v).otherwise(F.coalesce(*tries, F.array_min(ranked).bitwiseAND(F.lit(2**BITS - 1))))

    return F.when(F.size(least) == BINS, slots).otherwise(F.transform(slots, filled))


def fingerprint(text: Column) -> Column:
    """array<int> of BINS values below 2 to the power of BITS; all 0 for a text without words."""

    def of(hashes):
        firsts = F.filter(hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(hashes, i - 1))))
        return let(firsts, lambda least: let(_slots(least), lambda slots: _dense(least, slots)))

    return let(F.array_sort(shingles(text)), lambda h: F.when(F.get(h, F.lit(0)).isNull(), F.array_repeat(F.lit(0), BINS)).otherwise(of(h)))


def packed(values: Column) -> Column:
    """The fingerprint as text: two hexadecimal digits a bin."""
    digits = F.expr("array(" + ", ".join(f"'{b:02x}'" for b in range(2**BITS)) + ")")
    return F.array_join(F.transform(values, lambda v: F.get(digits, v)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints, 0 to 1, chance agreement removed."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def _ranges(docs: DataFrame, docs_per_range: int, most_ranges: int) -> Column:
    """The number of a row's range, ascending with (doc_id, _tie), nulls first; about docs_per_range rows have one.

    Up to 2,048 quantiles of the ids part them; what lies between two is divided evenly. An id that is several quantiles,
    as a very frequent one is, and rows without an id are divided by their hash, so neither is a burden to one task.
    """
    n, missing = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    quantiles = min(2048, max(16, n // docs_per_range))
    at = docs.agg(F.percentile_approx("doc_id", [i / quantiles for i in range(quantiles + 1)], 40_000)).first()[0] or [0]
    parts = max(1, min(most_ranges // (3 * quantiles), -(-n // (quantiles * docs_per_range))))
    without = max(1, min(most_ranges // 3, -(-missing // docs_per_range)))
    low, begins, ties, base = sorted(set(at)), [], [], without + 1
    for value in low:
        begins.append(base)
        ties.append(max(1, (at.count(value) - 1) * parts))
        base += ties[-1] + parts
    listed = lambda xs, kind: F.expr(f"array({', '.join(f'{x}{kind}' for x in xs)})")
    share = F.shiftright("_tie", 10) / F.lit(float(2**53))

    def place(k):
        value, begin, tied = F.get(listed(low, "L"), k), F.get(listed(begins, ""), k), F.get(listed(ties, ""), k)
        width = F.coalesce(F.get(listed(low, "L"), k + 1).cast("double") - value.cast("double"), F.lit(1.0))
        between = F.least(F.lit(parts - 1), F.floor((F.col("doc_id").cast("double") - value.cast("double")) / width * parts))
        return F.when(k < 0, F.lit(without)).when(F.col("doc_id") == value, begin + F.floor(share * tied)).otherwise(begin + tied + between)

    found = let(F.size(F.filter(listed(low, "L"), lambda x: x <= F.col("doc_id"))) - 1, place)
    return F.when(F.col("doc_id").isNull(), F.floor(share * without)).otherwise(found).cast("int")


def with_next(docs: DataFrame, columns: dict, docs_per_range: int = 500, most_ranges: int = 65_536) -> DataFrame:
    """docs (doc_id, text) with text, columns (name -> Column made of text) and, as next_<name>, the next document's.

    The next document is that with the next smaller doc_id; after the last comes the first. Ids are dealt to ranges, so no
    task sees all rows. Each range also gets the first rows of the range below it. The table of ranges that is broadcast
    has at most most_ranges rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    ranged = docs.withColumn("_range", _ranges(docs, docs_per_range, most_ranges))
    heads = ranged.groupBy("_range").agg(F.max(F.struct("doc_id", "_tie")).alias("_head"))
    order = Window.orderBy("_range")  # over the ranges, whose number is bounded
    above = F.coalesce(F.lead("_range").over(order), F.first("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("_range", "_head", above.alias("_above"))
    ranged = ranged.join(F.broadcast(heads), "_range")
    own = F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_guest"))
    guest = F.struct(F.col("_above").alias("_at"), F.lit(True).alias("_guest"))
    first = F.col("doc_id").eqNullSafe(F.col("_head.doc_id")) & (F.col("_tie") == F.col("_head._tie"))
    dealt = ranged.select("doc_id", "text", "_tie", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))).alias("_place")).select("doc_id", "text", "_tie", "_place.*")
    made = dealt.repartition("_at").select("*", *[c.alias(name) for name, c in columns.items()])
    down = Window.partitionBy("_at").orderBy("_guest", F.desc_nulls_last("doc_id"), F.desc("_tie"), "text")
    followed = made.select("*", *[F.lead(name).over(down).alias(f"next_{name}") for name in ("text", *columns)])
    return followed.filter(~F.col("_guest")).drop("_at", "_guest", "_tie")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half gives way to the next document's beginning.

    (doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double).
    """
    rows = with_next(docs, {"print": fingerprint(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "print", "next_print")
    rows = rows.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("print")).alias("fingerprint"),
        packed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
