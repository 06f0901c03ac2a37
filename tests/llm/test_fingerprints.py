"""op2: edited texts and likeness against brute force."""

import hashlib

import pytest

from inkweave.llm import op2_fingerprint as op2
from tests.llm.helpers import empty, frame, odd_rows, plain, prose


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op2_against_brute_force(spark):
    texts = {i * 37 % 1009: prose(i, 5 + i * 7 % 400) for i in range(120)}
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in op2.edited_pairs(plain(spark, texts)).collect()}
    errors = []
    for i, n in zip(ids, ids[1:] + ids[:1], strict=True):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[n][:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        errors += [rows[i].near_edited - jaccard(shingles(t), shingles(edited)), rows[i].near_next - jaccard(shingles(t), shingles(texts[n]))]
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.17


def test_op2_odd_rows(spark):
    rows = odd_rows()
    out = op2.edited_pairs(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    prints = {}
    for r in out:
        assert len(r.fingerprint) == 2 * op2.BINS and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    same = [f for (i, _), f in prints.items() if i in (1, 7)]
    assert all(f == same[0] for f in same), "equal texts, equal fingerprints"
    assert all(set(next(iter(f))) == {"0"} for (i, n), f in prints.items() if n == 0)
    assert op2.edited_pairs(empty(spark)).count() == 0
    (alone,) = op2.edited_pairs(plain(spark, {5: "a b c d e f g h"})).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(("a b c d e f g h"[:8] + "a b c d ").encode()[:15]).hexdigest()


def test_op2_runs_no_python(spark):
    plan = op2.edited_pairs(plain(spark, {1: "a"}))._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in plan]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 255, 256, 600])
def test_op2_densification_matches_a_plain_version(spark, n):
    """Every empty bin takes the first filled bin in its probe order."""
    text = prose(n, n + 4)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "text string")
    values, hashes = df.select(op2.fingerprint(F.col("text")), op2.shingles(F.col("text"))).first()
    least = {}
    for h in hashes:
        least[h >> 55] = min(h, least.get(h >> 55, h))
    for j, v in enumerate(values):
        probe = next(b for a in range(op2.BINS) if (b := (op2.STARTS[j] + a * op2.STEPS[j]) % op2.BINS) in least) if j not in least else j
        assert v == least[probe] & 255


def test_op2_next_text_where_ids_repeat_or_lack(spark):
    """A third of all rows has no id, a third has one, and the rest lies close together: all are in one order, in many ranges."""
    import xxhash
    from pyspark.sql import functions as F

    rows = [(None, prose(k, 6)) for k in range(150)] + [(5, prose(200 + k, 6)) for k in range(150)] + [(10**15 + k, prose(400 + k, 6)) for k in range(149)] + [(-3, "")]
    tie = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 1
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1]), r[1]))
    want = {(str(i), t): n for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(str(r.doc_id), r.text): r.next_text for r in op2.with_next(df, {}, docs_per_range=10).collect()}
    assert got == want
    tied = df.withColumn("_tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    sizes = [r["count"] for r in tied.groupBy(op2._ranges(tied, 10, 65_536).alias("r")).count().collect()]
    assert max(sizes) < 50 and len(sizes) > 25
