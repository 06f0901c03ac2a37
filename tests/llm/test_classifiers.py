"""op6, op7, op8: held-out accuracy on the small tables, odd rows, nothing to learn from."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkweave.llm import op6_quality, op7_language, op8_toxicity
from inkweave.llm.common import table
from tests.llm.helpers import empty, frame, odd_rows

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents").cache(), table(spark, SF, "labels")


def test_op6_held_out(tables):
    docs, labels = tables
    got = op6_quality.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    right = (got.score >= 0.3) == (got.quality == 1)
    assert right.mean() > 0.94 and (got.score[got.quality == 1] >= 0.3).mean() > 0.98


def test_op7_held_out(tables):
    docs, _ = tables
    got = op7_language.predict(docs.filter("doc_id < 4000")).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.99 and got.score.between(0, 1).all()


def test_op8_held_out(tables):
    docs, labels = tables
    got = op8_toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = got.score >= 0.5
    assert hit[got.toxic == 1].mean() > 0.85 and hit[got.toxic == 0].mean() < 0.01


def test_op8_sees_through_disguises(tables):
    docs, labels = tables
    rows, counts = op8_toxicity.sample(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("mark")), 1500, 16_000_000)
    m = op8_toxicity.fit(rows, counts)
    for masked in ("1d10t", "i.d.i.o.t", "idiiiiot", "i-d-i-o-t"):
        assert m.restored(masked) == "idiot", masked
    assert m.restored("p@thetic") == "pathetic" and m.restored("thnd***") == "thnd"
    base = "The of and that in. Anhe thtion you {} and the of thing in ti of the."
    clear, spaced, clean = m.score([base.format("stupid m0r0n"), base.format("s t u p i d moron"), base.format("heat ones")])
    assert clear > 0.5 and spaced > 0.5 and clean < 0.1
    assert m.clean("you s t u p i d m0r0n") == "you stupid moron"


def test_op8_long_and_mixed_disguises(tables):
    docs, labels = tables
    rows, counts = op8_toxicity.sample(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("mark")), 1500, 16_000_000)
    m = op8_toxicity.fit(rows, counts)
    for masked in ("i" * 70 + "diot", "idi" + "o" * 200 + "t", "i" + "." * 90 + "d.i.o.t", "1" * 70 + "d10t"):
        assert m.restored(masked) == "idiot", masked[:20]
    assert m.restored("4444444") == "4444444", "no letter, no disguise"
    assert len(m.restored("a1" * 100_000)) > 100_000, "linear: quadratic time would not end"
    base = "The of and that in. Anhe thtion you {} and the of thing in ti of the."
    plain, leet, stretched, numbers = m.score([base.format("stupid moron"), base.format("s t u p 1 d and m o r 0 n"), base.format("stup" + "i" * 80 + "d m" + "o" * 80 + "ron"), base.format("1 2 3 4 5")])
    assert min(plain, leet, stretched) > 0.5 and numbers < 0.1
    assert m.clean("you s t u p 1 d m0r0n") == "you stupid moron"


def test_op8_stars_stand_for_letters(tables):
    docs, labels = tables
    rows, counts = op8_toxicity.sample(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("mark")), 1500, 16_000_000)
    m = op8_toxicity.fit(rows, counts)
    words = [w for w in m.features if w.isalpha() and len(w) > 4][:12]
    masked = [(w, w[:k] + "*" + w[k + 1 :]) for w in words for k in (1, 2)]
    assert len(masked) == 24 and sum(m.restored(s) == w for w, s in masked) >= 22
    assert m.restored("s*t*u*p*i*d") == m.restored("st**id") == "stupid" and m.restored("i*d*i*o*t") == "idiot"


def test_op8_stars_take_bounded_time():
    import random
    import time

    r = random.Random(1)
    letters = [chr(0x4E00 + k) for k in range(1000)]
    words = Counter({"".join(r.choice(letters) for _ in range(6)): 1 for _ in range(3000)})
    m = op8_toxicity.LetterModel.of(words, Counter())
    begin = time.time()
    assert m.restore("一" + "*-" * 10_000 + "二") and m.restore("一" + "*" * 20_000 + "二")
    assert time.time() - begin < 60


@pytest.mark.parametrize("which", ["op6", "op7", "op8"])
def test_odd_rows(spark, tables, which):
    docs, labels = tables
    rows = odd_rows()
    odd = frame(spark, rows)
    marks = spark.createDataFrame([(i, k % 2, k % 2) for k, (i, *_) in enumerate(rows)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    run = {"op6": lambda d: op6_quality.score(d, marks), "op7": op7_language.predict, "op8": lambda d: op8_toxicity.score(d, marks)}[which]
    out = run(odd).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert sorted((r.doc_id or -1) for r in out) == sorted((i or -1) for i, *_ in rows)
    if which == "op7":
        assert {r.lang_pred for r in out if r.doc_id in (2, 3, 4, 12)} == {"und"}
        assert {r.lang_pred for r in out if r.doc_id == 1} == {"en"}
    assert run(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    odd = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in op6_quality.score(odd, none).collect()} == {0.5}
    assert {r.score for r in op8_toxicity.score(odd, none).collect()} == {0.0}
    assert {r.lang_pred for r in op7_language.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op7_automaton_knows_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    states = op7_language.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepts(s):
        state = 0
        for c in s:
            if c not in states[state]:
                return False
            state = states[state][c]
        return True

    import itertools

    for n in range(1, 6):
        for s in itertools.product([1, 2, 3], repeat=n):
            assert accepts(s) == (s in inside)


def test_op8_learns_from_all_labelled_rows(spark, tables):
    """More rows of a class than a sample once held: the model is that of all of them in memory."""
    docs = tables[0].filter("doc_id < 40").select("text").toPandas()["text"].tolist()
    rows = [(k, f"{docs[k % 40][:60]} w{k % 7} " + ("st*pid mor0n" if k % 3 == 1 else "idiot" if k % 2 else "lovely") + " end" * (k % 4), k % 2) for k in range(9000)]
    marks = spark.createDataFrame([(k, m) for k, _, m in rows], "doc_id long, mark int")
    table_ = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(5)
    train = spark.createDataFrame(rows, "doc_id long, text string, mark int").filter(~op8_toxicity.held_out(F.col("doc_id"))).toPandas()
    assert (train.mark == 1).sum() > 3000
    whole = op8_toxicity.fit(train, train.mark.value_counts().to_dict())
    got = op8_toxicity.fit_all(table_, marks)
    assert list(got.features) == list(whole.features) and got.share == whole.share
    assert got.letters.counts == whole.letters.counts
    assert got.weights == pytest.approx(whole.weights, rel=1e-3, abs=1e-4)
