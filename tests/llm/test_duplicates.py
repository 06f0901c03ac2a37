"""op5, op9, op10 and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import op5_repeats as op5
from inkweave.llm import op9_jaccard as op9
from inkweave.llm import op10_embeddings as op10
from tests.llm.helpers import empty, frame, odd_rows, plain, prose


def removed(texts: dict) -> dict:
    """Brute force: (n_words, n_removed, kept)."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        out[i] = (len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode())
    return out


def corpus(n=150):
    r = random.Random(5)
    passages = [prose(1000 + k, 25 + k * 9) for k in range(6)]
    texts = {}
    for k in range(n):
        parts = [prose(k, r.randint(5, 80))]
        if k % 3 == 0:
            parts.insert(r.randint(0, 1), r.choice(passages))
        if k % 10 == 4:
            parts.append(("De " * 50).strip())
        texts[k * 7 % 1000] = " ".join(parts)
    for k in range(20):
        texts[2000 + k] = texts[(k // 2) * 7 % 1000]
    return texts


def test_op5_against_brute_force(spark):
    texts = corpus()
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op5.remove(plain(spark, texts).repartition(7)).collect()}
    assert out == removed(texts) and sum(v[1] for v in out.values()) > 1000


def test_op5_over_many_slices(spark, monkeypatch):
    """The same when every slice holds a few texts, so that all meets only in the shuffles."""
    texts = corpus(60)
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op5.remove(plain(spark, texts).repartition(40)).collect()}
    assert out == removed(texts)


def test_op5_odd_rows(spark):
    rows = odd_rows()
    out = op5.remove(frame(spark, rows), ["lang", "id", "runs"]).collect()
    assert len(out) == len(rows) and out[0]["id"] == "x"
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.n_removed == 0 for r in by[1] + by[8] + by[None]) and by[2][0].n_words == 0 and by[3][0].kept == ""
    assert [r.n_removed for r in by[7]] == [60, 60], "both rows of 7 repeat the text of 1"
    assert op5.remove(empty(spark)).count() == 0


def sets(texts):
    return {i: op9.shingle_sets([t])[0] for i, t in texts.items()}


def linked(texts, least=0.8):
    s = {i: set(x.tolist()) for i, x in sets(texts).items()}
    ids, n, parent = sorted(s), dict.fromkeys(s, 0), {i: i for i in s}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if s[i] and s[j] and len(s[i] & s[j]) >= least * len(s[i] | s[j]):
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(i), n[i]) for i in ids}


def near_corpus(groups=12, copies=9):
    r = random.Random(3)
    texts = {k: prose(500 + k, r.randint(1, 120)) for k in range(60)}
    for g in range(groups):
        base = prose(g, 90).split()
        for c in range(copies):
            w = list(base)
            for _ in range(c % 5):
                w[r.randrange(len(w))] = f"new{r.random()}"
            texts[1000 + g * 50 + c] = " ".join(w)
    return texts


def test_op9_against_brute_force(spark):
    texts = near_corpus()
    out = {r.doc_id: (r.class_id, r.n_links) for r in op9.link(plain(spark, texts)).collect()}
    assert out == linked(texts) and sum(n for _, n in out.values()) > 100


def test_op9_splits_large_buckets_and_blocks(spark):
    """With tiny limits all goes through deeper paths and pairs of blocks, and the result stays the same."""
    texts = near_corpus(4, 14)
    out = {r.doc_id: (r.class_id, r.n_links) for r in op9.link(plain(spark, texts), small=3, block=4, exact_block=5).collect()}
    assert out == linked(texts)


def test_op9_odd_rows(spark):
    rows = odd_rows()
    out = op9.link(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in out)
    assert [x for x in got if x[0] in (1, 7)] == [(1, 1, 2), (7, 1, 2), (7, 1, 2)]
    assert all(x[1] == x[0] and x[2] == 0 for x in got if x[0] in (2, 3, 4, 5, 6, 11, 12))
    assert op9.link(empty(spark)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("rep", "unit", "filters", "size", "group")})


def brute_links(ids, x, least=0.95):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= least
    np.fill_diagonal(near, False)
    from inkweave.llm.blocks import stars

    order = np.argsort(ids)
    label = stars(*np.nonzero(np.triu(near[np.ix_(order, order)])), len(ids))
    comp = {ids[order[k]]: ids[order[label[k]]] for k in range(len(ids))}
    return {i: (int(near[k].sum()), comp[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [4096, 16])
def test_op10_against_brute_force(spark, block):
    r = np.random.RandomState(2)
    base = r.standard_normal((40, 64))
    x = np.concatenate([base[k] + 0.25 * r.standard_normal((15, 64)) for k in range(40)]).astype(np.float32)
    x = np.concatenate([x, x[:20]])  # exact copies
    ids = r.permutation(len(x)).tolist()
    out = {v.vec_id: (v.n_links, v.component_id) for v in op10.link(vectors(spark, [(i, row.tolist(), 1) for i, row in zip(ids, x, strict=True)]), block=block).collect()}
    want = brute_links(ids, x.astype(np.float64))
    assert out == want and sum(n for n, _ in want.values()) > 1000


def test_op10_recall_at_the_threshold():
    """Pairs at exactly 0.95 share a direction."""
    r = np.random.RandomState(7)
    v = r.standard_normal((4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    e = r.standard_normal((4000, 64))
    e -= (e * v).sum(1, keepdims=True) * v
    w = 0.95 * v + np.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    a, b = op10.decode(v, 128), op10.decode(w, 128)
    missed = sum(not np.intersect1d(p, q).size for p, q in zip(a, b, strict=True))
    assert missed <= 2


def test_op10_odd_vectors(spark):
    ok = [1.0, 2.0, 3.0]
    rows = [(1, ok, 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 2.0], 0), (6, [float("nan"), 1.0, 1.0], 0), (7, [float("inf"), 1.0, 1.0], 0), (8, ok, 0), (8, ok, 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0, 6.0], 0), (None, ok, 0)]
    out = op10.link(vectors(spark, rows)).collect()
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.n_links, r.component_id) for r in out if r.vec_id is not None)
    assert len(out) == len(rows)
    assert [x for x in got if x[0] in (1, 8, 10)] == [(1, 3, 1), (8, 3, 1), (8, 3, 1), (10, 3, 1)]
    assert all(n == 0 and c == i for i, n, c in got if i in (2, 3, 4, 5, 6, 7, 9))
    assert op10.link(vectors(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("dims", [2, 8, 300])
def test_op10_recall_in_few_and_many_dimensions(spark, dims):
    """Near vectors of any length are found; links are never wrong."""
    r = np.random.RandomState(dims)
    base = r.standard_normal((60, dims))
    x = np.concatenate([base + 0.15 * r.standard_normal((60, dims)) for _ in range(4)]).astype(np.float32)
    out = {v.vec_id: v.n_links for v in op10.link(vectors(spark, [(i, row.tolist(), 1) for i, row in enumerate(x)])).collect()}
    want = {i: n for i, (n, _) in brute_links(list(range(len(x))), x.astype(np.float64)).items()}
    assert all(out[i] <= want[i] for i in want) and sum(out.values()) >= 0.99 * sum(want.values()) > 0


def test_op10_takes_rows_not_ids(spark):
    """One id on two vectors, each with a link of its own."""
    r = np.random.RandomState(1)
    a, b = r.standard_normal((2, 24))
    rows = [(8, a), (8, b), (20, a + 0.01), (30, b + 0.01), (5, -a)]
    out = sorted((v.vec_id, v.n_links, v.component_id, v.kept) for v in op10.link(vectors(spark, [(i, x.astype(np.float32).tolist(), 1) for i, x in rows])).collect())
    assert out == [(5, 0, 5, True), (8, 1, 8, True), (8, 1, 8, True), (20, 1, 8, False), (30, 1, 8, False)]


def test_op10_work_follows_the_rows():
    """The code grows with the table: a direction holds about as many vectors at any size, and a vector as many lists."""
    r = np.random.RandomState(2)
    per, lists = [], []
    for n in (2_000, 10_000, 50_000):
        c = op10.codewords_for(n)
        y = r.standard_normal((1000, 32))
        made = op10.decode(y / np.linalg.norm(y, axis=1, keepdims=True), c)
        lists.append(np.mean([len(x) for x in made]))
        per.append(lists[-1] * n / c**2)
    assert max(per) < 1.5 * op10.PER_DIRECTION and max(lists) < 1.6 * min(lists)


def test_op9_recall_where_buckets_split(spark):
    """Pairs at about 0.8, in buckets that split several times: the runs go on until the recall is there."""
    r = random.Random(8)
    texts = {}
    for g in range(150):
        w = prose(g, 200).split()
        v = list(w)
        for at in r.sample(range(0, 200, 6), 4):  # some 20 of 196 shingles differ: a similarity of 0.81
            v[at] = f"new{r.random()}"
        texts[2 * g], texts[2 * g + 1] = " ".join(w), " ".join(v)
    want = linked(texts)
    out = {x.doc_id: x.n_links for x in op9.link(plain(spark, texts), small=2, block=16).collect()}
    links = sum(n for _, n in want.values())
    assert sum(out.values()) >= 0.99 * links > 150 and all(out[i] <= want[i][1] for i in texts)


def test_op9_components_of_many_blocks(spark):
    """A group whose sets fill many blocks: rows meet only where a candidate asks for them, and no link is lost."""
    texts = near_corpus(3, 30)
    out = {x.doc_id: (x.class_id, x.n_links) for x in op9.link(plain(spark, texts), exact_block=4, exact_bytes=3000).collect()}
    assert out == linked(texts)


def piped(rows: list[tuple], labels: list[tuple]) -> list[tuple]:
    """The pipeline's last two decisions by brute force over what the two classifiers keep: (doc_id, kept words) of rows."""
    texts = {k: t for k, (_, t) in enumerate(rows)}
    classes = linked(texts)
    least = {}
    for k, (c, _) in classes.items():
        i = rows[k][0]
        if i is not None and (c not in least or i < least[c]):
            least[c] = i
    left = [(rows[k][0], texts[k]) for k in texts if rows[k][0] == least.get(classes[k][0])]
    order = sorted(left, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for at, (i, t) in enumerate(order):
        w = t.encode().split()
        for s in range(len(w) - 19):
            k, here = tuple(w[s : s + 20]), ((i is None, i or 0), s)
            first[k] = min(first.get(k, here), here)
    out = []
    for i, t in left:
        w = t.encode().split()
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < ((i is None, i or 0), s):
                gone |= set(range(s, s + 20))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() with repeated rows, ties of id, missing ids and clashing columns."""
    import zlib

    import corpus_pipeline as p
    from inkweave.llm import op4_packing as op4

    passage = prose(900, 60)
    rows = odd_rows() + [(100 + k, prose(k, 70), "en", "s", 1) for k in range(40)] + [(300 + k, prose(k, 70), "en", "s", 1) for k in range(5)]
    rows += [(400 + k, prose(800 + k, 40) + " " + passage, "en", "s", 1) for k in range(4)] + [(None, prose(10, 50), "en", "s", 1), (2**60 + 1, prose(850, 50), "en", "s", 1)]
    rows += [(500 + k, prose(600 + k, 30) + " you stupid id10t moron " + prose(700 + k, 10), "en", "s", 1) for k in range(12)]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("_language", "_toxic", "row_key", "explained", "kept")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 1, 0) for k in range(40)] + [(500 + k, 0, 1) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clear = [(r.doc_id, r.text) for r in p.toxicity(spark, p.language(spark, docs, str(tmp_path)), str(tmp_path)).collect()]
    assert {str(i) for i, _ in clear} == {str(i) for i, *_ in rows} - {"2", "3", "4", "5", "6", "12"} - {str(500 + k) for k in range(12)}
    encode, want = op4.encoder(op4.default_vocabulary()), []
    for i, t in piped(clear, []):
        ids = [*encode(t), 2]
        ends = [*range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(str(i), k, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends))]
    got = [(str(r.doc_id), r.piece, r.ids_crc32) for r in p.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = [r for r in odd_rows() if r[0] not in (7, 8)] + [(100 + k, prose(k, 70), "en", "s", 1) for k in range(40)] + [(300 + k, prose(k, 70), "en", "s", 1) for k in range(5)]
    docs = frame(spark, rows, clashes=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = docs
    kept = {}
    for name, stage in p.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        d = spark.createDataFrame(d.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in d.collect()}
    assert not {2, 3, 4, 12} & set(kept["language"]) and {1, 100, 300} <= set(kept["language"])
    assert not set(range(300, 305)) & set(kept["near_duplicates"])
    assert all(r.n_chars == len(r.text) for r in kept["repeated_passages"].values())
    out = p.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept["repeated_passages"])
    schema = docs.schema
    none = spark.createDataFrame([], schema)
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_of_any_shape(spark, shape):
    from inkweave.llm.blocks import stars
    from inkweave.llm.common import components

    r = np.random.RandomState(4)
    pairs = {"chain": [(k, k + 1) for k in range(120)], "star": [(60, k) for k in range(120)], "random": r.randint(0, 150, (110, 2)).tolist()}[shape]
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "u long, v long"), "test").collect()}
    label = stars(*np.array(pairs).T, 151)
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert set(got) == nodes and all((got[a] == got[b]) == (label[a] == label[b]) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([], "u long, v long"), "none").count() == 0


def test_op10_decoding_takes_the_same_memory_at_any_number_of_codewords():
    import tracemalloc

    from inkweave.llm import op10_embeddings as op10

    vectors = np.random.RandomState(0).standard_normal((3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    peaks = []
    for codewords in (256, 4096):
        op10.code(32, codewords)
        tracemalloc.start()
        lists = op10.decode(vectors, codewords)
        kept = sum(x.nbytes for x in lists)
        peaks.append(tracemalloc.get_traced_memory()[1] - kept)
        tracemalloc.stop()
        assert len(lists) == 3000 and all(len(x) >= op10.least_list(codewords) for x in lists[::100])
        assert all((a == b).all() for a, b in zip(lists[:50], op10._decoded(vectors[:50], codewords), strict=True))
    assert peaks[1] < 1.5 * peaks[0]


def test_op9_more_runs_than_twelve(spark, monkeypatch):
    """Runs that keep meeting new close pairs go on, and end in an error where there are no more."""
    from inkweave.llm import op9_jaccard as op9

    spent = []

    def met(classes, run, *_):
        spent.append(run)
        rows = [(bytes([0, run]), bytes([1, run]), True)] if run < 13 else [(bytes([0, 0]), bytes([1, 0]), True)]
        return spark.createDataFrame(rows, "u binary, v binary, close boolean")

    monkeypatch.setattr(op9, "candidates", met)
    labels = op9.joined(None, 0.8, 0.55, 10, 10, 0.999)
    assert spent == list(range(14)) and labels.count() == 26
    monkeypatch.setattr(op9, "MOST_RUNS", 3)
    with pytest.raises(RuntimeError, match="after 3 runs"):
        op9.joined(None, 0.8, 0.55, 10, 10, 0.999)
