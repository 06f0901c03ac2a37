"""Files in and out, the two ways of a nearest-vector search, paths against a plain search."""

import heapq
import itertools

import numpy as np
import pytest

from inkweave.operators import graph, ingest
from inkweave.operators import vectors as V


def test_blobs_come_back(spark, tmp_path):
    rows = [(f"a/{k}.bin", bytes([k] * (k + 1))) for k in range(5)]
    blobs = spark.createDataFrame(rows, "key string, content binary")
    folder = str(tmp_path / "blobs")
    for _ in range(2):  # a second write leaves the same files
        stored = ingest.store_blobs(blobs, folder).collect()
        assert sorted((r.key, r.length) for r in stored) == [(k, len(c)) for k, c in rows]
    read = {r.path.rpartition("/")[2]: bytes(r.content) for r in ingest.files(spark, folder + "/a", "*.bin").collect()}
    assert read == {k.rpartition("/")[2]: c for k, c in rows}
    fallen = ingest.files(spark, str(tmp_path / "nowhere"), "*.bin", fallback=folder + "/a")
    assert fallen.count() == 5


def test_markdown_report(spark, tmp_path):
    lines = ingest.markdown_lines(spark.createDataFrame([("b", 2), ("a", None)], "name string, n int"), "Title", ["name"])
    ingest.write_markdown(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert text == ["# Title", "", "| name | n |", "| --- | --- |", "| a |  |", "| b | 2 |"]


@pytest.mark.parametrize("sent", [V.SENT, 0])
@pytest.mark.parametrize("how", [{}, {"within": "g"}, {"apart": "g"}, {"least": 0.3}])
def test_search_both_ways(spark, sent, how):
    r = np.random.RandomState(5)
    x = np.round(r.standard_normal((300, 8)), 1)
    x[200:] = x[:100]  # ties
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<double>, g int").repartition(5)
    queries = rows.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(f.query_id, f.rank): f.id for f in V.top_k(rows, queries, 7, sent=sent, row_block=60, query_block=9, **how).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = y @ y.T
    want = {}
    for q in range(0, 300, 10):
        ok = [i for i in range(300) if i != q and (how.get("within") is None or i % 3 == q % 3) and (how.get("apart") is None or i % 3 != q % 3) and cosine[q, i] >= how.get("least", -2)]
        for k, i in enumerate(sorted(ok, key=lambda i: (-round(cosine[q, i], 12), i))[:7]):
            want[q, k + 1] = i
    same = sum(got.get(k) == i for k, i in want.items())
    assert got.keys() == want.keys() and same >= 0.97 * len(want), "equal vectors may differ in the last bit"


def test_paths_against_a_plain_search(spark):
    r = np.random.RandomState(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    links = [(k, int(a), int(b), letters[r.randint(26)]) for k, (a, b) in enumerate(r.randint(0, 40, (60, 2)))]
    edges = spark.createDataFrame([(*e, "extends", "a") for e in links], "edge_id long, from_chunk long, to_chunk long, confidence string, relation string, relevance string")
    seeds = spark.createDataFrame([(k,) for k in range(0, 40, 7)], "chunk_id long")
    near = {}
    for _, a, b, c in links:
        w = 123 - ord(c)
        for p, q in ((a, b), (b, a)):
            near.setdefault(p, {})[q] = min(w, near.get(p, {}).get(q, 99))
    for most in (2, 10):
        best = {}
        for s in range(0, 40, 7):
            heap = [(0, [s])]
            while heap:
                w, path = heapq.heappop(heap)
                if len(path) - 1 < most and w <= best.get((s, path[-1]), (10**9,))[0] + 60:
                    for q, step in near.get(path[-1], {}).items():
                        if q not in path:
                            heapq.heappush(heap, (w + step, [*path, q]))
                best[s, path[-1]] = min(best.get((s, path[-1]), (10**9, [])), (w, path))
        got = {(f.seed, f.chunk_id): (f.weight, f.path) for f in graph.shortest_paths(edges, seeds, most).collect()}
        if most == 2:
            assert got == {k: v for k, v in best.items()}
        pairs = {(f.seed, f.chunk_id): (f.weight, f.path) for f in graph.shortest_paths(edges, seeds, most, seeds).collect()}
        assert pairs == {k: v for k, v in got.items() if k[1] % 7 == 0}
        for (s, t), (w, path) in got.items():
            assert path[0] == s and path[-1] == t and w == sum(near[a][b] for a, b in itertools.pairwise(path)) and len(path) - 1 <= most
