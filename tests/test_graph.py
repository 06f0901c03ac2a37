"""Loops over edges: chains longer than the registered queries' SQL unrolls."""

from inkweave.operators import graph


def _edges(spark, pairs, relation="extends"):
    return spark.createDataFrame([(k, a, b, relation, "z", "a") for k, (a, b) in enumerate(pairs)], "edge_id long, from_chunk long, to_chunk long, relation string, confidence string, relevance string")


def test_closure_of_long_chains_and_cycles(spark):
    chain, ring = [(k, k + 1) for k in range(20)], [(100 + k, 100 + (k + 1) % 3) for k in range(3)]
    made = {tuple(r) for r in graph.closure(_edges(spark, chain + ring), "extends").collect()}
    assert made == {(a, b) for a in range(21) for b in range(a + 1, 21)} | {(a, b) for a in range(100, 103) for b in range(100, 103)}
    assert graph.closure(_edges(spark, chain), "proves").count() == 0


def test_shortest_paths_go_ten_edges_by_default(spark):
    seeds = spark.createDataFrame([(0,)], "chunk_id long")
    made = {r.chunk_id: len(r.path) - 1 for r in graph.shortest_paths(_edges(spark, [(k, k + 1) for k in range(12)]), seeds).collect()}
    assert made == {k: k for k in range(11)}
