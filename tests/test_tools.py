import json

import pytest

from inkweave.operators import tools


@pytest.fixture(scope="module")
def library(spark):
    c = spark.createDataFrame([(1, "a", 1, "The First  text", [1.0, 0.0]), (2, "a", 1, "second", [0.8, 0.6]), (3, "b", 2, "third", [-1.0, 0.0])], "chunk_id long, book_id string, page_number int, text string, vector array<double>")
    s = spark.createDataFrame([(10, 1, "The First"), (11, 1, "text")], "span_id long, chunk_id long, span_text string")
    e = spark.createDataFrame([(1, 1, 2, "extends", "z", "a"), (2, 2, 3, "assumes", "m", "a")], "edge_id long, from_chunk long, to_chunk long, relation string, confidence string, relevance string")
    return tools.Library(c, s, e)


def test_tools_answer(library):
    s = tools.Session(library)
    call = lambda name, **a: s.call(name, json.dumps(a))
    assert [r["chunk_id"] for r in call("search_chunks", vector=[1.0, 0.0], limit=99)["rows"]] == [1, 2]
    assert [r["other_id"] for r in call("follow_edges", chunk_id=2)["rows"]] == [1, 3]
    assert [r["other_id"] for r in call("follow_edges", chunk_id=2, direction="out")["rows"]] == [3]
    assert len(call("read_chunk", chunk_id=1, spans=True)["rows"][0]["spans"]) == 2
    assert call("get_path", from_chunk=1, to_chunk=3)["rows"] == [{"weight": 15, "path": [1, 2, 3]}]
    assert call("verify_quote", chunk_id=1, quote="first text")["rows"][0]["found"]


def test_turns_have_a_limit(library):
    s = tools.Session(library, max_turns=2)
    ask = [("read_chunk", '{"chunk_id": 1}')] * 2
    assert [len(r["rows"]) for r in s.turn(ask) + s.turn(ask)] == [1] * 4
    assert all("2 turns" in r["error"] for r in s.turn(ask)) and s.calls == 4


def test_tools_return_errors_as_data(library):
    s = tools.Session(library, max_calls=5)
    assert "unknown" in s.call("nope", "{}")["error"]
    assert "JSON" in s.call("read_chunk", "{")["error"]
    assert "chunk_id" in s.call("read_chunk", "{}")["error"]
    assert "chunk_id" in s.call("read_chunk", '{"chunk_id": "x"}')["error"]
    assert s.call("read_chunk", '{"chunk_id": 99}') == {"error": "nothing found"}
    assert "no more" in s.call("read_chunk", '{"chunk_id": 1}')["error"]
    assert set(tools.schemas()) == {"search_chunks", "follow_edges", "read_chunk", "get_path", "verify_quote"}
