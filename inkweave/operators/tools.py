"""Graph questions by name: a registry of tools with their parameters, and a session that counts calls.

A tool takes JSON and answers with rows; whatever goes wrong comes back as data, {"error": ...}, so that a caller in a loop
can go on. Answers are small by design: each tool has a limit that a caller can lower but not raise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import preview, squeeze
from inkweave.functions.vectors import cosine
from inkweave.operators import graph


@dataclass
class Library:
    """chunks (chunk_id, book_id, page_number, text, vector), spans (span_id, chunk_id, span_text), edges."""

    chunks: DataFrame
    spans: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Tool:
    run: Callable[[Library, dict], list[dict]]
    required: dict[str, type]
    optional: dict[str, type]


_TOOLS: dict[str, Tool] = {}


def tool(name: str, required: dict[str, type], optional: dict[str, type] | None = None):
    def add(run):
        _TOOLS[name] = Tool(run, required, optional or {})
        return run

    return add


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


@tool("search_chunks", {"vector": list}, {"book_id": str, "limit": int})
def search_chunks(lib: Library, a: dict) -> list[dict]:
    """The chunks nearest to a vector, best first, those with a positive cosine only."""
    asked = F.array(*[F.lit(float(x)) for x in a["vector"]])
    c = lib.chunks if "book_id" not in a else lib.chunks.filter(F.col("book_id") == a["book_id"])
    scored = c.select("chunk_id", "book_id", "page_number", preview(F.col("text")).alias("preview"), F.round(cosine(F.col("vector"), asked), 4).alias("cosine"))
    return _rows(scored.filter("cosine > 0").orderBy(F.desc("cosine"), "chunk_id").limit(max(1, min(20, a.get("limit", 10)))))


@tool("follow_edges", {"chunk_id": int}, {"direction": str, "relation": str, "exclude": list, "limit": int})
def follow_edges(lib: Library, a: dict) -> list[dict]:
    e = lib.edges.filter((F.col("from_chunk") == a["chunk_id"]) | (F.col("to_chunk") == a["chunk_id"]))
    found = graph.follow(e, max(1, min(50, a.get("limit", 20)))).filter(F.col("chunk_id") == a["chunk_id"])
    if a.get("direction", "both") != "both":
        found = found.filter(F.col("direction") == a["direction"])
    if "relation" in a:
        found = found.filter(F.col("relation") == a["relation"])
    if a.get("exclude"):
        found = found.filter(~F.col("other_id").isin(a["exclude"]))
    return _rows(found.orderBy("rank").select("edge_id", "direction", "relation", "other_id", "confidence", "relevance"))


@tool("read_chunk", {"chunk_id": int}, {"spans": bool})
def read_chunk(lib: Library, a: dict) -> list[dict]:
    c = lib.chunks.filter(F.col("chunk_id") == a["chunk_id"]).select("chunk_id", "book_id", "page_number", "text")
    if a.get("spans"):
        s = lib.spans.filter(F.col("chunk_id") == a["chunk_id"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "span_text"))).alias("spans"))
        c = c.join(s, "chunk_id", "left")
    return _rows(c)


@tool("get_path", {"from_chunk": int, "to_chunk": int}, {"max_edges": int})
def get_path(lib: Library, a: dict) -> list[dict]:
    seed = lib.chunks.filter(F.col("chunk_id") == a["from_chunk"]).select("chunk_id")
    found = graph.shortest_paths(lib.edges, seed, max(1, min(10, a.get("max_edges", 6))))
    return _rows(found.filter(F.col("chunk_id") == a["to_chunk"]).select("weight", "path"))


@tool("verify_quote", {"chunk_id": int, "quote": str})
def verify_quote(lib: Library, a: dict) -> list[dict]:
    norm = lambda c: F.lower(squeeze(c))
    c = lib.chunks.filter(F.col("chunk_id") == a["chunk_id"])
    return _rows(c.select("chunk_id", F.contains(norm(F.col("text")), norm(F.lit(a["quote"]))).alias("found")))


def schemas() -> dict[str, dict]:
    """The parameters of all tools, for a caller."""
    kinds = {int: "integer", str: "string", list: "array", bool: "boolean"}
    return {n: {"required": sorted(t.required), "properties": {k: kinds[v] for k, v in (t.required | t.optional).items()}, "about": (t.run.__doc__ or "").strip()} for n, t in _TOOLS.items()}


@dataclass
class Session:
    """Calls of tools on a library, at most max_calls of them, in at most max_turns turns."""

    library: Library
    max_calls: int = 20
    max_turns: int = 12
    calls: int = field(default=0)
    turns: int = field(default=0)

    def turn(self, calls: list[tuple[str, str]]) -> list[dict]:
        """The answers to all calls (name, arguments) of one turn; beyond the last turn each is an error."""
        if self.turns >= self.max_turns:
            return [{"error": f"no more than {self.max_turns} turns"} for _ in calls]
        self.turns += 1
        return [self.call(name, arguments) for name, arguments in calls]

    def call(self, name: str, arguments: str) -> dict:
        """{"rows": [...]} or {"error": reason}."""
        if self.calls >= self.max_calls:
            return {"error": f"no more than {self.max_calls} calls"}
        self.calls += 1
        if name not in _TOOLS:
            return {"error": f"unknown tool {name}"}
        t = _TOOLS[name]
        try:
            a = json.loads(arguments)
        except ValueError:
            return {"error": "arguments aren't JSON"}
        kinds = t.required | t.optional
        wrong = [k for k in t.required if k not in a] + [k for k, v in a.items() if k not in kinds or not isinstance(v, kinds[k])]
        if wrong:
            return {"error": f"missing or wrong: {', '.join(sorted(set(wrong)))}"}
        try:
            rows = t.run(self.library, a)
        except Exception as failure:  # noqa: BLE001  an answer, not a crash
            return {"error": str(failure)[:200]}
        return {"rows": rows} if rows else {"error": "nothing found"}
