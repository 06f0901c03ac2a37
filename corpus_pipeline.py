"""Cleaning pipeline over documents: language, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents.

* Language: rows whose text is null or has no letter go, and those that no learnt language explains better than letters
  at random would.
* Toxicity: rows with a score of MOST_TOXIC or more go.
* Near duplicates: of each group linked at a Jaccard similarity of 0.8 the document with the smallest id stays. Rows of a
  group that share an id are one document and stay together, as do rows without an id in a group that has none.
* Repeated passages: words covered by a window of 20 words that also starts earlier go from the text; n_chars follows. A
  document that loses all words stays, with an empty text.
* Packing: the pieces of all texts with their places in sequences of 1024 tokens.

Empty tables pass through all stages. Columns beyond those of documents, of any name, are carried along unread by the first
four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm import op5_repeats, op7_language, op8_toxicity, op9_jaccard
from inkweave.llm.common import discard, table, written
from inkweave.llm.queries import packed_rows

MOST_TOXIC = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(op7_language.labeller(docs)("text")["explained"])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return docs.filter(op8_toxicity.scorer(docs, table(spark, sf_dir, "labels"))("text")["score"] < MOST_TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = op9_jaccard.link(docs).filter(~F.col("kept")).select("row_key").distinct()
    # a condition instead of a name, which docs may have too
    return docs.join(copies, op9_jaccard.row_key(docs["doc_id"], docs["text"]) == copies["row_key"], "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = {c: f"other_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    renamed = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(name) for c, name in others.items()])
    made = {c: F.col(name) for c, name in others.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return op5_repeats.remove(renamed, list(others.values())).select(*[made[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_rows(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL can't express the stages; a test holds run() against brute-force versions of the last three, and others the two
#: classifiers against theirs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
