"""Quality by compression: zstandard dictionaries of good and of bad text compete, and the difference is calibrated.

Half of a bounded sample of labelled documents builds one dictionary for each class, both in the same way and with the
same bound: zstandard's training on blocks of the texts or, if it finds too little in either class, equal shares of the
blocks themselves for both. A whole text is compressed in blocks with both; the difference of the two sizes over the
text's bytes, with the text's own compressibility, goes through a logistic curve fitted on the other half of the sample.
Blocks keep a long text from drowning the dictionaries in its own history. A class of fewer than FEW rows serves both
ends with all of them.

Empty and null texts take the curve's value at sizes of 0. If a class has no rows to learn from (or only empty texts),
every score is the share of good rows (0.5 without any). Repeated rows score alike; an empty table gives no rows; other
columns aren't read. Labels only choose the sample; language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import by_text
from inkweave.llm.training import class_weights, held_out, logistic, sample, sigmoid

BLOCK = 512
FEW = 16


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    trained: bool
    weights: np.ndarray
    level: int

    def features(self, texts: list[str]) -> np.ndarray:
        import zstandard

        def coder(raw: bytes):
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if self.trained else zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(level=self.level, dict_data=content, write_content_size=False, write_dict_id=False).compress

        good, bad = coder(self.good), coder(self.bad)
        out = np.zeros((len(texts), 5))
        for i, text in enumerate(texts):
            data = text.encode()
            a = b = 0
            for at in range(0, len(data), BLOCK):
                part = data[at : at + BLOCK]
                a += len(good(part))
                b += len(bad(part))
            n = max(len(data), 1)
            d, r = (a - b) / n, min(a, b) / n
            out[i] = d, r, r * r, d * r, 1
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.full(len(texts), float(self.weights[-1]))
        x = self.features(texts)
        return sigmoid(x @ self.weights)


def blocks(texts: list[str]) -> list[bytes]:
    return [data[at : at + BLOCK] for data in map(str.encode, texts) for at in range(0, len(data), BLOCK)]


def dictionaries(good: list[bytes], bad: list[bytes], size: int) -> tuple[bytes, bytes, bool]:
    """(dictionary of the good blocks, of the bad ones, whether they are trained); both are built alike."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, good).as_bytes(), zstandard.train_dictionary(size, bad).as_bytes(), True
    except zstandard.ZstdError:  # too little text in one of the classes
        least = min(size, sum(map(len, good)), sum(map(len, bad)))
        shares = [b"".join(p[:: max(1, sum(map(len, p)) // least)])[:least] for p in (good, bad)]
        return *shares, False


def fit(rows: pd.DataFrame, counts: dict, size: int = 100_000, level: int = 3) -> QualityModel:
    """rows (text, mark 0 or 1); counts of all training rows by mark."""
    y, texts = rows["mark"].to_numpy().astype(int), np.array(rows["text"].tolist(), dtype=object)
    rank = pd.Series(y).groupby(y).cumcount().to_numpy()
    few = np.array([(y == m).sum() < FEW for m in (0, 1)])[y] if len(y) else np.zeros(0, dtype=bool)
    parts = [blocks(texts[(y == m) & (few | (rank % 2 == 0))].tolist()) for m in (1, 0)]
    if not all(parts):
        total = sum(counts.values())
        return QualityModel(b"", b"", False, np.array([counts.get(1, 0) / total if total else 0.5]), level)
    model = QualityModel(*dictionaries(*parts, size), np.zeros(5), level)
    other = few | (rank % 2 == 1)
    model.weights = logistic(model.features(texts[other].tolist()), y[other], class_weights(y[other], counts))
    return model


def score(docs: DataFrame, labels: DataFrame, per_class: int = 3000, chars: int = 16_000_000) -> DataFrame:
    """(doc_id, held_out boolean, score double) of every row of docs (doc_id, text).

    labels (doc_id, quality); per_class and chars bound the labelled rows of each class that are learnt from, and their
    characters.
    """
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("mark")).filter("mark in (0, 1)")
    rows, counts = sample(docs.select("doc_id", "text"), marks, per_class, chars)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, counts))
    scored = by_text(lambda texts: {"score": model.value.score(texts)}, "score double")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("out")).select("doc_id", "held_out", "out.score")
