"""Hashes of words and word shingles for batches of texts, as flat arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (two rounds of shift and multiplication)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs without white space (space and the ASCII controls 9 to 13), unchanged, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def coded_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all words in order, their codes, the distinct words by code, number of words of each text)."""
    counts = np.array([len(w) for w in texts], dtype=np.int64)
    flat = np.empty(counts.sum(), dtype=object)
    at = 0
    for words in texts:
        flat[at : at + len(words)] = words
        at += len(words)
    codes, distinct = pd.factorize(flat)
    return flat, codes, distinct, counts


def hashes_of(words: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def hashed_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text)."""
    _, codes, distinct, counts = coded_words(texts)
    return (hashes_of(distinct)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)), counts


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive entries (one for each place where a run fits)."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += mixed(hashes[k : k + n] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % 2**64))
    return mixed(out)
