"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

The text is marked as SentencePiece does it (a leading mark, spaces become marks) and cut into marked words: a run of
marks with the characters up to the next mark. No piece reaches over such a cut. The distinct words of a batch that are
not known yet are sorted, which lays them out as a trie in depth-first order; walking down the list keeps one column of
forward states per character of the current prefix, so a prefix that many words share is searched once.

* Unigram models: the state at a position is the best sum of piece scores, as in the usual Viterbi search.
* BPE models: merges by rank give exactly one piece that can end at a position after the encoding of what precedes it,
  namely the one that is compatible with the last piece there (merging the two pieces' text alone gives the same two
  pieces). The forward state is that last piece, and the search is exact, tie rules included.

Characters without a piece become byte pieces (or the unknown piece where a model has none).

Nulls and empty texts have no tokens; a null id is kept; repeated rows give repeated rows; an empty table gives none.
Very long words are walked character by character with a window of the longest piece, so time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import by_text

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that a worker keeps at most; then it starts anew. It bounds memory and never changes a result.
KNOWN_WORDS = 800_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Vocabulary, scores and settings of a SentencePiece model, with the search over sorted words."""

    def __init__(self, path: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.prefix, self.squeeze = 1, True, True
        for number, value in _fields(processor.serialized_model_proto()):
            if number == 2:  # trainer: 3 is the model type, 1 for Unigram and 2 for BPE
                self.kind = dict(_fields(value)).get(3, 1)
            elif number == 3:  # normaliser: 2 a character map, 3 the leading mark, 4 removal of extra spaces
                settings = dict(_fields(value))
                if settings.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.prefix, self.squeeze = bool(settings.get(3, 1)), bool(settings.get(4, 1))
        if self.kind not in (1, 2):
            raise ValueError("only Unigram and BPE models are supported")
        size = processor.get_piece_size()
        self.unknown = processor.unk_id()
        self.byte = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = processor.is_byte(self.byte[0])
        plain = [i for i in range(size) if not (processor.is_control(i) or processor.is_byte(i) or processor.is_unknown(i) or processor.is_unused(i))]
        self.ids = {processor.id_to_piece(i): i for i in plain}
        self.score = {processor.id_to_piece(i): processor.get_score(i) for i in plain}
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.bytes_of = [b""] * size
        for i in plain:
            self.bytes_of[i] = processor.id_to_piece(i).replace(MARK, " ").encode()
        if self.fallback:
            for b, i in enumerate(self.byte):
                self.bytes_of[i] = bytes([b])
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self._fits: dict[str, dict[str, bool]] = {}
        self._n_fits = 0
        self._known: dict[str, tuple[int, ...]] = {}
        # BPE: a piece that its own text doesn't merge to never comes out of a search
        #: of each usable piece of a BPE model, the two pieces that its last merge joins
        self.joins: dict[str, tuple[str, str]] = {}
        usable = set(self.ids)
        if self.kind == 2:
            for piece in self.ids:
                parts, joined = self._merged(piece)
                if len(parts) > 1:
                    usable.discard(piece)
                elif joined:
                    self.joins[piece] = joined
        #: endings of pieces: True for those that are usable pieces themselves
        self.kinds = {p[i:]: p[i:] in usable for p in usable for i in range(len(p))}

    def marked(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """(pieces that the rank-ordered merges make of a text, the two that the last merge joined)."""
        parts, score, joined = list(text), self.score, None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            joined = parts[at], parts[at + 1]
            parts[at : at + 2] = [joined[0] + joined[1]]
        return parts, joined

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging left + right alone gives these two pieces again.

        The merges of both are undone from the last one back. Whenever a merge over the border was possible at that time,
        and would have come before the one just undone, the two don't fit.
        """
        known = self._fits.get(left, {}).get(right)
        if known is None:
            if self._n_fits > 2_000_000:
                self._fits.clear()
                self._n_fits = 0
            self._n_fits += 1
            known = self._fits.setdefault(left, {})[right] = self._fits_by_undoing(left, right)
        return known

    def _fits_by_undoing(self, left: str, right: str) -> bool:
        score, joins = self.score, self.joins
        a, b = left, right
        # merges run from high to low scores, on a tie from left to right
        bound, tie = float("-inf"), False
        while True:
            over = score.get(a + b)
            if over is not None and (over > bound or (tie and over == bound)):
                return False
            last_a, last_b = (score[a] if len(a) > 1 else None), (score[b] if len(b) > 1 else None)
            if last_a is None and last_b is None:
                return True
            if last_b is None or (last_a is not None and last_a < last_b):
                bound, tie, a = last_a, False, joins[a][1]
            else:
                bound, tie, b = last_b, True, joins[b][0]

    def search(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each of the sorted distinct words."""
        return (self._search_merges if self.kind == 2 else self._search_scores)(words)

    def _spelt(self, word: str, cut: list[int]) -> tuple[int, ...]:
        """The ids of the pieces between the cuts that lead back from the word's end."""
        ids, pieces, end = self.ids, [], len(word)
        while end:
            begin = cut[end]
            found = ids.get(word[begin:end])
            if found is not None:
                pieces.append(found)
            elif self.fallback:
                pieces.extend(self.byte[b] for b in reversed(word[begin:end].encode()))
            else:
                pieces.append(self.unknown)
            end = begin
        pieces.reverse()
        return tuple(pieces)

    def _search_merges(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """BPE: of the pieces that end at a position, the longest that fits the last piece before it; states are the last
        pieces (None at the start and after a character without a piece, which fit anything)."""
        out, kinds, fits, ids = {}, self.kinds, self._fits, self.ids
        cut: list[int] = [0]
        last: list[str | None] = [None]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del cut[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                # candidates, shortest first; nothing longer exists once a text is no piece's ending
                begins = []
                i = end - 1
                kind = kinds.get(word[i:end])
                while kind is not None:
                    if kind:
                        begins.append(i)
                    if not i:
                        break
                    i -= 1
                    kind = kinds.get(word[i:end])
                begin = end - 1
                while begins:
                    i = begins.pop()
                    left = last[i]
                    if left is None:
                        begin = i
                        break
                    piece = word[i:end]
                    fit = fits[left].get(piece) if left in fits else None
                    if fit or (fit is None and self._fit(left, piece)):
                        begin = i
                        break
                piece = word[begin:end]
                cut.append(begin)
                last.append(piece if piece in ids else None)
            out[word] = self._spelt(word, cut)
            before = word
        return out

    def _search_scores(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Unigram: states are the best sums of scores."""
        out, ids, score, kinds = {}, self.ids, self.score, self.kinds
        cut: list[int] = [0]
        best: list[float] = [0.0]
        before = ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del cut[same + 1 :], best[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, begin = None, end - 1
                for i in range(end - 1, -1, -1):
                    piece = word[i:end]
                    if piece not in kinds:
                        break
                    if piece in ids and (top is None or best[i] + score[piece] > top):
                        top, begin = best[i] + score[piece], i
                if word[end - 1] not in ids and (top is None or best[end - 1] + self.worst > top):
                    top, begin = best[end - 1] + self.worst, end - 1
                cut.append(begin)
                best.append(top)
            out[word] = self._spelt(word, cut)
            before = word
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [WORDS.findall(self.marked(t)) for t in texts]
        words = set().union(*cut)
        new = words.difference(self._known)
        if len(self._known) + len(new) > KNOWN_WORDS:
            self._known.clear()
            new = words
        self._known.update(self.search(sorted(new)))
        known = self._known.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in cut]

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model, read once per worker process; the file is part of the installation on every machine."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""
    ids = by_text(lambda texts: {"ids": model(model_path).encode(texts)}, "ids array<int>")
    return docs.select("doc_id", ids("text").alias("out")).select("doc_id", "out.ids")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids); null ids give the empty text."""

    def run(ids: pd.Series) -> pd.Series:
        m = model(model_path)
        return pd.Series([m.decode([] if x is None else list(x)) for x in ids], dtype=object)

    return encoded.select("doc_id", F.pandas_udf(run, "string")("ids").alias("text"))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every text in one pass, without a shuffle.

    (doc_id, n_chars, n_tokens long, ids_crc32 long of the little-endian 32-bit ids, decoded_sha256, lossless boolean).
    """

    def run(texts: list[str]) -> dict:
        m = model(model_path)
        ids = m.encode(texts)
        back = [m.decode(x) for x in ids]
        return {
            "n_chars": [len(t) for t in texts],
            "n_tokens": [len(x) for x in ids],
            "ids_crc32": [zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in ids],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
            "lossless": [a == b for a, b in zip(texts, back, strict=True)],
        }

    made = by_text(run, "n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
    return docs.select("doc_id", made("text").alias("out")).select("doc_id", "out.*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
