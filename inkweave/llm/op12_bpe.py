"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoding as a state machine.

Encoding reads a text once from the left. The vocabulary's own cut (words with the space before them, digits, signs, white
space) gives pretokens; within one the transducer reads byte by byte:

* Its state is the longest end of what was read that begins a token (the states of a suffix automaton of the vocabulary,
  made as they are met), which names all tokens that end here, and the last token of each prefix since the last stable place.
* Exactly one token can end at a place after the encoding of what precedes it: the one that fits the last token there, that
  is, that the merges of both texts together leave as these two tokens. So a prefix costs one step a byte.
* ``lookahead`` is the merge list's sufficient lookahead: a token that ends so many bytes before the last byte read never
  changes, whatever follows. Once twice as much is held, tokens up to there are emitted and their state is forgotten, so the
  memory for a pretoken of any length is a constant of the vocabulary.

Why the lookahead suffices: let x be what was read and xy the whole. The encoding of xy has a place q in x, less than the
longest token (M) before its end, up to which it is the encoding of x[:q]. Where the encoding of x has a token a over q,
from i on, and x[:q] has a token b over i, from k < i on, then b joins at i later (by rank) than whatever a token of the
other encoding joins over b's beginning: both encodings are alike on each side of a place that neither has joined over.
Step by step the ranks of these joins grow strictly, so the steps form a path in a graph of (token, inner place) that has no
circle, and the longest path bounds how far the two encodings differ. ``lookahead`` finds it over all pairs by descending
rank, following from (b, i) all (c, k) of higher rank whose text behind k begins b's text before i.

Decoding joins the tokens' bytes in blocks and feeds them to an incremental UTF-8 decoder, which keeps the bytes of an
unfinished character from one block to the next.

Nulls and empty texts have no tokens; a null id is kept; repeated rows give repeated rows; an empty table gives none; other
columns of documents aren't read. The string of a special token in a text becomes that token, as in the library.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import by_text

#: The cut of the byte-level vocabulary.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
#: Characters below this have their classes written out for the standard library's faster search.
LATIN = 0x250
#: Characters that are cut at a time, and words that a worker keeps (bounds memory, never a result).
BLOCK, KNOWN_WORDS = 1 << 20, 600_000
#: Words longer than this are not kept.
LONG_WORD = 64


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space below LATIN, as the insides of character classes."""
    import regex

    def those(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(kind, chr(c)))

    return those(r"\p{L}"), those(r"\p{N}"), those(r"\p{White_Space}")


class Pretokens:
    """The vocabulary's cut of texts, as lists of strings for a block of the text at a time."""

    def __init__(self):
        import regex

        letters, numbers, spaces = _classes()
        self.latin = re.compile(f" ?[{letters}]+|{CONTRACTIONS}| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
        self.others = re.compile(f"[^\\x00-{re.escape(chr(LATIN - 1))}]")
        space = r"\p{White_Space}"
        self.any = regex.compile(rf" ?\p{{L}}+|{CONTRACTIONS}| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+")

    def of(self, text: str, block: int = BLOCK) -> Iterator[list[str]]:
        find = (self.any if self.others.search(text) else self.latin).findall
        if len(text) <= block:
            yield find(text)
            return
        at, size = 0, block
        while at < len(text):
            found = find(text, at, at + size)
            if at + size < len(text):
                # the last may go on behind the block, and the one before it only ended where the block did
                if len(found) < 3:
                    size *= 2
                    continue
                found = found[:-2]
            yield found
            at, size = at + sum(map(len, found)), block


class Merges:
    """A byte-level BPE vocabulary: its merges, and the transducer over them."""

    def __init__(self, path: str, lookahead: int | None = None):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        kind, cut = stored["model"], stored.get("pre_tokenizer") or {}
        if kind["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or stored.get("normalizer") or kind.get("byte_fallback") or kind.get("ignore_merges") or kind.get("continuing_subword_prefix") or kind.get("end_of_word_suffix"):
            raise ValueError("only byte-level BPE vocabularies without a normaliser are supported")
        added = stored.get("added_tokens", [])
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("special tokens that take neighbouring characters aren't supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letter = {chr(b): b for b in shown}
        letter |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        vocabulary = kind["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(letter[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["merges"]]
        #: (left, right) -> rank of the merge, and what it makes
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank[vocabulary[a], vocabulary[b]] = k
            self.made[vocabulary[a], vocabulary[b]] = vocabulary[a + b]
        self.byte = {self.bytes_of[i]: i for t, i in vocabulary.items() if len(t) == 1}
        #: token -> (rank of its last merge, left, right); single bytes have none
        self.joins: dict[int, tuple[int, int, int]] = {}
        self.id_of = dict(self.byte)
        for i, token in enumerate(self.bytes_of):
            if len(token) > 1:
                parts, last = self.merged(token)
                if parts == [i]:  # else the token's own text never becomes it
                    self.joins[i] = last
                    self.id_of[token] = i
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.sizes = list(map(len, self.bytes_of))
        self.longest = max(map(len, self.id_of))
        self.lookahead = lookahead or self.sufficient_lookahead()
        self.pretokens = Pretokens()
        self._begins = {t[:n] for t in self.id_of for n in range(len(t) + 1)}
        self._known: dict[str, tuple[int, ...]] = {}
        #: token -> token behind it -> whether they fit, as far as asked
        self._fits: list[dict[int, bool]] = [{} for _ in self.bytes_of]
        self._n_fits = 0
        # states as they are met: what they stand for, where each byte leads, the tokens that end there
        self._states, self._number, self._next, self._ends = [b""], {b"": 0}, [{}], [()]

    def merged(self, text: bytes) -> tuple[list[int], tuple[int, int, int] | None]:
        """(tokens that the merges by rank make of a text, the last merge as rank, left, right), the plain way."""
        parts, last = [self.byte[text[k : k + 1]] for k in range(len(text))], None
        while len(parts) > 1:
            rank, at = min((self.rank.get((parts[k], parts[k + 1]), 1 << 60), k) for k in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            last = rank, parts[at], parts[at + 1]
            parts[at : at + 2] = [self.made[parts[at], parts[at + 1]]]
        return parts, last

    def sufficient_lookahead(self) -> int:
        """Bytes behind a token's end after which it never changes: see the module's docstring."""
        inner = []  # (rank of the join at an inner place of a token, text before it, text behind it)
        for i, text in ((i, self.bytes_of[i]) for i in self.joins):
            todo = [(i, 0)]
            while todo:
                token, at = todo.pop()
                if token in self.joins:
                    rank, left, right = self.joins[token]
                    place = at + len(self.bytes_of[left])
                    inner.append((rank, text[:place], text[place:]))
                    todo += [(left, at), (right, place)]
        inner.sort(key=lambda x: -x[0])
        best: dict[bytes, int] = {}
        longest = k = 0
        while k < len(inner):
            same = k
            found = []
            while same < len(inner) and inner[same][0] == inner[k][0]:
                _, before, behind = inner[same]
                reach = len(before) + max((best.get(before[:n], 0) for n in range(1, len(before) + 1)), default=0)
                found.append((behind, reach))
                same += 1
            for behind, reach in found:
                best[behind] = max(best.get(behind, 0), reach)
                longest = max(longest, reach)
            k = same
        return longest + 2 * self.longest

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges of both texts together leave these two tokens.

        The merges of both are undone from the last one back. If a merge over the border was possible at some time and
        comes before the one that was just undone, the two don't fit. Merges of one rank go from left to right.
        """
        bound, tie = 1 << 60, False
        a, b, joins, rank = left, right, self.joins, self.rank
        while True:
            over = rank.get((a, b))
            if over is not None and (over < bound or (tie and over == bound)):
                return False
            last_a, last_b = joins.get(a), joins.get(b)
            if last_a is None and last_b is None:
                return True
            if last_b is None or (last_a is not None and last_a[0] > last_b[0]):
                bound, tie, a = last_a[0], False, last_a[2]
            else:
                bound, tie, b = last_b[0], True, last_b[1]

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest end that begins a token."""
        read = self._states[state] + bytes([byte])
        while read not in self._begins:
            read = read[1:]
        to = self._number.get(read)
        if to is None:
            to = self._number[read] = len(self._states)
            self._states.append(read)
            self._next.append({})
            # tokens that end here, longest first: (length, id)
            self._ends.append(tuple((n, self.id_of[read[-n:]]) for n in range(len(read), 0, -1) if read[-n:] in self.id_of))
        self._next[state][byte] = to
        return to

    def transduce(self, word: bytes) -> Iterator[list[int]]:
        """The tokens of one pretoken, in runs, each as soon as it is stable."""
        held = 2 * self.lookahead
        last = [-1]  # the last token of each prefix from the last stable place on
        before = -1  # the last stable token
        state = 0
        following, ends, fits = self._next, self._ends, self._fits
        for at in range(0, len(word), held):
            for byte in word[at : at + held]:
                to = following[state].get(byte)
                state = self._step(state, byte) if to is None else to
                size = len(last)
                for n, token in ends[state]:
                    if n < size:
                        left = last[size - n]
                    elif n == size:
                        left = before
                        if left < 0:
                            break
                    else:
                        continue
                    fit = fits[left].get(token)
                    if fit is None:
                        fit = self._fitting(left, token)
                    if fit:
                        break
                last.append(token)
            tokens = self._back(last)
            if at + held < len(word):
                stable, k = 0, 0
                for k, token in enumerate(tokens):
                    if stable + len(self.bytes_of[token]) > len(last) - 1 - self.lookahead:
                        break
                    stable += len(self.bytes_of[token])
                tokens, before = tokens[:k], tokens[k - 1] if k else before
                del last[:stable]
                last[0] = -1
            yield tokens

    def _fitting(self, left: int, token: int) -> bool:
        if self._n_fits > 4_000_000:
            for known in self._fits:
                known.clear()
            self._n_fits = 0
        self._n_fits += 1
        fit = self._fits[left][token] = self.fit(left, token)
        return fit

    def _back(self, last: list[int]) -> list[int]:
        """The tokens that lead from the last stable place to the end."""
        at, tokens, sizes = len(last) - 1, [], self.sizes
        while at:
            token = last[at]
            tokens.append(token)
            at -= sizes[token]
        tokens.reverse()
        return tokens

    def stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, block by block."""
        known, specials = self._known, self.specials
        parts = specials.split(text) if specials and specials.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [self.special[part]]
                continue
            for words in self.pretokens.of(part):
                ids = list(map(known.get, words))
                if None in ids:
                    new = {w: self._word(w) for w, found in zip(words, ids, strict=True) if found is None}
                    ids = [new[w] if found is None else found for w, found in zip(words, ids, strict=True)]
                yield list(chain.from_iterable(ids))

    def _word(self, word: str) -> tuple[int, ...]:
        found = self._known.get(word)
        if found is None:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.id_of.get(data)
            found = (whole,) if whole is not None else tuple(chain.from_iterable(self.transduce(data)))
            if len(word) <= LONG_WORD:
                if len(self._known) >= KNOWN_WORDS:
                    self._known.clear()
                self._known[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.stream(text) for i in ids]

    def decoder(self) -> Decoder:
        return Decoder(self.bytes_of)

    def decode(self, ids) -> str:
        decoder = self.decoder()
        ids = list(ids)
        return "".join([decoder.feed(ids[k : k + 65536]) for k in range(0, len(ids), 65536)]) + decoder.end()


class Decoder:
    """Ids to text, block by block: the state is what an unfinished character has so far."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def end(self) -> str:
        return self.machine.decode(b"", True)


_MERGES: dict[str, Merges] = {}


def vocabulary(path: str, lookahead: int | None = None) -> Merges:
    """The vocabulary, read once per process; the file is part of the installation on every machine."""
    if path not in _MERGES:
        _MERGES[path] = Merges(path, lookahead)
    return _MERGES[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""
    lookahead = vocabulary(path).lookahead
    ids = by_text(lambda texts: {"ids": [vocabulary(path, lookahead).encode(t) for t in texts]}, "ids array<int>")
    return docs.select("doc_id", ids("text").alias("out")).select("doc_id", "out.ids")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row of encoded (doc_id, ids); null ids give the empty text."""
    lookahead = vocabulary(path).lookahead

    def run(ids: pd.Series) -> pd.Series:
        v = vocabulary(path, lookahead)
        return pd.Series([v.decode([] if x is None else x) for x in ids], dtype=object)

    return encoded.select("doc_id", F.pandas_udf(run, "string")("ids").alias("text"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass, without a shuffle and without holding a text's ids or its decoded text.

    (doc_id, n_tokens long, ids_sha256 of the little-endian unsigned 32-bit ids, decoded_sha256 of the UTF-8 text).
    """
    lookahead = vocabulary(path).lookahead  # found once, on the driver

    def run(texts: list[str]) -> dict:
        v = vocabulary(path, lookahead)
        counts, of_ids, of_texts = [], [], []
        for text in texts:
            n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), v.decoder()
            for ids in v.stream(text):
                n += len(ids)
                ids_hash.update(little_endian(ids))
                text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
            text_hash.update(decoder.end().encode())
            counts.append(n)
            of_ids.append(ids_hash.hexdigest())
            of_texts.append(text_hash.hexdigest())
        return {"n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_texts}

    made = by_text(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", made("text").alias("out")).select("doc_id", "out.*")


def little_endian(ids: list[int]) -> bytes:
    import sys

    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
