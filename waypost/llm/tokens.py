"""Problem 7: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: a backtracking encoder. An Aho-Corasick automaton over the reversed vocabulary gives, in one pass over a piece of text, the
longest token that starts at each of its bytes. The encoder takes the longest one that may follow the last token, falls back to its
longest proper prefix that is a token, and steps back where none may follow. Whether two tokens may stand side by side - whether
BPE merges would leave them so - is read from the table of merges; positions from which no encoding exists are marked and never
tried twice, so the time is linear. The result is the exact merge result. Decoding slices one byte string by an offset table.

Ids must be in the order of the merges, as they are in rank files. The vocabulary file is read on the driver and broadcast; it has a
fixed size (about a megabyte for 50,000 tokens).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = os.environ.get("WAYPOST_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CACHED = 200_000  # words whose ids a worker remembers; only speed depends on it


class BpeTable:
    """The tables of one vocabulary: tokens by id, prefixes, merges, and the automaton."""

    def __init__(self, ranks: bytes):
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines()) if a)
        tokens = [t.decode("latin-1") for _, t in pairs]
        if [i for i, _ in pairs] != list(range(len(pairs))):
            raise ValueError("the ids of a rank file must be 0, 1, 2, ...")
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.bytes = "".join(tokens).encode("latin-1")
        self.offsets = np.concatenate([[0], np.cumsum(self.size)]).tolist()
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in tokens]
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            found = (i, i)
            left = self.shorter[i]
            while left >= 0:
                right = self.ids.get(t[self.size[left] :])
                if right is not None and left < i and right < i and self._may_follow(left, right):
                    found = (left, right)
                    self.merged[found] = i
                    break
                left = self.shorter[left]
            self.parts.append(found)
        self._fits.clear()
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging would keep tokens a and b apart: no merge across their border comes before the merges inside them."""
        bound = len(self.size) + 1
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < bound:
                return False
            if a > b:  # a was merged later than b: look at what stood at the border before
                bound, right = a, self.parts[a][1]
                if right != a:
                    a = right
                    continue
                bound, left = b + 1, self.parts[b][0]
                if left == b:
                    return True
                b = left
            else:
                bound, left = b + 1, self.parts[b][0]
                if left != b:
                    b = left
                    continue
                bound, right = a, self.parts[a][1]
                if right == a:
                    return True
                a = right

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._may_follow(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece; its characters are bytes (latin-1)."""
        n = len(piece)
        longest = [-1] * (n + 1)
        size = self.size
        for end, i in self.automaton.iter(piece[::-1]):
            start = n - 1 - end
            if longest[start] < 0 or size[i] > size[longest[start]]:
                longest[start] = i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + size[token]
                if open_[end] and (last < 0 or self.may_follow(last, token)):
                    out.append(token)
                    at = end
                    token = longest[end]
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    out.pop()
                    at -= size[last]
                    token = last
                    break
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes[self.offsets[i] : self.offsets[i + 1]] for i in ids)


class Encoder:
    """Encodes texts; remembers the ids of frequent words."""

    def __init__(self, table: BpeTable):
        self.table = table
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known, table = self.known, self.table
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                piece = word.encode("utf-8", "replace").decode("latin-1")
                one = table.ids.get(piece)
                ids = [one] if one is not None else table.encode_piece(piece)
                if len(word) <= 40:
                    if len(known) >= CACHED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """The encoder of a vocabulary; made once in a process."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(BpeTable(ranks))
    return _encoders[key]


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; null and empty texts have an empty list. No shuffle."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                lists = [e.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((x for ids in lists for x in ids), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(batches, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens bigint) of every row; 0 for null and empty texts. No shuffle."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(e.encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(batches, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
