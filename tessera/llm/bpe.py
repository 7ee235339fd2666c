"""Byte-level BPE encoding and decoding over a contiguous rank array.

A word's parts lie in one list and the merge ranks of adjacent parts in another. The least rank is found by scanning, its right boundary is deleted,
and the two neighbouring ranks are refreshed. Words are short, so a scan of a contiguous list beats any linked structure; a word of more than
``LONG`` bytes (no space in it) takes the same merges from a heap, as scanning would cost the square of its length.

Texts are processed whole, one Arrow batch at a time; what a Python worker keeps is the vocabulary and a cache of at most ``CACHED`` words.
The tokenizer file is read by the driver and broadcast (its size is checked), so executors need no file of it.

Defined results: a null text is encoded as the empty text, which has no ids; a special token's string inside a text becomes its id; repeated rows are encoded each;
an empty table gives no rows; other columns pass through unchanged unless they bear the name of a result, which replaces them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bound_batches, unused

#: Bytes of a word from which the heap takes over.
LONG = 256
#: Words kept by a Python worker.
CACHED = 300_000
#: Most bytes of a tokenizer file that is broadcast.
MOST_BYTES = 64 << 20
#: Unicode's white space, and the pattern that splits text into words (with that white space spelt out).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = 1 << 60


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Pieces(dict):
    """Encoded pieces by their text after a prefix, filled as they are met."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        found = self.encode(self.prefix + piece)
        if len(piece) <= LONG:
            self[piece] = found
        return found


class ByteBpe:
    """A byte-level BPE vocabulary: ``encode`` gives ids as little-endian unsigned 32-bit integers, ``decode`` takes them."""

    def __init__(self, model: bytes):
        spec = json.loads(model)
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["model"]["type"] != "BPE" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE without normalizer is asked for")
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.token = {i: bytes(chars[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.byte = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        #: (left id << 32 | right id) -> rank, and rank -> id of the merged part.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.split = regex.compile(PATTERN).findall
        self.double = regex.compile(f"[{SPACE}]{{2}}").search
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.words = _Pieces(self._word, "")
        self.spaced = _Pieces(self._run, " ")

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        ids = [self.byte[b] for b in raw]
        ids = self.scan(ids) if len(raw) <= LONG else self.heap(ids)
        return np.array(ids, "<u4").tobytes()

    def scan(self, ids: list[int]) -> list[int]:
        """The merges of a short word."""
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        """The same merges, for long words: a heap of (rank, place), entries checked when taken."""
        rank, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        todo = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if gone[i] or j >= n or rank(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], gone[j], after[i] = self.merged[r], 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := rank(ids[k] << 32 | ids[after[k]])) is not None:
                    heapq.heappush(todo, (s, k))
        return [x for i, x in enumerate(ids) if not gone[i]]

    def _run(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def _plain(self, text: str) -> bytes:
        if self.double(text):
            return self._run(text)
        # Where no two white-space characters meet, every space starts a word, so the pieces between spaces can be looked up whole.
        first, *rest = text.split(" ")
        return self._run(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.parts and any(s in text for s in self.special):
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.parts(text) if p)
        return self._plain(text)

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Special tokens are kept; bytes that are no UTF-8 become U+FFFD; ids out of the vocabulary have no bytes."""
        values = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        token = self.token
        try:
            raw = b"".join(map(token.__getitem__, values.tolist()))
        except KeyError:
            raw = b"".join(token.get(i, b"") for i in values.tolist())
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(model: bytes) -> ByteBpe:
    return ByteBpe(model)


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        model = f.read(MOST_BYTES + 1)
    if len(model) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    return bound_batches(df).sparkSession.sparkContext.broadcast(model)


def _schema(df: DataFrame, added: Sequence[T.StructField]) -> tuple[T.StructType, list[str]]:
    names = {f.name for f in added}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*kept, *added]), [f.name for f in kept]


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the ids of whole texts in ``into`` (array of long)."""
    schema, kept = _schema(df, [T.StructField(into, T.ArrayType(T.LongType()))])
    model = _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for b in batches:
            encoded = [bpe.encode(t) for t in b.column(len(kept)).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in encoded)]).astype("i4")
            flat = np.frombuffer(b"".join(encoded), "<u4").astype("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.ListArray.from_arrays(ends, flat)], schema.names)

    return df.select(*_quoted(kept), F.col(text).alias(unused("text", df))).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for in ``into``; null ids give the empty text."""
    schema, kept = _schema(df, [T.StructField(into, T.StringType())])
    model = _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], "u4")) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(texts, pa.string())], schema.names)

    return df.select(*_quoted(kept), F.col(ids).alias(unused("ids", df))).mapInArrow(run, schema)


def roundtrip(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of the decoded text in UTF-8).

    :func:`encode` and :func:`decode` in one pass, for callers that want figures of both; ids and texts never leave the worker.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema, kept = _schema(df.select(*keep), fields)
    model = _broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(model.value)
        for b in batches:
            n, ids, texts = [], [], []
            for t in b.column(len(kept)):
                encoded = bpe.encode(t.as_py())
                n.append(len(encoded) // 4)
                ids.append(hashlib.sha256(encoded).hexdigest())
                texts.append(hashlib.sha256(bpe.decode(encoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], schema.names)

    return df.select(*_quoted(kept), F.col(text).alias(unused("text", df))).mapInArrow(run, schema)
