"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in document-partitioned shards, as search engines do: each shard holds, for some ten thousand words of whole texts, the
positions of every term, named by a 64-bit hash. Shards are rows of a Parquet table, one row each, so neither
building nor searching shuffles anything and a source or a group of copies of any size is only more shards. An index is built once and answers any test set: searching a shard, a window's postings
lists are taken from its rarest term there onwards; each list is shifted by its term's offset and intersected with the candidates so far. The
intersection within ``slop`` places gives proximity matches; that at the exact place gives phrase matches.

The test set is broadcast in slices of at most ``SLICE_BYTES`` of its text, each searched in the same index and the findings merged, so what is
broadcast has a bound whatever the test set's size.

Defined results: null and empty texts have no words and no findings; null or empty items have no windows; a null item_id is named ``null``; rows that share an
item_id are one item; repeated document rows are judged each; an empty test set leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Scratch, bound_batches, hashes

WINDOW, SLOP = 8, 2
#: Words after which a shard is closed, and bytes of test texts searched at once.
SHARD_WORDS, SLICE_BYTES = 50_000, 16 << 20
#: Words are runs of the bytes of [0-9a-z] and of all that isn't ASCII; A-Z is lower-cased.
_SEPARATES = np.array([b < 0x80 and not (chr(b).isdigit() or "a" <= chr(b) <= "z") for b in range(256)])

#: A shard's lists are binary: starts and n_words of its documents, its terms in order, bounds of their postings, and positions.
_LISTS = {"starts": "i4", "n_words": "i4", "terms": "i8", "bounds": "i4", "positions": "i4"}
_INDEX = f"shard long, doc_ids array<{{key}}>, {', '.join(f'{c} binary' for c in _LISTS)}"


def words(text: str | bytes | None) -> np.ndarray:
    """The hashes of a text's words."""
    return hashes((text if isinstance(text, bytes) else (text or "").encode()).lower(), _SEPARATES).view("i8")


class TestSet:
    """A slice's vocabulary and windows: ``rows`` (for each different window its terms' places in the vocabulary, -1 where it is shorter) and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        found: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, text in items:
            terms = words(text).tolist()
            for i in range(max(1, len(terms) - window + 1) if terms else 0):
                found.setdefault(tuple(terms[i : i + window]), set()).add(number[name])
        self.vocabulary = np.unique(np.fromiter((t for w in found for t in w), "i8"))
        self.lengths = np.array([len(w) for w in found], "i4")
        self.rows = np.full((len(found), window), -1, "i4")
        for row, w in zip(self.rows, found, strict=True):
            row[: len(w)] = np.searchsorted(self.vocabulary, w)
        self.items = [sorted(x) for x in found.values()]
        self.window = window


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = WINDOW + SLOP + 1) -> DataFrame:
    """The index: a row per shard. ``gap``: places between documents, more than a match may span beyond one."""
    kind = docs.schema[key].dataType
    arrow = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, counts, terms, at = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            t = np.concatenate(terms)
            p = np.arange(len(t), dtype="i4") + np.repeat(np.array(starts, "i4") - np.cumsum([0, *counts[:-1]], dtype="i4"), counts)
            order = np.argsort(t, kind="stable")
            t, p = t[order], p[order]
            heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
            lists = {"starts": starts, "n_words": counts, "terms": t[heads], "bounds": np.append(heads, len(t)), "positions": p}
            blobs = {c: pa.array([np.asarray(lists[c], kind).tobytes()], pa.binary()) for c, kind in _LISTS.items()}
            return pa.RecordBatch.from_pydict({"shard": pa.array([secrets.randbits(63)]), "doc_ids": pa.array([ids], arrow), **blobs})

        for batch in batches:
            for k, x in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                found = words(x.as_py())
                ids.append(k), starts.append(at), counts.append(len(found)), terms.append(found)
                at += len(found) + gap
                if at >= SHARD_WORDS:
                    yield shard()
                    ids, starts, counts, terms, at = [], [], [], [], 0
        if ids:
            yield shard()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, _INDEX.format(key=kind.simpleString()))


def _near(cand: np.ndarray, places: np.ndarray, offset: int, slop: int) -> np.ndarray:
    """The candidates that have a posting within ``slop`` of ``offset`` words on."""
    return cand[np.searchsorted(places, cand + (offset - slop)) < np.searchsorted(places, cand + (offset + slop), "right")]


def find(test: TestSet, terms: np.ndarray, bounds: np.ndarray, positions: np.ndarray, slop: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, starts of exact matches, starts of proximity matches) for the windows of which the shard has anything."""
    if not len(terms) or not len(test.rows):
        return
    at = np.minimum(np.searchsorted(terms, test.vocabulary), len(terms) - 1)
    here = terms[at] == test.vocabulary
    first, last = np.where(here, bounds[at], 0), np.where(here, bounds[at + 1], 0)
    counts = (last - first)[test.rows]
    counts[test.rows < 0] = np.iinfo("i4").max
    for w in np.flatnonzero(counts.min(axis=1)):
        row, rarest = test.rows[w], np.argsort(counts[w, : test.lengths[w]], kind="stable")
        lists = {k: positions[first[row[k]] : last[row[k]]] for k in rarest}
        exact = lists[rarest[0]] - rarest[0]
        near = np.unique(exact[:, None] + np.arange(-slop, slop + 1, dtype="i4"))
        for k in rarest[1:]:
            if not len(near := _near(near, lists[k], k, slop)):
                break
            exact = _near(exact, lists[k], k, 0)
        if len(near):
            yield w, exact, near


def search(index: DataFrame, test, slop: int = SLOP) -> DataFrame:
    """Per indexed document: shard, ordinal (its place there), key, n_words, spans (word places, end exclusive, merged), items, near_items and whole_items (names, sorted). ``test``: a broadcast TestSet."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    names = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = test.value
        for batch in batches:
            for i in range(batch.num_rows):
                starts, n_words, terms, bounds, positions = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in _LISTS.items())
                hits, near, whole = ([set() for _ in starts] for _ in range(3))
                spans: list[list[tuple[int, int]]] = [[] for _ in starts]
                for w, exact, about in find(t, terms, bounds, positions, slop):
                    # A start may lie up to slop words before its document; the gap between documents is wider than that.
                    for d in np.unique(np.searchsorted(starts, about + slop, "right") - 1).tolist():
                        near[d].update(t.items[w])
                    docs = np.searchsorted(starts, exact, "right") - 1
                    for d, p in zip(docs.tolist(), (exact - starts[docs]).tolist(), strict=True):
                        spans[d].append((p, p + int(t.lengths[w])))
                    for d in np.unique(docs).tolist():
                        hits[d].update(t.items[w])
                        if t.lengths[w] == t.window:
                            whole[d].update(t.items[w])
                listed = lambda sets: pa.array([sorted(t.names[x] for x in h) for h in sets], names)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(np.full(len(starts), batch.column("shard")[i].as_py())),
                        "ordinal": pa.array(np.arange(len(starts), dtype="i4")),
                        "key": batch.column("doc_ids")[i].values,
                        "n_words": pa.array(n_words, pa.int64()),
                        "spans": pa.array([merged(s) for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        "items": listed(hits), "near_items": listed(near), "whole_items": listed(whole),
                    }
                )

    return index.mapInArrow(run, f"shard long, ordinal int, key {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>, whole_items array<string>")


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP, scratch: Scratch | None = None) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside an exact match), spans, items, near_items and whole_items (names of items with exact, with exact or near, and with exact matches of a full window)."""
    spark = bound_batches(docs).sparkSession
    scratch = scratch or Scratch(spark, "postings")
    index = scratch.write(build(docs, key, text, window + slop + 1), "index", wide=True)
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    slices = 1 + int(tests.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // SLICE_BYTES
    found = None
    for k in range(slices):
        part = tests if slices == 1 else tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(slices)) == k)
        test = docs.sparkSession.sparkContext.broadcast(TestSet([(r.name, r.text) for r in part.toLocalIterator()], window))
        part = search(index, test, slop)
        found = part if found is None else found.unionByName(part)
    if slices > 1:
        names = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items", "whole_items")]
        found = found.groupBy("shard", "ordinal").agg(F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), *names)
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return found.select(F.col("key").alias(key), "n_words", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), "spans", "items", "near_items", "whole_items")
