"""Exact top-k inner products of integer vectors, with norm order and Cauchy-Schwarz pruning of SVD-rotated partial sums.

The singular vectors of all candidates (from their Gram matrix, summed over partitions) give a rotation that puts most of a product into its first coordinates.
Candidates are sorted by descending length, over range partitions, and cut into blocks of at most ``BLOCK`` rows in that order. A first pass takes each query against the block of the longest vectors,
which gives a floor under its k-th best score. The second takes the queries, block by block, along each partition's piece of the order: a block is skipped for a query if its longest length times the
query's cannot reach the floor; else the partial sum over the first coordinates plus the product of the lengths of the rests bounds each score from above, and only
pairs whose bound reaches the floor are multiplied out. Each block that is done raises the floors for the next. Bounds are floating, with a margin for rounding; the scores are integer products of the integer vectors.

The query set is broadcast in slices of at most ``SLICE_BYTES``, each of which passes over all candidates, so nothing that is sent grows with the data and no candidate is
shuffled after it is sorted. A task keeps the k best of each query of the slice and hands them on at its end.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; a query meets only candidates of its own dimension;
rows that bear the query's id are its own and no candidates, and of several the least vector is the query; among other rows, repeated ids are separate candidates; ties go to the smaller id; no other candidate, no row. Scores beyond 64 bits are out of range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Rows of a block of candidates, queries that meet it at once, most rows of a part of the norm order, and bytes of the longest vectors and of the queries that are broadcast at once.
BLOCK, QUERIES, PART, SEED_BYTES, SLICE_BYTES = 4096, 1024, 65536, 8 << 20, 16 << 20
#: Share of the squared lengths that the leading coordinates hold.
LEADING = 0.6
_BLOCKS = "longest double, ids binary, vectors binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long, or null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def rotation(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """The right singular vectors of the rows as columns, largest first, and how many of them hold ``LEADING`` of the squared lengths."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = np.array(b["v"].tolist(), "f8").reshape(-1, dim)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    cells = rows.mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((dim, dim))
    total[cells["i"], cells["j"]] = cells["s"]
    values, vectors = np.linalg.eigh((total + total.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    lead = int(np.searchsorted(np.cumsum(values), LEADING * max(values.sum(), 1e-300)) + 1)
    return np.ascontiguousarray(vectors), min(dim, max(1, lead))


def _blocks(rows: DataFrame, most: int, dim: int) -> DataFrame:
    """Rows (id, v) of each partition as blocks, in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), most):
                x = b.iloc[at : at + most]
                v = np.array(x["v"].tolist(), "i8").reshape(len(x), dim)
                yield pd.DataFrame({"longest": [float(_lengths(v).max())], "ids": [x["id"].to_numpy("i8").tobytes()], "vectors": [v.tobytes()]})

    return rows.mapInPandas(run, _BLOCKS)


def _lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype("f8") ** 2).sum(axis=1))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where all sums stay under 2**53, else in integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    return (q.astype("f8") @ c.astype("f8").T).astype("i8") if bound < 2**53 else q @ c.T


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of each query among parallel arrays, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(query, prepend=query[:1] - 1)) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return pd.DataFrame({"query_id": query[keep], "vec_id": ids[keep], "score": scores[keep]})


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates in ``vectors`` for each row of ``queries``."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    ready = lambda df: df.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    everything = scratch.write(ready(vectors).withColumn("sq", norm), "vectors")
    asked = scratch.write(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    sizes = {r.dim: r.n for r in everything.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for dim, n in sorted(sizes.items()):
        of_dim = F.size("v") == dim
        found = found.unionByName(_search(scratch, everything.where(of_dim), asked.where(of_dim), dim, n, k, block, query_block))
    scratch.drop("vectors", "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(scratch: Scratch, rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int, block: int, query_block: int) -> DataFrame:
    """Candidates (query_id, vec_id, score) that hold each query's k best, for vectors of one dimension."""
    context = rows.sparkSession.sparkContext
    turned = context.broadcast(rotation(rows.select("v"), dim))
    parts = max(-(-n // PART), min(-(-n // 512), 32))
    # Range partitioning on the length (and the id, so equal lengths spread) makes each partition a contiguous piece of the norm order.
    ordered = rows.repartitionByRange(parts, F.desc("sq"), F.asc("id")).sortWithinPartitions(F.desc("sq"), "id").select("id", "v")
    cands = scratch.write(_blocks(ordered, block, dim), f"candidates-{dim}")

    # First pass: each query against the longest vectors, a block of bounded size. The k-th best score is the floor that the second begins with.
    longest = rows.orderBy(F.desc("sq"), "id").limit(max(k + 1, min(block, SEED_BYTES // (8 * dim)))).select("id", "v").toPandas()
    seed = context.broadcast((longest["id"].to_numpy("i8"), np.array(longest["v"].tolist(), "i8").reshape(-1, dim)))

    def floors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid, c = seed.value
        for b in batches:
            q = np.array(b["v"].tolist(), "i8").reshape(len(b), dim)
            scores = np.where(b["id"].to_numpy("i8")[:, None] == cid[None, :], -np.inf, _products(q, c))
            b["floor"] = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(b), -np.inf)
            yield b

    slices = 1 + asked.count() * dim * 8 // SLICE_BYTES
    found = None
    for n in range(slices):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == n).mapInPandas(floors, "id long, v array<long>, floor double").toPandas()
        q = np.array(part["v"].tolist(), "i8").reshape(len(part), dim)
        met = _meet(cands, context.broadcast((part["id"].to_numpy("i8"), q, part["floor"].to_numpy("f8"))), turned, dim, k, query_block)
        met = met if slices == 1 else scratch.write(met, f"found-{dim}-{n}")
        found = met if found is None else found.unionByName(met)
    return found


def _meet(cands: DataFrame, asked, turned, dim: int, k: int, query_block: int) -> DataFrame:
    """Of each partition of candidate blocks the k best (query_id, vec_id, score) of each query that reach its floor. ``asked``: broadcast ids, vectors and floors; ``turned``: broadcast rotation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, lead = turned.value
        qid, q, floor = asked.value
        floor, lengths, qr = floor.copy(), _lengths(q), q @ turn
        rests = _lengths(qr[:, lead:])
        held = pd.DataFrame({"query_id": np.zeros(0, "i8"), "vec_id": np.zeros(0, "i8"), "score": np.zeros(0, "i8")})
        order = np.argsort(qid)
        for row in (row for b in batches for row in b.itertuples()):
            cid = np.frombuffer(row.ids, "i8")
            c = np.frombuffer(row.vectors, "i8").reshape(len(cid), dim)
            margin = 1e-9 * lengths * row.longest + 1e-6
            alive = np.flatnonzero(lengths * row.longest + margin >= floor)  # for the others the whole block is too short
            if not len(alive):
                continue
            cr = c @ turn
            c_rests = _lengths(cr[:, lead:])
            exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim < 2**53
            x, y = (q.astype("f8"), c.astype("f8")) if exact else (q, c)
            parts = [held]
            for some in (alive[s : s + query_block] for s in range(0, len(alive), query_block)):
                bound = qr[some, :lead] @ cr[:, :lead].T + rests[some, None] * c_rests[None, :] + margin[some, None]
                i, j = np.nonzero((bound >= floor[some, None]) & (qid[some, None] != cid[None, :]))
                i = some[i]
                scores = np.concatenate([np.zeros(0, "i8"), *(np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]).astype("i8") for s in range(0, len(i), 65536))])
                keep = scores >= floor[i]
                parts.append(_best(qid[i[keep]], cid[j[keep]], scores[keep], k))
            both = pd.concat(parts)
            held = _best(both["query_id"].to_numpy(), both["vec_id"].to_numpy(), both["score"].to_numpy(), k)
            # Rows of held are in the order of queries, best first: a query's k-th is its new floor.
            last = np.flatnonzero(np.diff(held["query_id"].to_numpy(), append=-1 if not len(held) else held["query_id"].iloc[-1] - 1)) if len(held) else np.zeros(0, int)
            full = last[np.diff(last, prepend=-1) == k]
            at = order[np.searchsorted(qid, held["query_id"].to_numpy()[full], sorter=order)]
            floor[at] = np.maximum(floor[at], held["score"].to_numpy()[full])
        yield held

    return cands.mapInPandas(run, "query_id long, vec_id long, score long")
