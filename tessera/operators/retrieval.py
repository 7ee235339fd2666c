"""Retrieval: exact vector neighbours, keywords, and the hybrid ranking of both.

Every limit has a total order, so plans are TakeOrderedAndProject: each task keeps its best and only those travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

CODE_LEAST, COMMIT_LEAST, KEYWORD_SCORE, FILE_SCORE, CALLER_SCORE, COMMIT_BONUS = 0.15, 0.20, 0.4, 1.0, 0.3, 0.5


def knn(vectors: DataFrame, query: Column, k: int, key: str, vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """``vectors`` with their cosine to one query vector, the ``k`` nearest, ties by key. Rows without vector take no part.

    The query vector is an expression (a literal, or a column of a one-row table that was joined), so the scan stays one pass with no exchange before the top k.
    """
    similarity = text.cosine(F.col(vector), query)
    scored = vectors.where(F.size(vector) > 0).withColumn("score", similarity if digits is None else F.round(similarity, digits)).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), key).limit(k)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn_prefilter(vectors: DataFrame, keep: Column, query: Column, k: int, key: str, digits: int | None = None) -> DataFrame:
    """The k nearest of the rows for which ``keep`` holds."""
    return knn(vectors.where(keep), query, k, key, digits=digits)


def knn_postfilter(vectors: DataFrame, keep: Column, query: Column, k: int, key: str, digits: int | None = None) -> DataFrame:
    """Of the k nearest of all rows, those for which ``keep`` holds."""
    return knn(vectors, query, k, key, digits=digits).where(keep)


def siblings(hits: DataFrame, members: DataFrame, group: str, key: str) -> DataFrame:
    """``hits`` with ``sibling``: a row for each other member of a hit's group, null where it has none. Rows, as a group may be any part of the table."""
    other = members.select(F.col(group).alias("_group"), F.col(key).alias("sibling")).distinct()
    return hits.join(other, (F.col(group) == F.col("_group")) & (F.col(key) != F.col("sibling")), "left").drop("_group")


def keyword_search(rows: DataFrame, words: Sequence[str], columns: Sequence[str], k: int, key: str) -> DataFrame:
    """Rows of which one of the columns contains a keyword, with a constant score, the first ``k`` by key."""
    listed = text.any_of([w.lower() for w in words])
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(text.contains_any(F.coalesce(F.col(c), F.lit("")), listed), F.lit(False))
    return rows.where(hit).withColumn("score", F.lit(KEYWORD_SCORE)).orderBy(key).limit(k)


def dedupe_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; null keys are one key."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def rerank(rows: DataFrame, words: Sequence[str], k: int, least: float = CODE_LEAST, key: str = "name") -> DataFrame:
    """Adds the text bonus, drops scores up to ``least``, and keeps the ``k`` best. ``rows``: name, path, content, score, source_rank, key."""
    bonus = text.text_bonus(F.coalesce("name", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("content", F.lit("")), text.any_of(words))
    scored = rows.withColumn("final_score", F.round(F.col("score") + bonus, 6)).where(F.col("final_score") > least)
    return scored.orderBy(F.desc("final_score"), "source_rank", key).limit(k)


def file_direct(files: DataFrame, entities: DataFrame, wanted: str, path: str = "path", content: str = "content", length: int = 4000) -> DataFrame:
    """The first file whose path contains ``wanted``: path, the head of its content, its entities' names and score 1."""
    one = files.where(F.contains(F.lower(F.col(path)), F.lit(wanted.lower()))).orderBy(path).limit(1)
    names = F.array_join(F.array_sort(F.collect_list("entity")), ", ")
    listed = one.join(entities, path, "left").groupBy(path).agg(F.first(F.substring(F.col(content), 1, length)).alias("content"), names.alias("entities"))
    return listed.withColumn("score", F.lit(FILE_SCORE))


def callers(calls: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(caller, score) of those that call a found name and aren't found themselves, the first ``k`` by name. ``calls``: (caller, called); ``found``: (name)."""
    hit = calls.join(found.select(F.col("name").alias("called")), "called", "left_semi").select("caller").distinct()
    return hit.join(found.select(F.col("name").alias("caller")), "caller", "left_anti").withColumn("score", F.lit(CALLER_SCORE)).orderBy("caller").limit(k)


def commit_bonus(commits: DataFrame, names: Sequence[str], k: int = 5, least: float = COMMIT_LEAST, key: str = "hash") -> DataFrame:
    """Adds a bonus where the message contains a found name, drops scores up to ``least``, keeps the ``k`` best."""
    listed = text.any_of(names)
    named = F.exists(listed, lambda n: F.contains(F.col("message"), n))
    scored = commits.withColumn("final_score", F.round(F.col("score") + F.when(named, COMMIT_BONUS).otherwise(0.0), 6))
    return scored.where(F.col("final_score") > least).orderBy(F.desc("final_score"), key).limit(k)


def context(rows: DataFrame, exact: Column, chunk: Column, order: str) -> DataFrame:
    """What a prompt shows: all rows that match exactly and the first two others that are no chunks; without an exact one the first three.

    ``rows`` is a ranked list (at most 2 * top_k rows), so one window over it is no burden.
    """
    all_ = Window.partitionBy(F.lit(1))
    marked = rows.withColumns({"_exact": exact, "_chunk": chunk}).withColumn("_any", F.max(F.col("_exact").cast("int")).over(all_) == 1)
    other = F.row_number().over(Window.partitionBy("_exact", "_chunk").orderBy(order))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order))
    ranked = marked.withColumns({"_other": other, "_place": place})
    keep = F.when(F.col("_any"), F.col("_exact") | (~F.col("_chunk") & (F.col("_other") <= 2))).otherwise(F.col("_place") <= 3)
    return ranked.where(keep).drop("_exact", "_chunk", "_any", "_other", "_place")


def hybrid(code: DataFrame, query: Column, words: Sequence[str], k: int, key: str = "key", code_k: int | None = None, keyword_k: int | None = None) -> DataFrame:
    """Vector hits (2k) and keyword hits (k), the first of each key, reranked. ``code``: key, name, path, content, embedding."""
    near = knn(code, query, code_k or 2 * k, key, digits=6).withColumn("source_rank", F.lit(0))
    by_word = keyword_search(code, words, ["name", "path", "content"], keyword_k or k, key).withColumn("source_rank", F.lit(1))
    both = near.unionByName(by_word).select(key, "name", "path", "content", "score", "source_rank")
    return rerank(dedupe_first(both, [key], ["source_rank"]), words, k, key=key)
