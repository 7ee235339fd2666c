"""Commit analytics: one pass, one shuffle on the key that is counted, ordered limits by TakeOrderedAndProject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(limit, default: int) -> int:
    """A limit as an integer, or the default where it is none."""
    try:
        return int(limit)
    except (TypeError, ValueError):
        return default


def hotspots(modified: DataFrame, limit=5) -> DataFrame:
    """path and commits of the files that most commits changed. ``modified``: edges (src commit, dst path); counted before any join, so the shuffle is of partial counts."""
    return modified.groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), "path").limit(whole(limit, 5))


def expertise(commits: DataFrame) -> DataFrame:
    """author and commits, of all authors."""
    return commits.groupBy("author").agg(F.count(F.lit(1)).alias("commits"))


def recent(commits: DataFrame, limit=3, parity: bool = False) -> DataFrame:
    """The latest commits: by instant, or with ``parity`` by the date's text."""
    by = "date_raw" if parity else "date_ts"
    return commits.orderBy(F.col(by).desc_nulls_last(), F.desc("hash")).limit(whole(limit, 3))


def projects(nodes: DataFrame) -> DataFrame:
    return nodes.where("project IS NOT NULL").select("project").distinct()


def central_components(contains: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    """path, entity_count and call_count of the files with most entities and called entities. ``contains``: (path, entity); ``calls``: (entity, called).

    Both sides are distinct edges, so entities are counted before the join and only what they call is counted as distinct.
    """
    entities = contains.where("entity IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias("entity_count"))
    called = contains.join(calls, "entity").select("path", "called").distinct().groupBy("path").agg(F.count("called").alias("call_count"))
    counted = entities.join(called, "path", "left").select("path", "entity_count", F.coalesce("call_count", F.lit(0).cast("long")).alias("call_count"))
    return counted.orderBy(F.desc(F.col("entity_count") + F.col("call_count")), "path").limit(limit)


def structure(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folder and its files' names, sorted; folders without files keep an empty list. ``files``: (folder_key, file)."""
    names = F.array_sort(F.collect_list("file"))
    return folders.join(files, "folder_key", "left").groupBy("folder").agg(names.alias("files"))


def structure_text(folders: DataFrame, files: DataFrame) -> DataFrame:
    return structure(folders, files).select("folder", F.array_join("files", ", ").alias("files"))
