"""Graph building: upserts and edges as set operations over whole tables.

Node upserts are one aggregation by merge key; edges are equi-joins followed by a distinct. Nothing is written row by row, and no edge depends on the order
of insertion unless a parity flag asks for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: of all rows that bear it the one of the greatest ``order``; incoming rows come after existing ones."""
    rows = existing.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    others = [c for c in rows.columns if c not in (*keys, "_gen")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("_gen", order)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def last_by_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins within one table."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows and those incoming ones whose key is new."""
    return existing.unionByName(incoming.join(existing, list(keys), "left_anti"))


def edges(rows: DataFrame, src: str, dst: str) -> DataFrame:
    return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both, however equal; absent columns are null. On disk the new rows are a part of their own."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def clear_project(table: DataFrame, project: str) -> DataFrame:
    """A table without a project. On disk this is the removal of one partition."""
    return table.where(~F.col("project").eqNullSafe(project))


def add_labels(rows: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """keys and labels, all labels that its rows bear, sorted."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def modified(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (hash, path) where a file's path ends with the changed path or its name is the changed path's name.

    A path with a slash that another ends with has the same base name, so the equi-join on names finds these; only changed paths of the root (without
    slash) can end paths of other names, and only they take part in the second join, on every ending of the file's base name that is in the list.
    ``changes``: (hash, changed); ``files``: (path, name).
    """
    base = text.basename(F.col("changed"))
    by_name = changes.withColumn("name", base).join(files, "name").select("hash", "path")
    roots = changes.where(~F.col("changed").contains("/"))
    file = text.basename(F.col("path"))
    endings = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.length(file)), lambda i: F.substring(file, i, F.length(file)))).alias("changed"))
    by_ending = roots.join(endings, "changed").select("hash", "path")
    return by_name.unionByName(by_ending).distinct()


def contains(files: DataFrame) -> DataFrame:
    """Folder to file, from the path alone; files of the root have no folder."""
    return files.select(text.dirname(F.col("path")).alias("src"), F.col("path").alias("dst")).where("src IS NOT NULL").distinct()


def resolve_calls(calls: DataFrame, entities: DataFrame, parity: bool = False) -> DataFrame:
    """Distinct (src, dst) of callers and every entity of the project that bears a called name.

    ``calls``: (project, src, name, ord), a row per call; ``entities``: (project, name, dst, ord). With ``parity`` only entities stored no later than the caller count.
    A name that is called or borne often (``get``) is first reduced to its distinct callers and bearers, and what it joins to is split by the adaptive planner.
    """
    if parity:
        found = calls.withColumnRenamed("ord", "_at").join(entities, ["project", "name"]).where(F.col("ord") <= F.col("_at"))
    else:
        found = calls.select("project", "src", "name").distinct().join(entities.select("project", "name", "dst").distinct(), ["project", "name"])
    return found.select("src", "dst").distinct()


def class_methods(rows: DataFrame, file: str, order: str, is_class: Column, is_function: Column, name: str) -> DataFrame:
    """(file, class, method): a function belongs to the last class before it in its file."""
    so_far = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("class", F.last(F.when(is_class, F.col(name)), ignorenulls=True).over(so_far))
    return held.where(is_function & F.col("class").isNotNull()).select(file, "class", F.col(name).alias("method")).distinct()


def class_methods_by_span(entities: DataFrame) -> DataFrame:
    """(file, class, method) by containment of lines: a method lies inside its class. ``entities``: (project, file, name, type, start_line, end_line)."""
    c = entities.where("type = 'class'").select("project", "file", F.col("name").alias("class"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    f = entities.where("type = 'function'").select("project", "file", F.col("name").alias("method"), "start_line", "end_line")
    inside = (F.col("start_line") >= F.col("_a")) & (F.col("end_line") <= F.col("_b"))
    return f.join(c, ["project", "file"]).where(inside).select("project", "file", "class", "method").distinct()


def attribute_calls(rows: DataFrame, file: str, order: str, is_call: Column, is_entity: Column, owns: Column, owner: str, callee: str) -> DataFrame:
    """(file, owner, calls): each call goes to the last entity before it in its file, and is dropped if that entity can't own calls."""
    so_far = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(is_entity, F.struct(F.col(owner).alias("owner"), owns.alias("owns"))), ignorenulls=True).over(so_far)
    held = rows.withColumn("_last", last).where(is_call & F.col("_last.owns"))
    calls = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(callee).alias("callee")))), lambda s: s["callee"])
    return held.groupBy(file, F.col("_last.owner").alias("owner")).agg(calls.alias("calls"))


def inherits(entities: DataFrame, parity: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (project, src, dst) from classes to their bases, and stub rows (project, name) for bases that the project lacks. Without ``parity`` only classes are bases."""
    children = entities.where("type = 'class'").select("project", F.col("name").alias("src"), F.explode("base_classes").alias("dst"))
    known = (entities if parity else entities.where("type = 'class'")).select("project", F.col("name").alias("dst")).distinct()
    return children.distinct(), children.select("project", "dst").distinct().join(known, ["project", "dst"], "left_anti").withColumnRenamed("dst", "name")


def libraries(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (project, src file, dst library) of external imports, and the library nodes. ``imports``: (project, file, name, import_type)."""
    used = imports.where("import_type = 'external'").select("project", F.col("file").alias("src"), text.import_root(F.col("name")).alias("dst")).where("dst <> ''").distinct()
    return used, used.select("project", F.col("dst").alias("name")).distinct()


def script_fallback(files: DataFrame, significant: DataFrame, key: str, content: str) -> DataFrame:
    """Files that have content but no significant entity, as one script entity each: key, type, start_line, end_line."""
    lines = F.size(F.split(F.col(content), "\n")).cast("long")
    return files.join(significant, key, "left_anti").where(F.col(content).rlike(r"\S")).select(key, F.lit("script").alias("type"), F.lit(1).cast("long").alias("start_line"), lines.alias("end_line"))


def changed_since(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the list of changes."""
    return rows.join(changed, key, "left_semi")


def aligned(texts: DataFrame, vectors: DataFrame, key: str | list[str]) -> DataFrame:
    """Texts with their vectors by key, null where one has none; positions are never matched."""
    return texts.join(vectors, key, "left")
