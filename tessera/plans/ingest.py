"""Ingestion: a repository's files, documents and history into the warehouse, whole or by what has changed."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import analytics, graph
from tessera.plans import report
from tessera.plans.warehouse import Warehouse
from tessera.sources import embedding, files, git, parser


def ingest(house: Warehouse, path: str, project: str, embedder: embedding.Embedder, url: str = "", parity: bool = False, identity: str = "merge") -> dict:
    """Ingests a working copy, and answers with the project's analytics and patterns.

    With a checkpoint only files that changed since are parsed again, and rows of files that are gone are removed. The checkpoint is written last, so a run that
    fails is repeated in full. ``identity``: ``merge`` keeps the last of a file's entities of one name, ``span`` tells them apart by their first line.
    """
    spark, head, last = house.spark, git.head(path), house.checkpoint(project)
    everything = files.scan(spark, path)
    names = git.changed_files(path, last) if last and head else None
    fresh = everything if names is None else files.changed(everything, spark.createDataFrame([(n,) for n in names], "path string"))
    fresh = fresh.withColumn("project", F.lit(house.normalise(project)))
    parsed = parser.parse_files(fresh.select("project", "path", "content"), parity).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        content = files.lenient_text(F.col("content"))
        file_rows = fresh.select("project", "path", text.basename(F.col("path")).alias("name"), F.lit(url).alias("url"), content.alias("content"))
        new = _embedded(parser.entities(parsed), embedder)
        key = F.concat("name", F.lit(":"), F.col("start_line").cast("string")) if identity == "span" else F.col("name")
        new = new.withColumn("_key", key)
        new = graph.last_by_key(new, ["project", "file", "_key"], "ord").drop("_key")
        if names is not None:
            gone = everything.select(F.col("path"))
            kept = lambda df, c: df.join(gone, df[c] == gone["path"], "left_semi").join(fresh.select(F.col("path").alias("_p")), F.col(c) == F.col("_p"), "left_anti")
            file_rows = kept(house.read("file", project), "path").unionByName(file_rows)
            new = kept(house.read("code_entity", project), "file").unionByName(new)
        house.replace("file", project, file_rows)
        house.replace("code_entity", project, new)
    finally:
        parsed.unpersist()
    _folders_and_edges(house, project, parity)
    if not last:
        _documents(house, project, path, embedder)
    _commits(house, project, path, embedder)
    if head:
        house.save_checkpoint(project, head)
    return {"analytics": report.analytics_report(house, project), "patterns": report.patterns_report(house, project)}


def _embedded(rows: DataFrame, embedder: embedding.Embedder) -> DataFrame:
    """Entities of the embeddable types with vectors; the others, and blank ones, with an empty one."""
    wanted = embedding.embeddable(F.col("type"), F.col("content"))
    out = embedding.embed(rows.withColumn("_text", F.when(wanted, F.col("content"))), embedder, "_text").drop("_text")
    return out.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


def _edge(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.lit(name).alias("edge"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


def node(file: Column, name: Column) -> Column:
    """An entity's name in edges."""
    return F.concat(file, F.lit("#"), name)


def _folders_and_edges(house: Warehouse, project: str, parity: bool) -> None:
    entities, held = house.read("code_entity", project), house.read("file", project)
    folders = held.select(text.dirname(F.col("path")).alias("path")).where("path IS NOT NULL").distinct()
    house.replace("folder", project, folders.withColumn("name", text.basename(F.col("path"))))
    own = entities.where("file IS NOT NULL").withColumn("id", node(F.col("file"), F.col("name")))
    calls = graph.resolve_calls(own.select("project", F.col("id").alias("src"), F.explode("calls").alias("name"), "ord"), own.select("project", "name", F.col("id").alias("dst"), "ord"), parity)
    if parity:
        methods = graph.class_methods(own, "file", "ord", F.col("type") == "class", F.col("type") == "function", "name")
    else:
        methods = graph.class_methods_by_span(own)
    methods = methods.select(node(F.col("file"), F.col("class")).alias("src"), node(F.col("file"), F.col("method")).alias("dst"))
    bases, stubs = graph.inherits(own, parity)
    used, libraries = graph.libraries(own.where("type = 'import'"))
    contained = own.select(F.col("file").alias("src"), F.col("id").alias("dst"))
    parts = [("contains", graph.contains(held)), ("contains_entity", contained), ("has_method", methods), ("calls", calls), ("inherits_from", bases), ("uses_library", used)]
    rows = None
    for name, part in parts:
        rows = _edge(part, name) if rows is None else rows.unionByName(_edge(part, name))
    house.replace("edge", project, rows.distinct(), part="code")
    house.replace("library", project, libraries)
    blank = stubs.select("project", F.lit(None).cast("string").alias("file"), "name", F.lit("class").alias("type"), F.array(F.lit("CodeEntity"), F.lit("class")).alias("labels"), F.lit("").alias("content"), F.array().cast("array<float>").alias("embedding"))
    house.replace("code_entity", project, blank, part="stub")


def _documents(house: Warehouse, project: str, path: str, embedder: embedding.Embedder) -> None:
    found = files.documents(house.spark, path).where(F.col("text").rlike(r"\S"))
    house.replace("document", project, found.select("path", text.basename(F.col("path")).alias("name"), F.lit("documentation").alias("type")))
    pieces = found.select("path", F.posexplode(text.chunks(F.col("text"))).alias("index", "content"))
    house.replace("doc_chunk", project, embedding.embed(pieces, embedder, "content"))


def _commits(house: Warehouse, project: str, path: str, embedder: embedding.Embedder) -> None:
    try:
        rows = git.history(house.spark, path)
    except (OSError, git.subprocess.CalledProcessError):
        return
    rows = rows.withColumn("date_ts", F.to_timestamp("date_raw"))
    new = embedding.embed(rows, embedder, "message").withColumn("project", F.lit(house.normalise(project)))
    house.upsert("commit", project, new, "date_raw")
    commits = house.read("commit", project)
    changes = commits.select("hash", F.explode(F.transform("files_changed", text.slashes)).alias("changed"))
    links = graph.modified(changes, house.read("file", project).select("path", "name")).select(F.col("hash").alias("src"), F.col("path").alias("dst"))
    house.replace("edge", project, _edge(links, "modified"), part="modified")


def recent(house: Warehouse, project: str, limit=3, parity: bool = False) -> DataFrame:
    return analytics.recent(house.read("commit", project), limit, parity)
