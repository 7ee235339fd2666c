"""Node and edge tables as Parquet, partitioned by project, behind versioned manifests.

A project's rows of a table are one or more parts, each a folder of its own. Rows are written to a fresh folder and then a new manifest, which names the folder of each
part, appears under the next number by one rename. Readers take the manifest of the highest number, so they see all of a change or nothing; a writer that finds its number taken reads
the newer manifest and puts its change on top of that, so writers of different parts lose nothing of each other. The last ``KEPT`` manifests and their folders stay, for readers that
began before; a lost executor or driver leaves the manifest that was. (Where a file system's rename replaces a file, as a local disk's does, two writers must not publish in the same instant.)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions.text import project_name
from tessera.operators import graph
from tessera.operators.index import VectorIndex

#: Manifests that stay, and times that a writer tries to publish.
KEPT, TRIES = 3, 20
#: Kinds of vector indexes.
INDEXES = ("code", "chunk", "commit")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @staticmethod
    def normalise(project: str) -> str:
        """The name under which a project is stored; done once, where a name enters."""
        name = project.split("/")[-1].replace(".git", "") if "/" in project or "http" in project else project
        return name.upper()

    def _schema(self, table: str) -> str:
        return schemas.EDGE if table == "edge" else schemas.NODES[table]

    def _numbers(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _named(self, table: str, number: int) -> str:
        return f"{self.root}/{table}/manifest-{number:012d}.json"

    def _load(self, table: str, number: int) -> dict[str, str]:
        return json.loads("".join(r.value for r in self.spark.read.text(self._named(table, number)).collect()))  # one short line

    def _manifest(self, table: str) -> tuple[int, dict[str, str]]:
        """The newest manifest's number, and its folders by part."""
        numbers = self._numbers(table)
        return (numbers[-1], self._load(table, numbers[-1])) if numbers else (0, {})

    def _publish(self, table: str, change: Callable[[dict[str, str]], dict[str, str]]) -> None:
        for _ in range(TRIES):
            number, versions = self._manifest(table)
            fresh, target = self._path(f"{self.root}/{table}/_manifest-{uuid.uuid4().hex}"), self._path(self._named(table, number + 1))
            out = self._fs.create(fresh, True)
            out.write(bytearray(json.dumps(change(versions)).encode()))
            out.close()
            if not self._fs.exists(target) and self._fs.rename(fresh, target):
                self._forget(table)
                return
            self._fs.delete(fresh, False)
        raise RuntimeError(f"{table} is being changed by others all the time")

    def _forget(self, table: str) -> None:
        """Removes manifests but the last few, and the folders that only they name."""
        numbers = self._numbers(table)
        old = numbers[:-KEPT]
        if old:
            named = lambda these: {v for n in these for v in self._load(table, n).values()}
            for version in named(old) - named(numbers[-KEPT:]):
                self._fs.delete(self._path(f"{self.root}/{table}/{version}"), True)
            for n in old:
                self._fs.delete(self._path(self._named(table, n)), False)

    @staticmethod
    def _project(part: str) -> str:
        return part.partition("\t")[0]

    def read(self, table: str, project: str | None = None, part: str | None = None) -> DataFrame:
        """A table, one project's rows of it, or one part of these: other folders aren't listed."""
        name = project and self.normalise(project)
        wanted = lambda key: name is None or (self._project(key) == name if part is None else key == f"{name}\t{part}")
        paths = [v for key, v in self._manifest(table)[1].items() if wanted(key)]
        if not paths:
            return self.spark.createDataFrame([], self._schema(table))
        return self.spark.read.schema(self._schema(table)).parquet(*[f"{self.root}/{table}/{p}" for p in paths])

    def replace(self, table: str, project: str, rows: DataFrame, part: str = "") -> None:
        """Puts rows in the place of a part of the project's rows."""
        name, version = self.normalise(project), uuid.uuid4().hex
        columns = [c.strip().split()[0] for c in self._schema(table).split(", ")]
        rows = rows.withColumn("project", F.lit(name))
        absent = {c: F.lit(None) for c in columns if c not in rows.columns}
        typed = [F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], self._schema(table)).schema]
        rows.withColumns(absent).select(*typed).write.parquet(f"{self.root}/{table}/{version}")
        self._publish(table, lambda versions: versions | {f"{name}\t{part}": version})

    def upsert(self, table: str, project: str, rows: DataFrame, order: str) -> None:
        """Last write wins by the table's merge key."""
        keys = schemas.KEYS[table]
        self.replace(table, project, graph.upsert(self.read(table, project, ""), rows.withColumn("project", F.lit(self.normalise(project))), keys, order))

    def append(self, table: str, project: str, rows: DataFrame) -> None:
        """Adds rows as a part of their own; nothing that is there is read or written again."""
        self.replace(table, project, rows, part=uuid.uuid4().hex)

    def clear(self, project: str) -> None:
        """Removes a project from every table."""
        name = self.normalise(project)
        for table in [*schemas.NODES, "edge", *(f"index-{k}" for k in INDEXES)]:
            if any(self._project(k) == name for k in self._manifest(table)[1]):
                self._publish(table, lambda versions: {k: v for k, v in versions.items() if self._project(k) != name})

    def projects(self) -> list[str]:
        return sorted({self._project(k) for table in schemas.NODES for k in self._manifest(table)[1]})

    def edges(self, project: str, edge: str) -> DataFrame:
        return self.read("edge", project).where(F.col("edge") == edge)

    def index(self, kind: str, project: str, rows: DataFrame | None, key: str = "key") -> None:
        """Puts a vector index of rows (with ``embedding``) in the place of a project's; none if rows is None."""
        name, version, table = self.normalise(project), uuid.uuid4().hex, f"index-{kind}"
        if rows is not None:
            VectorIndex.build(rows, f"{self.root}/{table}/{version}", key)
            self._publish(table, lambda versions: versions | {f"{name}\t": version})
        elif f"{name}\t" in self._manifest(table)[1]:
            self._publish(table, lambda versions: {k: v for k, v in versions.items() if k != f"{name}\t"})

    def indexed(self, kind: str, project: str) -> VectorIndex | None:
        """A project's vector index, if it has one."""
        version = self._manifest(f"index-{kind}")[1].get(f"{self.normalise(project)}\t")
        return VectorIndex(self.spark, f"{self.root}/index-{kind}/{version}") if version else None

    def query(self, statement: str, **parameters) -> DataFrame:
        """A SQL statement over the tables by their names, with named parameters (``:name``). Errors reach the caller."""
        for table in [*schemas.NODES, "edge"]:
            self.read(table).createOrReplaceTempView(table)
        return self.spark.sql(statement, args=parameters)

    def checkpoint(self, project: str) -> str:
        """The last ingested commit, or an empty text."""
        row = self.read("project_meta", project).select("last_commit").first()
        return row.last_commit if row and row.last_commit else ""

    def save_checkpoint(self, project: str, commit: str) -> None:
        self.replace("project_meta", project, self.spark.createDataFrame([(self.normalise(project), commit)], schemas.PROJECT_META))


__all__ = ["Warehouse", "project_name"]
