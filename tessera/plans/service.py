"""The service's operations: projects, ask, ingest, onboarding, patterns, update. ``app`` serves them over HTTP where FastAPI is installed; ``main`` is a menu."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import retrieval
from tessera.plans import ingest, prompts, report
from tessera.plans.warehouse import Warehouse
from tessera.sources import embedding, git

TOP_K, COMMITS = 5, 20


def _words(question: str) -> list[str]:
    return [w for w in question.lower().replace("?", "").strip().split() if len(w) > text.KEYWORD_LEAST]


@dataclass
class Service:
    house: Warehouse
    embedder: embedding.Embedder = field(default_factory=embedding.HashEmbedder)
    llm: prompts.LLM | None = None
    #: A folder that the driver's git and all executors reach, as a mounted share; below the warehouse if empty.
    clones: str = ""
    #: Rows with vectors from which a project's table gets a vector index when it is ingested; smaller ones are scanned, which is exact.
    index_from: int = 200_000
    #: Patterns by project, until it is ingested again: they change only then, and finding them takes several passes.
    _patterns: dict = field(default_factory=dict)

    def projects(self) -> list[str]:
        return self.house.projects()

    def _candidates(self, project: str) -> tuple[DataFrame, DataFrame]:
        """Code entities and document chunks as candidates: key, name, path, content, type, embedding."""
        e = self.house.read("code_entity", project).where("file IS NOT NULL")
        code = e.select(ingest.node(F.col("file"), F.concat("name", F.lit("@"), F.col("start_line").cast("string"))).alias("key"), "name", F.col("file").alias("path"), "content", "type", "embedding")
        d = self.house.read("doc_chunk", project)
        chunks = d.select(F.concat("path", F.lit("#"), F.col("index").cast("string")).alias("key"), text.basename(F.col("path")).alias("name"), "path", "content", F.lit("DocChunk").alias("type"), "embedding")
        return code, chunks

    def _near(self, kind: str, project: str, rows: DataFrame, vector: list[float], k: int, key: str) -> DataFrame:
        """The ``k`` nearest rows, from the index where there is one."""
        held = self.house.indexed(kind, project)
        return held.search(vector, k) if held else retrieval.knn(rows, retrieval.literal(vector), k, key)

    def _index(self, project: str) -> None:
        code, chunks = self._candidates(project)
        for kind, rows, key in (("code", code, "key"), ("chunk", chunks, "key"), ("commit", self.house.read("commit", project), "hash")):
            many = rows.where(F.size("embedding") > 0).count() >= self.index_from
            self.house.index(kind, project, rows if many else None, key)

    def search(self, question: str, project: str, top_k: int = TOP_K) -> tuple[list[dict], list[dict]]:
        """Ranked code (with callers of what was found behind it) and commits for a question."""
        vector = embedding.embed_one(question, self.embedder)
        if vector is None:
            return [], []
        words = _words(question)
        code, chunks = self._candidates(project)
        columns = ["key", "name", "path", "content", "type", "score", "source_rank"]
        ranked = lambda df, rank: df.withColumn("source_rank", F.lit(rank)).select(*columns)
        found = ranked(self._near("code", project, code, vector, 2 * top_k, "key"), 0)
        if words:
            found = found.unionByName(ranked(retrieval.keyword_search(code, words, ["name", "path", "content"], top_k, "key"), 1))
        found = found.unionByName(ranked(self._near("chunk", project, chunks, vector, top_k, "key"), 2))
        wanted = git.re.search(r"[\w/_-]+\.(py|java|js)\b", question, git.re.I)
        if wanted:
            held = self.house.read("file", project)
            entities = self.house.read("code_entity", project).select(F.col("file").alias("path"), F.col("name").alias("entity"))
            direct = retrieval.file_direct(held.select("path", "content"), entities, wanted[0].lower())
            listed = direct.select(F.concat(F.lit("file:"), "path").alias("key"), text.basename(F.col("path")).alias("name"), "path", "content", F.lit("File").alias("type"), "score")
            found = found.unionByName(ranked(listed, 3))
        best = retrieval.rerank(retrieval.dedupe_first(found, ["key"], ["source_rank"]), words, top_k, key="key")
        rows = report.rows(best.select("key", "name", "path", "content", "type", "final_score"))
        names = sorted({r["name"] for r in rows})
        rows += self._callers(project, rows, names, top_k)
        return rows, self._commits(project, vector, sorted({r["name"] for r in rows}), top_k)

    def _callers(self, project: str, rows: list[dict], names: list[str], top_k: int) -> list[dict]:
        if not names:
            return []
        last = lambda c: F.substring_index(c, "#", -1)
        calls = self.house.edges(project, "calls").select(last("src").alias("caller"), last("dst").alias("called"))
        found = self.house.spark.createDataFrame([(n,) for n in names], "name string")
        who = retrieval.callers(calls, found, top_k).select(F.col("caller").alias("name"))
        entities = self.house.read("code_entity", project).select("name", F.col("file").alias("path"), "content", "type")
        firsts = retrieval.dedupe_first(entities.join(who, "name", "left_semi"), ["name"], ["path"])
        return report.rows(firsts.withColumn("final_score", F.lit(retrieval.CALLER_SCORE)).orderBy("name"))

    def _commits(self, project: str, vector: list[float], names: list[str], top_k: int) -> list[dict]:
        near = self._near("commit", project, self.house.read("commit", project), vector, COMMITS, "hash")
        best = retrieval.commit_bonus(near, names or ["\0"], TOP_K)
        return report.rows(best.select("hash", "author", F.col("date_raw").alias("date"), "message", "final_score"))

    def ask(self, question: str, project: str) -> dict:
        strategy = prompts.plan(question, self.llm)
        figures = report.analytics_report(self.house, project)
        code, commits = self.search(question, project) if strategy["search_code"] or strategy["search_history"] else ([], [])
        told = prompts.answer(question, code if strategy["search_code"] else [], commits if strategy["search_history"] else [], figures, self.patterns(project), self.llm)
        return {"status": "success", "project": self.house.normalise(project), "strategy": strategy, "answer": told}

    def ingest(self, url: str, name: str) -> dict:
        path = git.clone_or_pull(url, f"{self.clones or self.house.root + '/clones'}/{self.house.normalise(name)}")
        try:
            found = ingest.ingest(self.house, path, name, self.embedder, url)
            self._index(name)
        finally:
            self._patterns.pop(self.house.normalise(name), None)
        self._patterns[self.house.normalise(name)] = found["patterns"]
        return found

    def onboarding(self, project: str) -> dict:
        found = report.onboarding(self.house, project)
        return found | {"narrative": prompts.onboarding_narrative(found, self.llm)}

    def patterns(self, project: str) -> dict:
        name = self.house.normalise(project)
        if name not in self._patterns:
            self._patterns[name] = report.patterns_report(self.house, project)
        return self._patterns[name]

    def update(self, project: str) -> dict:
        """Ingests again from the URL that the project's files carry; LookupError if none does."""
        row = self.house.read("file", project).where("url IS NOT NULL AND url <> ''").select("url").orderBy("url").first()
        if row is None:
            raise LookupError(f"no URL is known of {project}")
        self.ingest(row.url, project)
        return {"message": f"{self.house.normalise(project)} updated"}


def app(service: Service):
    """The HTTP interface; needs FastAPI."""
    from fastapi import FastAPI, HTTPException

    api = FastAPI()

    @api.get("/projects")
    def projects():
        return {"projects": service.projects()}

    @api.get("/ask")
    def ask(question: str, project: str):
        return service.ask(question, project)

    @api.post("/ingest")
    def ingest_(url: str, name: str):
        return service.ingest(url, name)

    @api.get("/onboarding")
    def onboarding(project: str):
        return service.onboarding(project)

    @api.get("/patterns")
    def patterns(project: str):
        return service.patterns(project)

    @api.put("/update")
    def update(project: str):
        try:
            return service.update(project)
        except LookupError as e:
            raise HTTPException(404, str(e)) from e

    return api


def main(service: Service, read=input, write=print) -> None:
    """The menu: chat, ingest, update, exit."""
    while (choice := read("1 chat, 2 ingest, 3 update, 0 exit: ").strip()) != "0":
        if choice == "1":
            write(service.ask(read("question: "), read("project: "))["answer"])
        elif choice == "2":
            write(service.ingest(read("url: "), read("name: ")))
        elif choice == "3":
            write(service.update(read("project: "))["message"])
