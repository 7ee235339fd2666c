"""The engine on a repository that the test makes, and the operators on small literal rows."""

import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import analytics, graph, index, patterns, retrieval
from tessera.plans import prompts, service, startup, warehouse
from tessera.sources import embedding, files, git, parser

A = """import numpy
class BaseService:
    def run(self):
        helper()
"""
B = """from .a import BaseService
import os, sys
# a remark
class UserService(BaseService):
    @app.get("/x")
    def get_user(self):
        run()
        print(1)

def helper():
    pass
"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.project_name(lit("https://h/o/my-repo.git"))) == "MY-REPO" and one(spark, text.project_name(lit("demo"))) == "DEMO"
    assert [one(spark, text.url_with_user(lit(u))) for u in ("https://T@h/x", "https://T@h:8443/x", "https://u:p@h/x", "https://h/x")] == ["https://pat:T@h/x", "https://pat:T@h:8443/x", "https://u:p@h/x", "https://h/x"]
    assert one(spark, text.filename(lit("what does query/Planner.PY do"))) == "query/planner.py" and one(spark, text.filename(lit("none"))) is None
    assert one(spark, text.keywords(lit("How does the ingestion work?"))) == ["does", "ingestion", "work"]
    assert one(spark, text.prepared(lit("a \n b"))) == "search_document: a b" and len(one(spark, text.prepared(lit("x" * 9000)))) == 5500
    assert [one(spark, text.import_kind(lit(s))) for s in ("from . import x", "import os.path", "from numpy import array", "import os, sys")] == ["internal", "stdlib", "external", "stdlib"]
    assert one(spark, text.import_kind(lit("import os, sys"), parity=True)) == "external"
    assert one(spark, text.decorator(lit('@app.get("/x")'))) == "app.get"
    for s, n in (("abcdefghij", 3), ("ciao", 2000), ("", 2000), ("abcde", 5)):
        assert one(spark, text.chunks(lit(s), n)) == [s[i : i + n] for i in range(0, len(s), n)]
    words = text.any_of(["embedder"])
    got = [one(spark, text.text_bonus(*map(lit, x), words)) for x in (("Embedder", "", ""), ("CodeEmbedder", "", ""), ("a", "x/embedder.py", ""), ("a", "b", "the embedder"), ("a", "b", "c"))]
    assert got == [10, 5, 3, 1, 0]


@pytest.mark.parametrize(
    ("answer", "flags"),
    [('{"a":{"search_code":false}}', (False, False, False)), ("{}", (True, False, False)), ("no braces", (True, True, True)), ('{"search_code":"false"}', (False, False, False)), ('x {"use_analytics": true} y', (True, False, True)), ('{"a": // c\n1}', (True, True, True))],
)
def test_plans(answer, flags):
    assert tuple(prompts.parse_plan(answer).values()) == flags


def test_analytics_and_limits(spark):
    rows = spark.createDataFrame([("c1", "src/a.py"), ("c2", "src/b.py"), ("c2", "main.py"), ("c3", "src/a.py")], "src string, dst string")
    assert [tuple(r) for r in analytics.hotspots(rows, "none").collect()] == [("src/a.py", 2), ("main.py", 1), ("src/b.py", 1)]
    assert [analytics.whole(x, 5) for x in ("non_un_numero", None, 10)] == [5, 5, 10]
    commits = spark.createDataFrame([("c1", "2024-01-01T10:00:00+02:00"), ("c2", "2024-01-01T09:30:00+00:00"), ("c3", "2024-01-02T00:00:00+00:00")], "hash string, date_raw string").withColumn("date_ts", F.to_timestamp("date_raw"))
    assert [r.hash for r in analytics.recent(commits).collect()] == ["c3", "c2", "c1"]
    assert [r.hash for r in analytics.recent(commits, parity=True).collect()] == ["c3", "c1", "c2"]


def test_graph_operators(spark):
    old = spark.createDataFrame([("k", "old", 9), ("m", "kept", 1)], "key string, v string, ord int")
    new = spark.createDataFrame([("k", "new", 1), ("k", "newest", 2)], "key string, v string, ord int")
    once = graph.upsert(old, new, ["key"], "ord")
    assert {(r.key, r.v) for r in once.collect()} == {("k", "newest"), ("m", "kept")}
    assert {tuple(r) for r in graph.upsert(once, new, ["key"], "ord").collect()} == {tuple(r) for r in once.collect()}
    changes = spark.createDataFrame([(1, "p1/__init__.py"), (2, "a.py"), (3, "none.py")], "hash int, changed string")
    held = spark.createDataFrame([("p1/__init__.py", "__init__.py"), ("p2/__init__.py", "__init__.py"), ("x/xa.py", "xa.py"), ("a.py", "a.py")], "path string, name string")
    assert {tuple(r) for r in graph.modified(changes, held).collect()} == {(1, "p1/__init__.py"), (1, "p2/__init__.py"), (2, "a.py"), (2, "x/xa.py")}


def test_retrieval(spark):
    v = spark.createDataFrame([("v1", "A", [1.0, 0.0, 0.0, 0.0]), ("v2", "B", [0.8, 0.6, 0.0, 0.0]), ("v3", "A", [0.0, 1.0, 0.0, 0.0]), ("v4", "A", [])], "key string, project string, embedding array<float>")
    q = retrieval.literal([1, 0, 0, 0])
    assert [r.key for r in retrieval.knn_postfilter(v, F.col("project") == "A", q, 2, "key").collect()] == ["v1"]
    assert [r.key for r in retrieval.knn_prefilter(v, F.col("project") == "A", q, 2, "key").collect()] == ["v1", "v3"]
    rows = spark.createDataFrame([("a", None, 0, 0.9), ("a", None, 1, 0.4), ("b", "p", 1, 0.4)], "name string, path string, source_rank int, score double")
    assert sorted((r.name, r.score) for r in retrieval.dedupe_first(rows, ["name", "path"], ["source_rank"]).collect()) == [("a", 0.9), ("b", 0.4)]


def test_parser():
    assert [parser.detect_language(p) for p in ("main.py", "Main.java", "app.js")] == ["python", "java", "javascript"]
    with pytest.raises(ValueError):
        parser.detect_language("documento.pdf")
    assert [(e["name"], e["type"]) for e in parser.parse("a.py", "def saluta(nome):\n    return 'ciao ' + nome\n")] == [("saluta", "function")]
    assert ("Motore", "class") in [(e["name"], e["type"]) for e in parser.parse("a.py", "class Motore:\n    def avvia(self):\n        pass\n")]
    assert [(e["name"], e["type"]) for e in parser.parse("d/script.py", "x = 1\ny = 2\nprint(x + y)\n")] == [("script.py", "script")]
    assert parser.parse("a.py", "def principale():\n    helper()\n\ndef helper():\n    pass\n")[0]["calls"] == ["helper"]
    assert parser.parse("a.py", " \n") == []
    b = {e["name"]: e for e in parser.parse("b.py", B)}
    assert b["UserService"]["base_classes"] == ["BaseService"] and b["get_user"]["decorators"] == ["app.get"] and b["get_user"]["calls"] == ["run", "print"]
    assert b["API_Route"]["calls"] == ["get"] and b["Comment"]["type"] == "comment" and b["from .a import BaseService"]["import_type"] == "internal" and b["import os, sys"]["import_type"] == "stdlib"
    assert b["get_user"]["start_line"] == 6 and b["get_user"]["content"].startswith("def get_user")


def test_java_and_javascript():
    java = parser.parse("A.java", 'import java.util.List;\n// note\npublic class Box extends Base {\n  @GetMapping("/x")\n  public int size(int a) {\n    return count(a) + other.more("f(");\n  }\n}\n')
    kinds = {(e["type"], e["name"]) for e in java}
    assert {("import", "import java.util.List;"), ("comment", "Comment"), ("class", "Box"), ("api_endpoint", "API_Route"), ("function", "size")} <= kinds
    assert next(e for e in java if e["name"] == "size")["calls"] == ["count", "more"]
    js = parser.parse("a.js", "import x from 'y';\nfunction go(a) {\n  run(a);\n}\nclass K {\n  meth(b) { other(b); }\n}\napp.get('/x', go);\n")
    assert {(e["type"], e["name"]) for e in js} == {("import", "import x from 'y';"), ("function", "go"), ("function", "meth"), ("api_endpoint", "API_Route")}
    assert next(e for e in js if e["name"] == "go")["calls"] == ["run"]


def test_documents(tmp_path):
    assert files.document_text("nota.txt", b"ciao") == "ciao" and files.document_text("readme.md", b"# t") == "# t" and files.document_text("dati.csv", b"a,b") == ""
    doc = tmp_path / "d.docx"
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>uno</w:t></w:r></w:p><w:p><w:r><w:t>due</w:t></w:r></w:p></w:body></w:document>')
    assert files.document_text("d.docx", doc.read_bytes()) == "uno\ndue" and files.document_text("bad.docx", b"x") == ""


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "x y"), (2, ""), (3, None), (4, "x y")], "id int, t string")
    got = {r.id: r.embedding for r in embedding.embed(rows, embedding.HashEmbedder(16), "t").collect()}
    assert got[2] is None and got[3] is None and got[1] == got[4] and abs(sum(v * v for v in got[1]) - 1) < 1e-5


def test_patterns(spark):
    names = spark.createDataFrame([("UserService", "class"), ("BaseService", "class"), ("ARepository", "class"), ("DbClient", "class"), ("get_user", "function"), ("runAll", "function")], "name string, type string")
    assert [tuple(r) for r in patterns.affixes(names.where("type = 'class'"), patterns.SUFFIXES, True).collect()] == [("Service", 2), ("Client", 1), ("Repository", 1)]
    assert tuple(patterns.naming_style(names).first()) == ("snake_case", 1, 1, 4, 2)
    found = {r.pattern: r.confidence for r in patterns.architecture(names.where("type = 'class'"), endpoints=4).collect()}
    assert found == {"Layered Architecture": "media", "REST API": "alta", "Client Singleton": "media"}


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    """A repository with two commits, ingested."""
    root = tmp_path_factory.mktemp("demo")
    work, house = root / "work", warehouse.Warehouse(spark, str(root / "house"))

    def run(*args):
        subprocess.run(["git", "-C", str(work), "-c", "user.name=ada", "-c", "user.email=a@x", *args], check=True, capture_output=True)

    (work / "src").mkdir(parents=True)
    run("init", "-q")
    (work / "src/a.py").write_text(A), (work / "src/b.py").write_text(B), (work / "main.py").write_text("x = 1\n"), (work / "bad.py").write_text("def (:\n"), (work / "note.md").write_text("the helper explained " * 200)
    (work / "node_modules").mkdir(), (work / "node_modules/x.js").write_text("function no() {}")
    run("add", "-A"), run("commit", "-q", "-m", "first: get_user")
    s = service.Service(house, embedding.HashEmbedder(32), clones=str(root / "clones"))
    s.ingest(str(work), "demo")
    return s, work, run


def test_ingest(demo):
    s, _, _ = demo
    house = s.house
    assert s.projects() == ["DEMO"]
    names = {(r.file, r.name) for r in house.read("code_entity", "demo").where("type IN ('class', 'function', 'script')").collect()}
    assert names == {("src/a.py", "BaseService"), ("src/a.py", "run"), ("src/b.py", "UserService"), ("src/b.py", "get_user"), ("src/b.py", "helper"), ("main.py", "main.py")}
    assert {r.path for r in house.read("file", "demo").collect()} == {"src/a.py", "src/b.py", "main.py", "bad.py"}
    edge = lambda e: {(r.src, r.dst) for r in house.edges("demo", e).collect()}
    assert edge("calls") == {("src/a.py#run", "src/b.py#helper"), ("src/b.py#get_user", "src/a.py#run")}
    assert edge("has_method") == {("src/a.py#BaseService", "src/a.py#run"), ("src/b.py#UserService", "src/b.py#get_user")}
    assert edge("inherits_from") == {("UserService", "BaseService")} and edge("uses_library") == {("src/a.py", "numpy")}
    assert len(house.read("doc_chunk", "demo").collect()) == 3 and house.checkpoint("demo") != ""


def test_service(demo):
    s, work, run = demo
    code, commits = s.search("where is get_user defined?", "demo")
    assert code[0]["name"] == "get_user" and commits[0]["message"] == "first: get_user"
    told = s.ask("what does src/b.py do?", "demo")
    assert told["strategy"]["search_code"] and "class UserService" in told["answer"]
    report = s.onboarding("demo")
    assert report["patterns"]["naming_conventions"]["class_suffixes"] == {"Service": 2} and report["structure"] == [{"folder": "src", "files": ["a.py", "b.py"]}]
    assert "PROGETTO: DEMO" in report["narrative"]
    # What has changed is parsed again, what is gone is removed, the rest stays.
    (work / "src/a.py").write_text(A.replace("helper()", "get_user()")), (work / "main.py").unlink()
    run("add", "-A"), run("commit", "-q", "-m", "second")
    s.update("demo")
    assert {(r.src, r.dst) for r in s.house.edges("demo", "calls").collect()} == {("src/a.py#run", "src/b.py#get_user"), ("src/b.py#get_user", "src/a.py#run")}
    assert {r.path for r in s.house.read("file", "demo").collect()} == {"src/a.py", "src/b.py", "bad.py"}
    s.house.clear("demo")
    assert s.projects() == []
    with pytest.raises(LookupError):
        s.update("demo")


def test_git_source(demo, spark):
    _, work, _ = demo
    spark.dataSource.register(git.GitLog)
    rows = spark.read.format("gitlog").load(str(work)).collect()
    assert rows[-1].author == "ada" and rows[-1].message == "first: get_user" and "src/a.py" in rows[-1].files_changed
    assert git.head("/nonexistent") == ""


def test_stream(spark, tmp_path):
    from tessera.streaming import commits

    house = warehouse.Warehouse(spark, str(tmp_path / "house"))
    (tmp_path / "in").mkdir()
    row = '{"project": "demo", "hash": "%s", "author": "ada", "email": "e", "date_raw": "2024-01-0%dT00:00:00+00:00", "message": "%s", "files_changed": []}\n'
    (tmp_path / "in/1.json").write_text(row % ("c1", 1, "old"))
    commits.upsert_available(house, str(tmp_path / "in"), str(tmp_path / "check"))
    (tmp_path / "in/2.json").write_text(row % ("c1", 2, "new") + row % ("c2", 3, "other"))
    commits.upsert_available(house, str(tmp_path / "in"), str(tmp_path / "check"))
    assert {(r.hash, r.message) for r in house.read("commit", "demo").collect()} == {("c1", "new"), ("c2", "other")}


def test_pdf_without_a_library():
    import zlib

    page = b"BT /F1 12 Tf 72 700 Td (uno \\(due\\)) Tj 0 -14 Td [(tr) 20 (e)] TJ ET"
    packed = zlib.compress(b"BT 72 700 Td <63 69 61 6f> Tj ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n" + page + b"\nendstream\nendobj\n2 0 obj\n<< /Filter /FlateDecode /Length 9 >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    text, error = files.read_document("a.pdf", pdf)
    if error is None and "uno" in text:  # PyPDF2, where it is installed, wants more of a file than this one has
        assert text == "uno (due)\ntre\nciao\n"
    assert files.read_document("b.pdf", b"nothing")[0] == "" and files.read_document("b.pdf", b"nothing")[1]
    assert files.read_document("b.docx", b"x")[1] and files.read_document("c.csv", b"x") == ("", None)


def test_documents_tell_errors(spark, tmp_path):
    (tmp_path / "bad.pdf").write_bytes(b"nothing"), (tmp_path / "a.txt").write_text("ciao")
    got = {r.path: (r.text, r.error is None) for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"bad.pdf": ("", False), "a.txt": ("ciao", True)}


def test_warehouse_versions(spark, tmp_path):
    house = warehouse.Warehouse(spark, str(tmp_path / "house"))
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    house.replace("library", "p", rows("a", "b"))
    before = house.read("library", "p")
    house.append("library", "p", rows("c"))
    house.replace("library", "q", rows("x"))
    assert {r.name for r in before.collect()} == {"a", "b"}  # a reader that began before keeps its version
    house.replace("library", "p", rows("d"))
    assert {r.name for r in before.collect()} == {"a", "b"}
    assert {(r.project, r.name) for r in house.read("library").collect()} == {("P", "c"), ("P", "d"), ("Q", "x")}
    for _ in range(4):
        house.replace("library", "q", rows("y"))
    folders = [p for p in (tmp_path / "house/library").iterdir() if p.is_dir()]
    assert len(list((tmp_path / "house/library").glob("manifest-*.json"))) == warehouse.KEPT and len(folders) <= 2 + warehouse.KEPT
    assert house.projects() == ["P", "Q"]
    assert [r.name for r in house.query("SELECT name FROM library WHERE project = :p ORDER BY name", p="P").collect()] == ["c", "d"]
    with pytest.raises(Exception, match="nowhere"):
        house.query("SELECT * FROM nowhere")
    house.clear("p")
    assert house.projects() == ["Q"]


def test_writers_lose_nothing_of_each_other(spark, tmp_path, monkeypatch):
    """A writer whose number was taken meanwhile puts its change on top of the newer manifest."""
    one, two = (warehouse.Warehouse(spark, str(tmp_path / "house")) for _ in range(2))
    rows = spark.createDataFrame([("a",)], "name string")
    held, raced = one._manifest, []

    def late(table):
        seen = held(table)
        if not raced:
            raced.append(1)
            two.replace("library", "q", rows)
        return seen

    monkeypatch.setattr(one, "_manifest", late)
    one.replace("library", "p", rows)
    assert one.projects() == ["P", "Q"]


def test_vector_index_recall(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    x = (middles[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype("f4")
    rows = [(i, v.tolist(), f"n{i}") for i, v in enumerate(x)] + [(9001, None, "none"), (9002, [], "empty"), (9003, [1.0], "short")]
    vectors = spark.createDataFrame(rows, "key long, embedding array<float>, name string")
    found = index.VectorIndex.build(vectors, str(tmp_path / "index"), "key")
    assert spark.read.parquet(str(tmp_path / "index/rows")).count() == 3000
    kept = index.VectorIndex(spark, str(tmp_path / "index"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 200):
        exact = set(np.argsort(-(unit @ unit[q]), kind="stable")[:10].tolist())
        hit += len(exact & {r.key for r in kept.search(x[q], 10, probes=12).collect()})
    assert hit / 150 >= 0.9
    assert {r.key for r in found.search(x[7], 10, probes=len(found.centroids)).collect()} == set(np.argsort(-(unit @ unit[7]), kind="stable")[:10].tolist())
    assert "PartitionFilters: [_cell" in found.search(x[7], 10)._jdf.queryExecution().toString()
    assert index.VectorIndex.build(vectors.limit(0), str(tmp_path / "none"), "key").search([1.0], 3).collect() == []


def test_startup(spark, tmp_path, capsys):
    s = startup.settings({"TESSERA_WAREHOUSE": "w", "TESSERA_PORT": "81", "EMBED_MODEL": ""}, port=90)
    assert (s.warehouse, s.port, s.embed_model, s.models) == ("w", 90, "nomic-embed-text", "")
    built = startup.build(startup.settings({}, warehouse=str(tmp_path / "house")), spark)
    assert built.projects() == [] and built.llm is None
    assert isinstance(startup.build(startup.settings({"OLLAMA_HOST": "http://h:1"}, warehouse=str(tmp_path / "house")), spark).embedder, embedding.HttpEmbedder)
    assert startup.main(["menu"], port="none") == 1 and "start-up failed" in capsys.readouterr().err
    assert startup.main(["other"]) == 2


def test_menu_and_pattern_cache(demo_again):
    s = demo_again
    answers, said = iter(["1", "who wrote this?", "demo", "3", "demo", "0"]), []
    service.main(s, lambda _: next(answers), said.append)
    assert len(said) == 2 and said[1] == "DEMO updated"
    first = s.patterns("demo")
    assert s.patterns("DEMO") is first
    s.update("demo")
    assert s.patterns("demo") is not first


def test_service_searches_its_indexes(demo_again):
    s = demo_again
    assert s.house.indexed("code", "demo") is None
    s.index_from = 1
    s.update("demo")
    assert s.house.indexed("code", "demo") and s.house.indexed("commit", "demo") and s.house.indexed("chunk", "demo") is None
    found = s.search("where is get_a defined?", "demo")
    assert found[0][0]["name"] == "get_a"
    s.index_from = 1000
    s.update("demo")
    assert s.house.indexed("code", "demo") is None and s.search("where is get_a defined?", "demo") == found


def test_http(demo_again):
    fastapi = pytest.importorskip("fastapi")
    pytest.importorskip("httpx")
    from fastapi.testclient import TestClient

    assert fastapi and TestClient(service.app(demo_again)).get("/projects").json() == {"projects": ["DEMO"]}


@pytest.fixture(scope="module")
def demo_again(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("again")
    work = root / "work"
    work.mkdir()
    git_ = lambda *args: subprocess.run(["git", "-C", str(work), "-c", "user.name=ada", "-c", "user.email=a@x", *args], check=True, capture_output=True)
    (work / "a.py").write_text("class AService:\n    def get_a(self):\n        pass\n")
    git_("init", "-q"), git_("add", "-A"), git_("commit", "-q", "-m", "one")
    s = service.Service(warehouse.Warehouse(spark, str(root / "house")), embedding.HashEmbedder(8), clones=str(root / "clones"))
    s.ingest(str(work), "demo")
    return s
