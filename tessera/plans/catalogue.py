"""The engine's query catalogue: Spark plans and the DuckDB SQL that each must equal.

The driver's tables are no code graph, so each operator is applied to an analogue: parts are files, orders are commits, lineitems are the edges between them, customers
are authors, regions and nations are folders and files, documents are file contents, embeddings are the vector index, events are an ordered log. Every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import analytics, graph, patterns, retrieval
from tessera.plans import report
from tessera.sources import embedding

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


class Tables:
    """The driver's tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL that must give the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return register


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# Analytics -----------------------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS path, p_name AS name, commits FROM (SELECT l_partkey, count(*) AS commits FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) JOIN part ON p_partkey = l_partkey""")
def hotspots_topk(t: Tables) -> DataFrame:
    """Files by commits. Counted and cut to the top before the names are joined."""
    top = analytics.hotspots(t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))
    return t.part.join(F.broadcast(top), F.col("p_partkey") == F.col("path")).select("path", F.col("p_name").alias("name"), "commits")  # five rows


@query("""SELECT o_custkey AS author, count(*) AS commits FROM orders GROUP BY 1""")
def expertise_map(t: Tables) -> DataFrame:
    """A2: commits by author."""
    return analytics.expertise(t.orders.select(F.col("o_custkey").alias("author")))


@query("""SELECT event_id AS hash, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date_raw, event_type AS message FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 3""")
def recent_activity(t: Tables) -> DataFrame:
    """The latest commits."""
    commits = t.events.select(F.col("event_id").alias("hash"), F.col("ts").alias("date_ts"), F.col("event_type").alias("message"))
    return analytics.recent(commits).select("hash", F.date_format("date_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date_raw"), "message")


@query("""SELECT DISTINCT source AS project FROM documents WHERE source IS NOT NULL""")
def distinct_projects(t: Tables) -> DataFrame:
    """A11, F4."""
    return analytics.projects(t.documents.select(F.col("source").alias("project")))


@query("""SELECT l_suppkey AS path, count(DISTINCT l_orderkey) AS entity_count, count(DISTINCT o_custkey) AS call_count FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW' GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 0 ORDER BY count(DISTINCT l_orderkey) + count(DISTINCT o_custkey) DESC, 1 LIMIT 10""")
def central_components(t: Tables) -> DataFrame:
    """Suppliers are files, orders entities, customers what they call."""
    contains = t.lineitem.select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("entity")).distinct()
    calls = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("called"))
    return analytics.central_components(contains, calls)


_STRUCTURE = """SELECT r_name AS folder, coalesce(list_sort(list(n_name) FILTER (WHERE n_name IS NOT NULL)), []) AS files FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"""


def _folders(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.region.select(F.col("r_regionkey").alias("folder_key"), F.col("r_name").alias("folder")), t.nation.select(F.col("n_regionkey").alias("folder_key"), F.col("n_name").alias("file"))


@query(_STRUCTURE)
def project_structure(t: Tables) -> DataFrame:
    """A8, J3, L3."""
    return analytics.structure(*_folders(t))


@query(f"""SELECT folder, array_to_string(files, ', ') AS files FROM ({_STRUCTURE})""")
def structure_string(t: Tables) -> DataFrame:
    """A10, X14."""
    return analytics.structure_text(*_folders(t))


# Patterns ------------------------------------------------------------------------------------------------------------------------------------------------

_SUFFIXES, _PREFIXES = ("ring", "widget", "bolt", "gear", "gizmo", "t"), ("small", "big", "red", "a", "b", "c", "s")


def _values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


@query(f"""SELECT a AS affix, count(*) AS n FROM part JOIN (VALUES {_values(_SUFFIXES)}) v(a) ON ends_with(p_name, a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def naming_suffix(t: Tables) -> DataFrame:
    """A4, A12, X10."""
    return patterns.affixes(t.part.select(F.col("p_name").alias("name")), _SUFFIXES, ending=True)


@query(f"""SELECT a AS affix, count(*) AS n FROM part JOIN (VALUES {_values(_PREFIXES)}) v(a) ON starts_with(lower(p_name), a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def naming_prefix(t: Tables) -> DataFrame:
    """A4, A12, X10."""
    return patterns.affixes(t.part.select(F.col("p_name").alias("name")), _PREFIXES, ending=False)


@query(r"""WITH e AS (SELECT n_name AS name, 'function' AS type FROM nation UNION ALL SELECT p_name, 'class' FROM part UNION ALL SELECT c_name, 'function' FROM customer),
c AS (SELECT count(*) FILTER (WHERE type = 'function' AND contains(name, '_')) AS snake, count(*) FILTER (WHERE type = 'function' AND NOT contains(name, '_') AND regexp_matches(name, '^.+\p{Lu}')) AS camel,
  count(*) FILTER (WHERE type = 'class') AS classes, count(*) FILTER (WHERE type = 'function') AS functions FROM e)
SELECT CASE WHEN snake >= camel THEN 'snake_case' ELSE 'camelCase' END AS style, * FROM c""")
def naming_style(t: Tables) -> DataFrame:
    """A13, X11."""
    of = lambda df, c, kind: df.select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    return patterns.naming_style(of(t.nation, "n_name", "function").unionByName(of(t.part, "p_name", "class")).unionByName(of(t.customer, "c_name", "function")))


_KINDS = {"view": "UserService", "signup": "UserRepository", "click": "PageController", "purchase": "ShopClient", "error": "ErrorFactory"}
_KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())


@query(f"""WITH c AS (SELECT user_id, CASE event_type {_KIND_SQL} END AS name FROM events),
n AS (SELECT user_id, count(*) FILTER (WHERE name LIKE '%Service') s, count(*) FILTER (WHERE name LIKE '%Repository') r, count(*) FILTER (WHERE name LIKE '%Controller') k,
  string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (WHERE name LIKE '%Client') c, string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (WHERE name LIKE '%Factory' OR name LIKE '%Builder') f FROM c GROUP BY 1)
SELECT user_id, 'Layered Architecture' AS pattern, '{patterns.LAYERED}' AS evidence, CASE WHEN k > 0 THEN 'alta' ELSE 'media' END AS confidence FROM n WHERE s > 0 AND r > 0
UNION ALL SELECT user_id, 'REST API', '{patterns.REST.replace("%s", "5")}', 'alta' FROM n
UNION ALL SELECT user_id, 'Client Singleton', '{patterns.CLIENT.replace("%s", "")}' || c, 'media' FROM n WHERE c IS NOT NULL
UNION ALL SELECT user_id, 'Builder/Factory', '{patterns.BUILDER.replace("%s", "")}' || f, 'media' FROM n WHERE f IS NOT NULL""")
def arch_rules(t: Tables) -> DataFrame:
    """A5: a user's events stand for a project's classes; each project has five endpoints."""
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _KINDS.items()])
    return patterns.architecture(t.events.select("user_id", name.alias("name")), endpoints=5, by=["user_id"])


_TOKEN = f"list_extract(string_split_regex({_STRIP.format('text')}, '\\s+'), 2)"


@query(f"""WITH r AS (SELECT rtrim(lower(split_part({_TOKEN}, '.', 1)), ',') AS library FROM documents)
SELECT library, count(*) AS usage_count FROM r WHERE length(library) > 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def external_deps(t: Tables) -> DataFrame:
    """A text's second word stands for an imported module."""
    return patterns.external_dependencies(t.documents.select(F.col("text").alias("name")))


@query("""SELECT count(*) FILTER (WHERE toxic = 1) AS endpoints FROM labels""")
def endpoint_count(t: Tables) -> DataFrame:
    """A7."""
    return patterns.endpoint_count(t.labels.select(F.when(F.col("toxic") == 1, "api_endpoint").alias("type")))


@query("""SELECT l.doc_id AS name, lang AS content, source AS path FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE toxic = 1 ORDER BY 1, 3, 2 LIMIT 10""")
def endpoint_list(t: Tables) -> DataFrame:
    """M8, J4, L5."""
    entities = t.labels.select(F.when(F.col("toxic") == 1, "api_endpoint").alias("type"), F.col("doc_id").alias("name"), F.col("doc_id").alias("file"))
    return patterns.endpoint_list(entities, t.documents.select(F.col("doc_id").alias("file"), F.col("source").alias("path"), F.col("lang").alias("content")))


@query(r"""SELECT doc_id, len(bases)::BIGINT AS n FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^\p{Lu}')) AS bases FROM documents) WHERE len(bases) > 0""")
def array_nonempty(t: Tables) -> DataFrame:
    """A14, F4, X12."""
    bases = F.filter(F.split("text", " "), lambda w: w.rlike(r"^\p{Lu}"))
    return patterns.inheritance(t.documents.select("doc_id", bases.alias("base_classes"))).select("doc_id", F.size("base_classes").cast("long").alias("n"))


# Scans, text and parsing ---------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT 'supplier' AS label, s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment FROM customer""")
def all_label_union(t: Tables) -> DataFrame:
    """Nodes of all labels, absent properties null."""
    a = t.supplier.select(F.lit("supplier").alias("label"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    b = t.customer.select(F.lit("customer").alias("label"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT doc_id AS path, source AS name FROM documents WHERE n_chars <= 100000 AND lang IN ('en', 'de', 'fr')""")
def scan_filter(t: Tables) -> DataFrame:
    """The size and type filters reach the scan."""
    return t.documents.where((F.col("n_chars") <= 100_000) & F.col("lang").isin("en", "de", "fr")).select(F.col("doc_id").alias("path"), F.col("source").alias("name"))


@query(r"""SELECT page_id, CASE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.[^./]+$')) WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' END AS language FROM pages""")
def lang_detect(t: Tables) -> DataFrame:
    """PR2."""
    return t.pages.select("page_id", text.language(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(q, '(?i)[0-9A-Za-z_/-]+\.(py|java|js)\b') THEN lower(regexp_extract(q, '(?i)[0-9A-Za-z_/-]+\.(py|java|js)\b')) END AS file
FROM (SELECT page_id, 'where is ' || replace(url, '.html', '.PY') || ' used?' AS q FROM pages)""")
def file_extract(t: Tables) -> DataFrame:
    """V6, X18."""
    question = F.concat(F.lit("where is "), F.replace("url", F.lit(".html"), F.lit(".PY")), F.lit(" used?"))
    return t.pages.select("page_id", text.filename(question).alias("file"))


@query(r"""SELECT page_id, regexp_replace(u, '^(https?://)([^/:@]+)@([^/]+)', '\1pat:\2@\3') AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://TOKEN@') ELSE replace(url, '://', '://u:p@') END AS u FROM pages)""")
def url_normalize(t: Tables) -> DataFrame:
    """S14."""
    url = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://TOKEN@"))).otherwise(F.replace("url", F.lit("://"), F.lit("://u:p@")))
    return t.pages.select("page_id", text.url_with_user(url).alias("url"))


@query(r"""SELECT page_id, upper(CASE WHEN contains(url, '/') OR contains(url, 'http') THEN replace(list_extract(string_split(url, '/'), -1), '.git', '') ELSE url END) AS project FROM pages""")
def project_normalize(t: Tables) -> DataFrame:
    """X17, X6, X7."""
    return t.pages.select("page_id", text.project_name(F.col("url")).alias("project"))


@query(rf"""SELECT conv_id, turn, list_filter(string_split_regex({_STRIP.format("replace(lower(text), '?', '')")}, '\s+'), lambda k: length(k) > 3) AS keywords FROM conversations""")
def keyword_tokens(t: Tables) -> DataFrame:
    """F12, X9."""
    return t.conversations.select("conv_id", "turn", text.keywords(F.col("text")).alias("keywords"))


@query("""SELECT doc_id, i::INTEGER AS index, substring(text, i * 2000 + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS i FROM documents)""")
def chunk_text(t: Tables) -> DataFrame:
    """Pieces of whole texts, by place."""
    return t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"))).alias("index", "content"))


@query(rf"""SELECT doc_id, substring('search_document: ' || {_STRIP.format("regexp_replace(text, '\\s+', ' ', 'g')".replace(chr(92) * 2, chr(92)))}, 1, 5500) AS prepared FROM documents""")
def embed_prepare(t: Tables) -> DataFrame:
    """E1."""
    return t.documents.select("doc_id", text.prepared(F.col("text")).alias("prepared"))


_STD = ", ".join(f"'{m}'" for m in text.STDLIB)


@query(rf"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'from .' || text WHEN 1 THEN 'import os.path ' || text WHEN 2 THEN 'import json, sys' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN starts_with({_STRIP.format("text")}, 'from .') THEN 'internal' WHEN rtrim(lower(split_part({_TOKEN}, '.', 1)), ',') IN ({_STD}) THEN 'stdlib' ELSE 'external' END AS import_type FROM s""")
def import_classify(t: Tables) -> DataFrame:
    """PR10."""
    kind = F.col("doc_id") % 4
    statement = F.when(kind == 0, F.concat(F.lit("from ."), "text")).when(kind == 1, F.concat(F.lit("import os.path "), "text")).when(kind == 2, F.lit("import json, sys")).otherwise(F.col("text"))
    return t.documents.select("doc_id", text.import_kind(statement).alias("import_type"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Plan: {"search_code": false, "search_history": "true"} done' WHEN 1 THEN props WHEN 2 THEN 'no plan' ELSE '{"plan": {"search_code": "false", "use_analytics": true}}' END AS a FROM events),
b AS (SELECT event_id, regexp_extract(a, '(?s)\\{.*\\}') AS j FROM s),
v AS (SELECT event_id, j = '' OR NOT json_valid(j) AS bad, CASE WHEN json_valid(j) THEN j END AS j FROM b)
SELECT event_id, bad OR coalesce(coalesce(json_extract_string(j, '$.search_code'), json_extract_string(j, '$.plan.search_code')) IN ('true', '1'), true) AS search_code,
  bad OR coalesce(coalesce(json_extract_string(j, '$.search_history'), json_extract_string(j, '$.plan.search_history')) IN ('true', '1'), false) AS search_history,
  bad OR coalesce(coalesce(json_extract_string(j, '$.use_analytics'), json_extract_string(j, '$.plan.use_analytics')) IN ('true', '1'), false) AS use_analytics FROM v""".replace("\\\\", "\\"))
def plan_parse(t: Tables) -> DataFrame:
    """X16, M1, M1b."""
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, 'Plan: {"search_code": false, "search_history": "true"} done').when(kind == 1, F.col("props")).when(kind == 2, "no plan").otherwise('{"plan": {"search_code": "false", "use_analytics": true}}')
    return t.events.select("event_id", text.plan(answer).alias("p")).select("event_id", "p.*")


@query("""SELECT user_id, string_agg('- ' || event_type || ' (' || event_id || ')', chr(10) ORDER BY event_id) AS lines FROM events GROUP BY 1""")
def format_lines(t: Tables) -> DataFrame:
    """M5: ordered text blocks."""
    line = F.concat(F.lit("- "), "event_type", F.lit(" ("), "event_id", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    return t.events.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("lines"))


_TYPES = {"en": "function", "de": "class", "fr": "script", "es": "import"}
_TYPE_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


@query(rf"""SELECT doc_id, type FROM (SELECT doc_id, {_TYPE_SQL} AS type, text FROM documents) WHERE type IN ('function', 'class', 'script', 'api_endpoint') AND regexp_matches(text, '\S')""")
def embeddable(t: Tables) -> DataFrame:
    """what is embedded, by type and content."""
    kind = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in _TYPES.items()])
    return t.documents.select("doc_id", kind.alias("type"), "text").where(embedding.embeddable(F.col("type"), F.col("text"))).select("doc_id", "type")


# Graph building ------------------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1""")
def upsert_last_wins(t: Tables) -> DataFrame:
    """The log's last row of each key."""
    rows = t.events.select("user_id", "event_type", "value", "event_id")
    return graph.last_by_key(rows, ["user_id"], "event_id")


@query("""SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, NULL FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def insert_if_absent(t: Tables) -> DataFrame:
    """W2, J8."""
    return graph.insert_if_absent(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", F.lit(None).cast("int").alias("quality")), ["doc_id"])


@query("""SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem""")
def edge_distinct(t: Tables) -> DataFrame:
    """W4."""
    return graph.edges(t.lineitem, "l_suppkey", "l_partkey")


@query("""SELECT doc_id, source AS project FROM documents WHERE source <> 'src3'""")
def clear_project(t: Tables) -> DataFrame:
    """W5."""
    return graph.clear_project(t.documents.select("doc_id", F.col("source").alias("project")), "src3")


@query("""SELECT user_id, list_sort(list(DISTINCT event_type)) AS labels FROM events GROUP BY 1""")
def labels_union(t: Tables) -> DataFrame:
    """W6, F14."""
    return graph.add_labels(t.events, ["user_id"], "event_type")


_FILES = """(SELECT r_name || '/' || n_name AS path, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'x/' || s_name, s_name FROM supplier)"""
_CHANGES = """(SELECT n_nationkey AS hash, n_name AS changed FROM nation UNION ALL SELECT n_nationkey + 100, substring(n_name, 3) FROM nation UNION ALL SELECT r_regionkey + 1000, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 2000, 'other/' || s_name FROM supplier)"""


@query(f"""SELECT DISTINCT hash, path FROM {_CHANGES} c, {_FILES} f WHERE ends_with(path, changed) OR name = list_extract(string_split(changed, '/'), -1)""")
def modified_or_join(t: Tables) -> DataFrame:
    """The disjunction as a union of equi-joins."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    nested = F.concat("r_name", F.lit("/"), "n_name")
    files = n.select(nested.alias("path"), F.col("n_name").alias("name")).unionByName(t.supplier.select(F.concat(F.lit("x/"), "s_name").alias("path"), F.col("s_name").alias("name")))
    key = F.col("n_nationkey")
    changes = t.nation.select(key.alias("hash"), F.col("n_name").alias("changed")).unionByName(t.nation.select((key + 100).alias("hash"), F.substr("n_name", F.lit(3)).alias("changed")))
    changes = changes.unionByName(n.select((F.col("r_regionkey") + 1000).alias("hash"), nested.alias("changed"))).unionByName(t.supplier.select(F.lit(2000).alias("hash"), F.concat(F.lit("other/"), "s_name").alias("changed")))
    return graph.modified(changes, files)


@query("""SELECT DISTINCT o_custkey AS src, p_partkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""")
def calls_resolve(t: Tables) -> DataFrame:
    """Orders call parts by their keys' text."""
    calls = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("P").alias("project"), F.col("o_custkey").alias("src"), F.col("l_partkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord"))
    entities = t.part.select(F.lit("P").alias("project"), F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("dst"), F.lit(0).cast("long").alias("ord"))
    return graph.resolve_calls(calls, entities)


@query("""WITH h AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM events)
SELECT DISTINCT user_id, c AS class, event_id AS method FROM h WHERE event_type = 'click' AND c IS NOT NULL""")
def class_method_link(t: Tables) -> DataFrame:
    """J7."""
    return graph.class_methods(t.events, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "click", "event_id")


@query("""WITH h AS (SELECT *, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER w AS o, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER w AS k FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, o AS owner, list(event_id ORDER BY event_id) AS calls FROM h WHERE event_type = 'view' AND k IN ('click', 'purchase') GROUP BY 1, 2""")
def call_attribution(t: Tables) -> DataFrame:
    """PR8: views are calls, clicks and purchases own them, signups and errors don't."""
    kind = F.col("event_type")
    return graph.attribute_calls(t.events, "user_id", "event_id", kind == "view", kind != "view", kind.isin("click", "purchase"), "event_id", "event_id")


@query(r"""SELECT doc_id, 'script' AS type, 1::BIGINT AS start_line, len(string_split(text, chr(10)))::BIGINT AS end_line FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND regexp_matches(text, '\S')""")
def script_fallback(t: Tables) -> DataFrame:
    """PR15."""
    return graph.script_fallback(t.documents, t.labels, "doc_id", "text")


@query("""SELECT event_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id > (SELECT max(event_id) - 100 FROM events))""")
def incremental_changed(t: Tables) -> DataFrame:
    """Rows whose key changed after the checkpoint."""
    last = t.events.agg((F.max("event_id") - 100).alias("last"))
    changed = t.events.join(F.broadcast(last), F.col("event_id") > F.col("last")).select("user_id").distinct()  # one row
    return graph.changed_since(t.events, changed, "user_id").select("event_id", "event_type")


@query("""SELECT doc_id, source, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def embed_align(t: Tables) -> DataFrame:
    """Texts with their vectors, by key."""
    return graph.aligned(t.documents.select("doc_id", "source"), t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


@query(rf"""SELECT DISTINCT lang AS project, source AS src, root AS dst FROM (SELECT lang, source, rtrim(lower(split_part({_TOKEN}, '.', 1)), ',') AS root FROM documents WHERE doc_id % 3 = 0) WHERE root <> ''""")
def uses_library(t: Tables) -> DataFrame:
    """Sources are files; a third of the texts are external imports, whose second word is the library."""
    kind = F.when(F.col("doc_id") % 3 == 0, "external").otherwise("stdlib")
    return graph.libraries(t.documents.select(F.col("lang").alias("project"), F.col("source").alias("file"), F.col("text").alias("name"), kind.alias("import_type")))[0]


@query("""SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS src, path AS dst FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages UNION ALL SELECT n_name FROM nation) WHERE contains(path, '/')""")
def folder_contains(t: Tables) -> DataFrame:
    """Folders and their files, from the path alone; files of the root have no folder."""
    return graph.contains(t.pages.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).unionByName(t.nation.select(F.col("n_name").alias("path"))))


@query("""SELECT conv_id AS key, turn AS index, text AS content, role FROM conversations UNION ALL SELECT item_id, 0, text, NULL FROM benchmark UNION ALL SELECT item_id, 0, text, NULL FROM benchmark""")
def append_rows(t: Tables) -> DataFrame:
    """Rows are added however often they are there."""
    new = t.benchmark.select(F.col("item_id").alias("key"), F.lit(0).cast("long").alias("index"), F.col("text").alias("content"))
    return graph.append(graph.append(t.conversations.select(F.col("conv_id").alias("key"), F.col("turn").alias("index"), F.col("text").alias("content"), "role"), new), new)


_SECTIONS = {"suffixes": ("naming_suffix", "affix", "n"), "prefixes": ("naming_prefix", "affix", "n"), "style": ("naming_style", "style", "snake"), "dependencies": ("external_deps", "library", "usage_count")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS section, {name} AS name, {value}::BIGINT AS value FROM ({_ORACLE[q]})" for k, (q, name, value) in _SECTIONS.items()))
def detection_bundle(t: Tables) -> DataFrame:
    """The detectors' findings in one table."""
    return report.detection(**{k: _QUERIES[q](t.spark, t.sf_dir).select(name, value) for k, (q, name, value) in _SECTIONS.items()})


# Filters, projections and limits --------------------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id AS name FROM labels WHERE quality = 1 AND toxic = 1""")
def entities_of_type(t: Tables) -> DataFrame:
    """equality on several properties, which reaches the scan."""
    return t.labels.where((F.col("quality") == 1) & (F.col("toxic") == 1)).select(F.col("doc_id").alias("name"))


@query("""SELECT page_id, upper(url) AS path FROM pages WHERE contains(lower(url), 'example.org')""")
def path_contains(t: Tables) -> DataFrame:
    """A substring in any case."""
    return t.pages.where(text.contains_any(F.col("url"), text.any_of(["example.org"]))).select("page_id", F.upper("url").alias("path"))


@query("""SELECT 'file:' || source AS key, coalesce(l.quality, -1) AS quality, 'File' AS type, 0.4::DOUBLE AS vector_score, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' ELSE 'unknown' END AS state
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def file_rows(t: Tables) -> DataFrame:
    """Aliases, constants, concatenation, defaults and cases."""
    state = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("unknown")
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return joined.select(F.concat(F.lit("file:"), "source").alias("key"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.lit("File").alias("type"), F.lit(0.4).alias("vector_score"), state.alias("state"))


@query("""SELECT p_partkey AS key, p_name AS name, final_score FROM (SELECT *, round(p_size / 100.0::DOUBLE + CASE WHEN lower(p_name) = 'bolt' THEN 10 WHEN contains(lower(p_name), 'bolt') THEN 5 WHEN contains(lower(p_brand), 'bolt') THEN 3
WHEN contains(lower(p_type), 'bolt') THEN 1 ELSE 0 END, 6) AS final_score FROM part) WHERE final_score > 0.15 ORDER BY final_score DESC, p_partkey LIMIT 7""")
def ranked_slice(t: Tables) -> DataFrame:
    """Scores added and compared, the best in a stable order."""
    rows = t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("content"), (F.col("p_size") / F.lit(100.0)).alias("score"), F.lit(0).alias("source_rank"))
    return retrieval.rerank(rows, ["bolt"], 7, key="key").select("key", "name", "final_score")


@query("""SELECT o_custkey AS path, count(*) AS commits FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def limit_guard(t: Tables) -> DataFrame:
    """A limit that is no number is the default."""
    return analytics.hotspots(t.orders.select(F.col("o_custkey").alias("dst")), "non_un_numero")


@query("""SELECT event_id, event_type || '.get' AS decorator FROM events""")
def decorator_names(t: Tables) -> DataFrame:
    """PR14."""
    written = F.concat(F.lit(" @"), "event_type", F.lit('.get("/x('), "event_id", F.lit(')") '))
    return t.events.select("event_id", text.decorator(written).alias("decorator"))


@query(r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, regexp_replace(url, '/[^/]*$', '') AS folder, lower(regexp_extract(url, '\.[^./]+$')) AS extension FROM pages WHERE contains(url, '/')""")
def path_parts(t: Tables) -> DataFrame:
    """The last segment, what is before it, and the extension."""
    return t.pages.where(F.col("url").contains("/")).select("page_id", text.basename(F.col("url")).alias("name"), text.dirname(F.col("url")).alias("folder"), text.extension(F.col("url")).alias("extension"))


@query("""SELECT source AS file, doc_id AS name, embedding FROM documents d LEFT JOIN (SELECT 'src' || (vec_id % 20) AS file, vec_id AS name, embedding FROM embeddings) v ON v.file = d.source AND v.name = d.doc_id""")
def nodes_with_vectors(t: Tables) -> DataFrame:
    """Nodes with the vectors that were made of them, by file and name."""
    vectors = t.embeddings.select(F.concat(F.lit("src"), F.col("vec_id") % 20).alias("file"), F.col("vec_id").alias("name"), "embedding")
    return graph.aligned(t.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("name")), vectors, ["file", "name"])


@query(f"""WITH c AS (SELECT user_id AS hash, arg_max(event_type, event_id) AS message, max(event_id) AS at FROM events GROUP BY 1),
f AS (SELECT c_mktsegment || '/' || c_name AS path, c_name AS name FROM customer), ch AS (SELECT hash, 'x/Customer#' || lpad(hash::VARCHAR, 9, '0') AS changed FROM c WHERE message <> 'view')
SELECT DISTINCT hash, path FROM ch, f WHERE ends_with(path, changed) OR name = list_extract(string_split(changed, '/'), -1)""")
def save_commits(t: Tables) -> DataFrame:
    """Commits upserted by their key, the last one of each linked to the files that it changed."""
    commits = graph.last_by_key(t.events, ["user_id"], "event_id")
    changed = F.concat(F.lit("x/Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    changes = commits.where("event_type <> 'view'").select(F.col("user_id").alias("hash"), changed.alias("changed"))
    return graph.modified(changes, t.customer.select(F.concat("c_mktsegment", F.lit("/"), "c_name").alias("path"), F.col("c_name").alias("name")))


@query(f"""SELECT 'hotspots' AS section, path::VARCHAR AS name, commits::BIGINT AS value FROM ({_ORACLE["hotspots_topk"]}) UNION ALL SELECT 'experts', author::VARCHAR, commits FROM ({_ORACLE["expertise_map"]})
UNION ALL SELECT 'recent', message, hash FROM ({_ORACLE["recent_activity"]})""")
def analytics_bundle(t: Tables) -> DataFrame:
    """Hotspots, experts and recent activity in one table."""
    of = lambda name: _QUERIES[name](t.spark, t.sf_dir)
    return report.detection(hotspots=of("hotspots_topk").select("path", "commits"), experts=of("expertise_map"), recent=of("recent_activity").select("message", "hash"))


# Retrieval -----------------------------------------------------------------------------------------------------------------------------------------------

_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"
_NEAR = f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, {_Q}"


def _vectors(t: Tables) -> DataFrame:
    """The vector index, each row beside the query vector: a table of one row, so its broadcast has a bound."""
    one = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return t.embeddings.join(F.broadcast(one))


@query(f"SELECT vec_id, score FROM ({_NEAR}) ORDER BY score DESC, vec_id LIMIT 10")
def knn_exact(t: Tables) -> DataFrame:
    """V1."""
    return retrieval.knn(_vectors(t), F.col("q"), 10, "vec_id", digits=6).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM ({_NEAR}) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def knn_prefilter(t: Tables) -> DataFrame:
    """V1: the project filter before the limit."""
    return retrieval.knn_prefilter(_vectors(t), F.col("label") == 3, F.col("q"), 20, "vec_id", 6).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM (SELECT * FROM ({_NEAR}) ORDER BY score DESC, vec_id LIMIT 20) WHERE label = 3")
def knn_postfilter(t: Tables) -> DataFrame:
    """V1: the project filter after the limit."""
    return retrieval.knn_postfilter(_vectors(t), F.col("label") == 3, F.col("q"), 20, "vec_id", 6).select("vec_id", "score")


@query(f"""WITH h AS (SELECT vec_id, label, score FROM ({_NEAR}) ORDER BY score DESC, vec_id LIMIT 5)
SELECT DISTINCT h.vec_id, h.score, e.vec_id AS sibling FROM h LEFT JOIN embeddings e ON e.label = h.label AND e.vec_id <> h.vec_id""")
def knn_siblings(t: Tables) -> DataFrame:
    """J11, A9, F9."""
    hits = retrieval.knn(_vectors(t), F.col("q"), 5, "vec_id", digits=6).select("vec_id", "label", "score")
    return retrieval.siblings(hits, t.embeddings, "label", "vec_id").select("vec_id", "score", "sibling")


_WORDS = ("thing", "than", "that")
_WORD_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"


@query(f"""SELECT doc_id, 0.4::DOUBLE AS score FROM documents WHERE len(list_filter({_WORD_LIST}, lambda k: contains(lower(text), k))) > 0 ORDER BY doc_id LIMIT 10""")
def keyword_any(t: Tables) -> DataFrame:
    """V5, F6."""
    return retrieval.keyword_search(t.documents, _WORDS, ["text"], 10, "doc_id").select("doc_id", "score")


@query("""SELECT p_partkey, CASE WHEN lower(p_name) IN ('red widget', 'bolt') THEN 10.0 WHEN contains(lower(p_name), 'red widget') OR contains(lower(p_name), 'bolt') THEN 5.0
WHEN contains(lower(p_brand), 'bolt') OR contains(lower(p_brand), 'red widget') THEN 3.0 WHEN contains(lower(p_type), 'bolt') OR contains(lower(p_type), 'red widget') THEN 1.0 ELSE 0.0 END::DOUBLE AS bonus FROM part""")
def text_bonus(t: Tables) -> DataFrame:
    """V8."""
    return t.part.select("p_partkey", text.text_bonus(F.col("p_name"), F.col("p_brand"), F.col("p_type"), text.any_of(["red widget", "bolt"])).alias("bonus"))


@query("""SELECT source AS path, content, entities, 1.0::DOUBLE AS score FROM (SELECT source, min(text) AS content FROM documents WHERE contains(lower(source), 'src1') GROUP BY 1 ORDER BY 1 LIMIT 1) JOIN
(SELECT source, string_agg(l.doc_id::VARCHAR, ', ' ORDER BY l.doc_id::VARCHAR) AS entities FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1) USING (source)""".replace("SELECT source AS path, content,", "SELECT source AS path, substring(content, 1, 4000) AS content,"))
def file_direct(t: Tables) -> DataFrame:
    """A source is a file, its least text the content, its labelled documents the entities."""
    files = t.documents.where(F.contains(F.lower("source"), F.lit("src1"))).groupBy(F.col("source").alias("path")).agg(F.min("text").alias("content"))
    entities = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("path"), F.col("doc_id").cast("string").alias("entity"))
    return retrieval.file_direct(files, entities, "src1")


@query("""SELECT name, path, source_rank, pos FROM (SELECT *, row_number() OVER (PARTITION BY name, path ORDER BY source_rank, pos) AS n FROM (
SELECT source AS name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS path, 0 AS source_rank, doc_id AS pos FROM documents UNION ALL SELECT 'src1', 'en', 1, page_id FROM pages)) WHERE n = 1""")
def dedupe_first(t: Tables) -> DataFrame:
    """V9."""
    a = t.documents.select(F.col("source").alias("name"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("path"), F.lit(0).alias("source_rank"), F.col("doc_id").alias("pos"))
    b = t.pages.select(F.lit("src1").alias("name"), F.lit("en").alias("path"), F.lit(1).alias("source_rank"), F.col("page_id").alias("pos"))
    return retrieval.dedupe_first(a.unionByName(b), ["name", "path"], ["source_rank", "pos"])


@query("""SELECT DISTINCT l_suppkey AS caller, 0.3::DOUBLE AS score FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) ORDER BY 1 LIMIT 10""")
def caller_expansion(t: Tables) -> DataFrame:
    """Suppliers call parts; the parts of one size were found."""
    calls = t.lineitem.select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("called"))
    return retrieval.callers(calls, t.part.where("p_size = 7").select(F.col("p_partkey").alias("name")), 10)


@query("""SELECT item_id AS hash, round(0.15 + (item_id % 7) / 20.0 + CASE WHEN contains(text, 'thing') OR contains(text, 'there') THEN 0.5 ELSE 0 END, 6) AS final_score FROM benchmark
WHERE round(0.15 + (item_id % 7) / 20.0 + CASE WHEN contains(text, 'thing') OR contains(text, 'there') THEN 0.5 ELSE 0 END, 6) > 0.2 ORDER BY 2 DESC, 1 LIMIT 5""".replace("round(0.15", "round(0.15::DOUBLE").replace("/ 20.0", "/ 20.0::DOUBLE"))
def commit_context_bonus(t: Tables) -> DataFrame:
    """V12, V4, F10."""
    commits = t.benchmark.select(F.col("item_id").alias("hash"), F.col("text").alias("message"), (F.lit(0.15) + (F.col("item_id") % 7) / 20.0).alias("score"))
    return retrieval.commit_bonus(commits, ["thing", "there"]).select("hash", "final_score")


@query("""WITH r AS (SELECT * FROM (SELECT doc_id, source, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents) WHERE pos <= 30),
m AS (SELECT *, source = 'src3' AS e, lang = 'fr' AS c, bool_or(source = 'src3') OVER () AS any_exact, row_number() OVER (PARTITION BY source = 'src3', lang = 'fr' ORDER BY pos) AS o FROM r)
SELECT doc_id, pos::INTEGER AS pos FROM m WHERE CASE WHEN any_exact THEN e OR (NOT c AND o <= 2) ELSE pos <= 3 END""")
def context_filter(t: Tables) -> DataFrame:
    """Of the 30 longest texts, those of one source and two others that are not French."""
    top = t.documents.select("doc_id", "source", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(30)
    ranked = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_chars"), "doc_id")))
    return retrieval.context(ranked, F.col("source") == "src3", F.col("lang") == "fr", "pos").select("doc_id", "pos")


@query(f"""WITH c AS (SELECT doc_id AS key, source AS name, lang AS path, text AS content, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
v AS (SELECT key, name, path, content, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score, 0 AS source_rank FROM c, {_Q} ORDER BY score DESC, key LIMIT 20),
k AS (SELECT key, name, path, content, 0.4::DOUBLE AS score, 1 AS source_rank FROM c WHERE len(list_filter({_WORD_LIST}, lambda k: contains(lower(coalesce(name, '')), k) OR contains(lower(coalesce(path, '')), k) OR contains(lower(coalesce(content, '')), k))) > 0 ORDER BY key LIMIT 10),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM k)) WHERE n = 1),
b AS (SELECT *, round(score + CASE WHEN len(list_filter({_WORD_LIST}, lambda w: lower(name) = w)) > 0 THEN 10 WHEN len(list_filter({_WORD_LIST}, lambda w: contains(lower(name), w))) > 0 THEN 5
  WHEN len(list_filter({_WORD_LIST}, lambda w: contains(lower(path), w))) > 0 THEN 3 WHEN len(list_filter({_WORD_LIST}, lambda w: contains(lower(content), w))) > 0 THEN 1 ELSE 0 END, 6) AS final_score FROM u)
SELECT key, name, path, final_score FROM b WHERE final_score > 0.15 ORDER BY final_score DESC, source_rank, key LIMIT 10""")
def hybrid_search(t: Tables) -> DataFrame:
    """The flagship. Vector and keyword hits of the documents that have vectors, reranked."""
    code = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("name"), F.col("lang").alias("path"), F.col("text").alias("content")).join(t.embeddings.select(F.col("vec_id").alias("key"), "embedding"), "key")
    one = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return retrieval.hybrid(code.join(F.broadcast(one)), F.col("q"), _WORDS, 10).select("key", "name", "path", "final_score")
