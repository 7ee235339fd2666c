"""Scalar text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_LIMIT, CHUNK, KEYWORD_LEAST = 5500, 2000, 3
#: Languages by extension.
LANGUAGES = {".py": "python", ".java": "java", ".js": "javascript"}
#: Modules that count as the standard library.
STDLIB = (
    "os", "sys", "re", "json", "math", "time", "datetime", "pathlib",
    "typing", "collections", "itertools", "functools", "io", "abc",
    "logging", "unittest", "subprocess", "shutil", "glob", "copy",
    "random", "hashlib", "base64", "struct", "socket", "threading",
    "multiprocessing", "asyncio", "contextlib", "dataclasses", "enum",
    "string", "textwrap", "traceback", "warnings", "weakref", "gc",
    "inspect", "importlib", "pkgutil", "types", "operator", "heapq",
    "bisect", "array", "queue", "signal", "platform", "tempfile",
    "csv", "configparser", "argparse", "pprint", "http", "urllib",
)


def strip(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """All before the last slash; null for files of the root."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path.contains("/"), found)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def project_name(p: Column) -> Column:
    """The name under which a project is stored: of a URL or path its last segment without .git; always in capitals."""
    return F.upper(F.when(p.contains("/") | p.contains("http"), F.replace(basename(p), F.lit(".git"), F.lit(""))).otherwise(p))


def url_with_user(url: Column) -> Column:
    """A clone URL that has a token only gets the user name ``pat``."""
    return F.regexp_replace(url, r"^(https?://)([^/:@]+)@([^/]+)", "$1pat:$2@$3")


def filename(question: Column) -> Column:
    """The first source-file name in a question, in lower case, or null."""
    found = F.regexp_extract(question, r"(?i)[\w/_-]+\.(py|java|js)\b", 0)
    return F.when(found != "", F.lower(found))


def keywords(question: Column, least: int = KEYWORD_LEAST) -> Column:
    """Words of more than ``least`` letters, in lower case, question marks dropped."""
    words = F.split(strip(F.replace(F.lower(question), F.lit("?"), F.lit(""))), r"(?U)\s+")
    return F.filter(words, lambda k: F.length(k) > least)


def prepared(text: Column, query: bool = False, limit: int = EMBED_LIMIT) -> Column:
    """What is embedded: white space collapsed, the task's prefix, cut to ``limit`` characters with the prefix."""
    prefix = "search_query: " if query else "search_document: "
    return F.substring(F.concat(F.lit(prefix), strip(F.regexp_replace(text, r"(?U)\s+", " "))), 1, limit)


def chunks(text: Column, size: int = CHUNK) -> Column:
    """Pieces of ``size`` characters; none of an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    """A path's extension with its dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def language(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    found = F.lit(None).cast("string")
    for ending, name in LANGUAGES.items():
        found = F.when(extension(path) == ending, F.lit(name)).otherwise(found)
    return found


def import_root(statement: Column, parity: bool = False) -> Column:
    """The root module of an import statement, in lower case; commas are stripped unless ``parity``."""
    root = F.lower(F.regexp_extract(statement, r"^(?U:\s)*\S+\s+([^\s.]*)", 1))  # only the head of a long text is looked at
    return root if parity else F.rtrim(root, F.lit(","))


def import_kind(statement: Column, parity: bool = False) -> Column:
    """internal (relative), stdlib or external."""
    return F.when(strip(statement).startswith("from ."), "internal").when(import_root(statement, parity).isin(list(STDLIB)), "stdlib").otherwise("external")


def decorator(text: Column) -> Column:
    """A decorator's name without @ and arguments."""
    return strip(F.split_part(F.ltrim(strip(text), F.lit("@")), F.lit("("), F.lit(1)))


def contains_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda k: F.contains(F.lower(text), k))


def text_bonus(name: Column, path: Column, content: Column, words: Column) -> Column:
    """10 for a keyword that is the name, 5 if the name has one, 3 the path, 1 the content, else 0."""
    exact = F.exists(words, lambda k: F.lower(name) == k)
    return F.when(exact, 10.0).when(contains_any(name, words), 5.0).when(contains_any(path, words), 3.0).when(contains_any(content, words), 1.0).otherwise(0.0)


def flag(plan: Column, name: str, default: bool) -> Column:
    """A boolean of a plan's JSON object, at its top or one level down; texts count by their meaning."""
    v = F.try_parse_json(plan)
    direct = F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(v, f"$.plan.{name}", "string"), F.try_variant_get(v, f"$.strategy.{name}", "string"))
    return F.coalesce(F.lower(direct).isin("true", "1"), F.lit(default))


def plan(answer: Column) -> Column:
    """struct of search_code, search_history, use_analytics from a model's answer: the outermost braces' JSON; all true where that can't be read."""
    body = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    bad = answer.isNull() | (body == "") | F.try_parse_json(body).isNull()
    fields = {"search_code": True, "search_history": False, "use_analytics": False}
    return F.struct(*[F.when(bad, True).otherwise(flag(body, k, d)).alias(k) for k, d in fields.items()])


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a length is 0."""
    x, y = (F.transform(v, lambda z: z.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def any_of(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")
