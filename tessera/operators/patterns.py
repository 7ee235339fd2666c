"""Detection of naming, architecture, dependency and inheritance patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: Class-name endings, function-name beginnings.
SUFFIXES = ("Service", "Manager", "Handler", "Repository", "Controller", "Helper", "Builder", "Factory", "Processor", "Client", "Analyzer", "Generator", "Validator", "Parser", "Loader")
PREFIXES = (
    "get_", "set_", "process_", "handle_", "create_", "update_", "delete_", "parse_", "build_", "run_", "execute_", "fetch_", "save_", "load_", "extract_", "compute_", "validate_", "check_",
)
#: How evidence is worded.
LAYERED = "Presenza di classi Service e Repository che separano logica e accesso ai dati"
REST, CLIENT, BUILDER = "Rilevati %s endpoint API nel progetto", "Classi client rilevate: %s", "Classi builder/factory rilevate: %s"


def affixes(names: DataFrame, listed: tuple[str, ...], ending: bool, top: int = 5) -> DataFrame:
    """affix and how many names bear it, the ``top`` most. A name counts for each affix that it bears.

    The list is short, so each row is matched in place: no join and one shuffle of partial counts.
    """
    name = F.col("name") if ending else F.lower("name")
    found = F.filter(text.any_of(listed), lambda a: F.endswith(name, a) if ending else F.startswith(name, a))
    return names.select(F.explode(found).alias("affix")).groupBy("affix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "affix").limit(top)


def naming_style(entities: DataFrame) -> DataFrame:
    """snake_case or camelCase by which more function names follow, with the counts: one row. ``entities``: (name, type)."""
    of = lambda t: F.col("type") == t
    snake = F.count_if(of("function") & F.col("name").contains("_"))
    camel = F.count_if(of("function") & ~F.col("name").contains("_") & F.col("name").rlike(r"^.+\p{Lu}"))
    counted = entities.agg(snake.alias("snake"), camel.alias("camel"), F.count_if(of("class")).alias("classes"), F.count_if(of("function")).alias("functions"))
    return counted.select(F.when(F.col("snake") >= F.col("camel"), "snake_case").otherwise("camelCase").alias("style"), "snake", "camel", "classes", "functions")


def architecture(classes: DataFrame, endpoints: int | Column = 0, by: list[str] | None = None) -> DataFrame:
    """pattern, evidence and confidence: a row for each rule that holds for a group (``by``) of class names.

    Names of a kind are collected as sets of distinct names, which class declarations bound.
    """
    ends = lambda *s: F.regexp_like("name", F.lit("(" + "|".join(s) + ")$"))
    names = lambda alias, *s: F.array_join(F.array_sort(F.collect_set(F.when(ends(*s), F.col("name")))), ", ").alias(alias)
    counts = classes.groupBy(*(by or [])).agg(
        *[F.count_if(ends(s)).alias(s) for s in ("Service", "Repository", "Controller")], names("clients", "Client"), names("builders", "Builder", "Factory")
    )
    n = F.lit(endpoints) if isinstance(endpoints, int) else endpoints
    rule = lambda name, holds, evidence, sure: F.when(holds, F.struct(F.lit(name).alias("pattern"), evidence.alias("evidence"), F.when(sure, "alta").otherwise("media").alias("confidence")))
    rules = F.array(
        rule("Layered Architecture", (F.col("Service") > 0) & (F.col("Repository") > 0), F.lit(LAYERED), F.col("Controller") > 0),
        rule("REST API", n > 0, F.format_string(REST, n.cast("string")), n > 3),
        rule("Client Singleton", F.col("clients") != "", F.format_string(CLIENT, "clients"), F.lit(False)),
        rule("Builder/Factory", F.col("builders") != "", F.format_string(BUILDER, "builders"), F.lit(False)),
    )
    return counts.select(*(by or []), F.inline(F.filter(rules, lambda r: r.isNotNull())))


def external_dependencies(imports: DataFrame, top: int = 10, parity: bool = False) -> DataFrame:
    """library and usage_count (import statements) of root modules of more than one letter, the ``top`` most. ``imports``: (name)."""
    root = text.import_root(F.col("name"), parity)
    return imports.select(root.alias("library")).where(F.length("library") > 1).groupBy("library").agg(F.count(F.lit(1)).alias("usage_count")).orderBy(F.desc("usage_count"), "library").limit(top)


def endpoint_count(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count_if(F.col("type") == "api_endpoint").alias("endpoints"))


def endpoint_list(entities: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """name, content and path of endpoints, by name and path. ``files``: (file, path)."""
    return entities.where("type = 'api_endpoint'").join(files, "file", "left").select("name", "content", "path").orderBy("name", "path", "content").limit(limit)


def inheritance(entities: DataFrame) -> DataFrame:
    """Classes that have base classes."""
    return entities.where(F.col("base_classes").isNotNull() & (F.size("base_classes") > 0))
