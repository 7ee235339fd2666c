"""A project's reports: analytics, patterns and onboarding. Each section is a DataFrame of bounded size; lists are made only here, at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import analytics, patterns
from tessera.plans.warehouse import Warehouse


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def analytics_report(house: Warehouse, project: str, hotspots=5, recent=3) -> dict:
    commits = house.read("commit", project)
    hot = analytics.hotspots(house.edges(project, "modified"), hotspots)
    experts = analytics.expertise(commits).orderBy(F.desc("commits"), "author")
    last = analytics.recent(commits, recent)
    return {
        "hotspots": rows(hot.select(F.col("path").alias("file"), F.col("commits").alias("modifications"))),
        "experts": rows(experts.select("author", F.col("commits").alias("commit_count"))),
        "recent_activity": rows(last.select(F.col("date_raw").alias("date"), "author", F.col("message").alias("msg"))),
    }


def central(house: Warehouse, project: str, limit: int = 10) -> DataFrame:
    contains = house.edges(project, "contains_entity").select(F.col("src").alias("path"), F.col("dst").alias("entity"))
    calls = house.edges(project, "calls").select(F.col("src").alias("entity"), F.col("dst").alias("called"))
    return analytics.central_components(contains, calls, limit)


def patterns_report(house: Warehouse, project: str) -> dict:
    """The five detectors over one project's entities."""
    entities = house.read("code_entity", project).select("name", "type", "file", "base_classes").persist()
    try:
        classes, functions = entities.where("type = 'class'"), entities.where("type = 'function'")
        endpoints = patterns.endpoint_count(entities).first().endpoints
        style = patterns.naming_style(entities).first()
        affixes = lambda df, listed, ending: {r.affix: r.n for r in patterns.affixes(df.select("name"), listed, ending).collect()}
        return {
            "naming_conventions": {
                "class_suffixes": affixes(classes, patterns.SUFFIXES, True), "function_prefixes": affixes(functions, patterns.PREFIXES, False),
                "naming_style": style.style, "total_classes": style.classes, "total_functions": style.functions,
            },
            "architectural_patterns": rows(patterns.architecture(classes.select("name"), int(endpoints))),
            "external_dependencies": rows(patterns.external_dependencies(house.read("code_entity", project).where("type = 'import' AND import_type = 'external'").select("name"))),
            "central_components": rows(central(house, project).select(F.col("path").alias("file"), F.col("entity_count").alias("entities"), F.col("call_count").alias("dependencies"))),
            "inheritance_chains": rows(patterns.inheritance(classes).select(F.col("name").alias("class_name"), F.col("base_classes").alias("inherits_from"), "file").orderBy("class_name", "file")),
        }
    finally:
        entities.unpersist()


def detection(**sections: DataFrame) -> DataFrame:
    """The detectors' findings as rows (section, name, value), of each DataFrame its first two columns."""
    out = None
    for section, df in sections.items():
        name, value = df.columns[:2]
        rows_ = df.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("long").alias("value"))
        out = rows_ if out is None else out.unionByName(rows_)
    return out


def structure(house: Warehouse, project: str) -> list[dict]:
    folders = house.read("folder", project).select(F.col("path").alias("folder_key"), F.col("name").alias("folder"))
    contained = house.edges(project, "contains").select(F.col("src").alias("folder_key"), F.element_at(F.split("dst", "/"), -1).alias("file"))
    return rows(analytics.structure(folders, contained).orderBy("folder"))


def endpoints(house: Warehouse, project: str, limit: int = 10) -> list[dict]:
    listed = patterns.endpoint_list(house.read("code_entity", project), house.read("file", project).select(F.col("path").alias("file"), "path"), limit)
    return rows(listed.select(F.col("content").alias("endpoint"), F.col("path").alias("file")))


def onboarding(house: Warehouse, project: str) -> dict:
    found = analytics_report(house, project)
    return {"project": house.normalise(project), "structure": structure(house, project), **found, "patterns": patterns_report(house, project), "endpoints": endpoints(house, project)}
