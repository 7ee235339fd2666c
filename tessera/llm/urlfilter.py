"""URL filters by a temporal list join, in DataFrame expressions only.

Lists change over time. Their dated entries (add or remove a pattern from a day on) become validity intervals: a pattern's later entry ends the earlier one.
The as-of join meets captures with intervals row by row: on the host, of which the distinct ones have been matched with the lists' domains before, where the path has the pattern's prefix and
``valid_from <= fetched_at < valid_to``. Of a capture's active entries the most specific (longest pattern)
decides, ``allow`` before ``block`` where two are equally specific; a capture with none is kept.

Hosts are few beside captures and are reduced by partial aggregation first; a host's domains go as deep as the lists' own patterns do, so each entry can match. What hosts match is a written table, which Spark
broadcasts only within its own threshold; beyond it a host that many captures share is split by the adaptive planner. The entries that a capture meets are reduced in an
aggregation of two numbers and the best one, so no list of them is ever held, however many entries a host has.

Defined results: a null or hostless URL has no keys and is kept with no rule; a null fetch time matches nothing; an entry with a null date, pattern or action is ignored;
of entries of one list and pattern that bear the same time the last action in alphabetical order counts (``remove`` before ``add`` is thus overruled); repeated captures are evaluated each; empty lists keep everything;
columns of captures pass through unless they bear a result's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

RESULTS = ("verdict", "rule_list", "rule_pattern", "rule_since", "n_active")
#: Production lists: (list, effect, pattern, action, day). A pattern is a domain (and all below it), or a host and path prefix.
ENTRIES = (
    ("spam", "block", "spam-farm.example.org", "add", "2024-02-01"),
    ("spam", "block", "spam-farm.example.org", "remove", "2024-05-15"),
    ("spam", "block", "spam-farm.example.org", "add", "2024-08-01"),
    ("spam", "block", "m.example.net", "add", "2024-03-10"),
    ("hosts", "block", "tionsh.example.net", "add", "2024-01-20"),
    ("hosts", "block", "tionsh.example.net", "remove", "2024-09-30"),
    ("hosts", "block", "thther.example.org", "add", "2024-06-01"),
    ("hosts", "block", "example.org", "add", "2024-10-01"),
    ("hosts", "block", "example.org", "remove", "2024-11-15"),
    ("partners", "allow", "tionsh.example.net/en", "add", "2024-04-01"),
    ("partners", "allow", "tionsh.example.net/en", "remove", "2024-07-01"),
    ("partners", "allow", "blog.ththth.example.org", "add", "2024-01-01"),
    ("takedown", "block", "tiontion.example.com/fr", "add", "2024-02-15"),
    ("takedown", "block", "m.tiontion.example.com/de", "add", "2024-05-01"),
    ("takedown", "block", "m.tiontion.example.com/de", "remove", "2024-05-02"),
    ("takedown", "block", "ththon.example.com", "add", "2024-12-01"),
)


def entries(spark: SparkSession, rows: Sequence[tuple] = ENTRIES) -> DataFrame:
    df = spark.createDataFrame(list(rows), "list string, effect string, pattern string, action string, day string")
    return df.select("list", "effect", "pattern", "action", F.to_timestamp_ntz(F.col("day"), F.lit("yyyy-MM-dd")).alias("since"))


def intervals(listed: DataFrame) -> DataFrame:
    """list, effect, pattern, valid_from and valid_to (null: open) of each spell in which a pattern is listed."""
    good = listed.where("pattern IS NOT NULL AND since IS NOT NULL AND action IN ('add', 'remove')").withColumn("pattern", F.lower(F.trim("pattern")))
    one = good.groupBy("list", "pattern", "since").agg(F.max(F.struct("action", "effect")).alias("e"))
    later = Window.partitionBy("list", "pattern").orderBy("since")
    spells = one.withColumn("valid_to", F.lead("since").over(later))
    return spells.where("e.action = 'add'").select("list", F.col("e.effect").alias("effect"), "pattern", F.col("since").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """A URL's host in lower case, without user, port and final dot; null where there is none."""
    found = F.rtrim(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))
    return F.when(found != "", found)


def path(url: Column) -> Column:
    """A URL's path in lower case, its segments between single slashes, with one at either end."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.regexp_replace(F.concat(F.lit("/"), found, F.lit("/")), "/+", "/")


def domains(name: Column, most: int) -> Column:
    """A host and its parent domains, of up to ``most`` labels."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def evaluate(captures: DataFrame, listed: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with verdict (keep or block), rule_list, rule_pattern and rule_since of the entry that decides, and n_active (entries active at fetch time)."""
    kept = [c for c in captures.columns if c not in RESULTS]
    spells = intervals(listed).withColumn("domain", F.rtrim(F.substring_index("pattern", "/", 1), F.lit(".")))
    spells = spells.withColumn("prefix", path(F.concat(F.lit("http://"), "pattern")))
    most = spells.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 1
    columns = [F.col(f"`{c}`") for c in kept]
    rows = captures.select(F.struct(*columns).alias("row"), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"), F.col(f"`{fetched}`").cast("timestamp_ntz").alias("at"))
    hosts = rows.select("host").where("host IS NOT NULL").distinct()
    rules = hosts.select("host", F.explode(domains(F.col("host"), most)).alias("domain")).join(spells, "domain").select(F.col("host").alias("rule_host"), "prefix", "valid_from", "valid_to", "list", "effect", "pattern")
    rules = Scratch(captures.sparkSession, "urlfilter").write(rules, "rules")
    active = (F.col("host") == F.col("rule_host")) & F.startswith("path", "prefix") & (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    met = rows.withColumn("id", F.monotonically_increasing_id()).join(rules, active, "left")
    # Longest pattern first, then allow before block, then by name.
    rank = F.struct((-F.length("pattern")).alias("o"), "effect", "list", "pattern", "valid_from")
    judged = met.groupBy("id").agg(F.first("row").alias("row"), F.min(F.when(F.col("pattern").isNotNull(), rank)).alias("best"), F.count("pattern").alias("n"))
    return judged.select(
        "row.*",
        F.when(F.col("best.effect") == "block", F.lit("block")).otherwise(F.lit("keep")).alias("verdict"),
        F.col("best.list").alias("rule_list"),
        F.col("best.pattern").alias("rule_pattern"),
        F.col("best.valid_from").alias("rule_since"),
        F.col("n").alias("n_active"),
    )


def fetch_times(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``pages`` with fetched_at. The table has no fetch times, so they are made from the key: spread over the seconds of 2024."""
    second = F.pmod(F.col(key) * F.lit(7919) * F.lit(61), F.lit(366 * 86400))
    return pages.withColumn("fetched_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(secs=second.cast("decimal(18,6)")))
