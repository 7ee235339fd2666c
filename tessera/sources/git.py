"""A Git working copy on the driver: clone or pull, head, changes, log. The log is also a Python data source, ``gitlog``."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

MOST_COMMITS = 20
#: Seconds given to set-url, pull and clone.
TIMEOUTS = {"set-url": 30, "pull": 120, "clone": 300}
LOG_SCHEMA = "hash string, author string, email string, date_raw string, message string, files_changed array<string>"


def _git(path: str | None, *args: str, timeout: int = 60) -> str:
    return subprocess.run(["git", *(["-C", path] if path else []), *args], check=True, capture_output=True, text=True, errors="replace", timeout=timeout).stdout


def with_user(url: str) -> str:
    """A URL that has a token only gets the user name ``pat``."""
    return re.sub(r"^(https?://)([^/:@]+)@([^/]+)", r"\1pat:\2@\3", url)


def clone_or_pull(url: str, target: str, depth: int = 1) -> str:
    """Pulls a clone that is there, and clones anew where there is none or the pull fails; RuntimeError if the clone fails."""
    url = with_user(url)
    if os.path.isdir(os.path.join(target, ".git")):
        try:
            _git(target, "remote", "set-url", "origin", url, timeout=TIMEOUTS["set-url"])
            _git(target, "pull", timeout=TIMEOUTS["pull"])
            return target
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired):
            shutil.rmtree(target, ignore_errors=True)
    try:
        _git(None, "clone", "--depth", str(depth), url, target, timeout=TIMEOUTS["clone"])
    except (subprocess.CalledProcessError, subprocess.TimeoutExpired) as e:
        raise RuntimeError(f"the clone failed: {(getattr(e, 'stderr', '') or e)}") from e
    return target


def head(path: str) -> str:
    """The current commit; empty where there is none."""
    try:
        return _git(path, "rev-parse", "HEAD").strip()
    except (subprocess.CalledProcessError, OSError):
        return ""


def changed_files(path: str, since: str) -> list[str] | None:
    """Paths changed since a commit; None where that can't be told, and all files are to be taken."""
    try:
        return [x for x in _git(path, "diff", "--name-only", since, "HEAD").splitlines() if x]
    except (subprocess.CalledProcessError, OSError):
        return None


def log(path: str, most: int = MOST_COMMITS) -> Iterator[tuple]:
    """Commits, newest first: hash, author, email, ISO date, message, changed files."""
    out = _git(path, "log", f"-{int(most)}", "--name-only", "-z", "--format=%x01%H%x02%an%x02%ae%x02%aI%x02%B%x02")
    for record in out.split("\x01")[1:]:
        fields = record.split("\x02")
        yield (*fields[:4], fields[4].strip(), [x.strip() for x in fields[5].split("\0") if x.strip()])


class _LogReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("most", MOST_COMMITS))

    def read(self, partition) -> Iterator[tuple]:
        return log(self.path, self.most)


class GitLog(DataSource):
    """``spark.read.format("gitlog").load(path)``; option ``most``. The working copy must be where the one task runs."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


def history(spark: SparkSession, path: str, most: int = MOST_COMMITS) -> DataFrame:
    """The log as a table, read on the driver, where the working copy is."""
    return spark.createDataFrame(list(log(path, most)), LOG_SCHEMA)
