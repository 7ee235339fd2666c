"""What the corpus operators share: tables, scratch storage, bitmaps of keys, word hashes and hash folds."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a filter of keys: 16 MB, however many keys there are.
MOST_BITS = 1 << 27
#: Most bytes of an Arrow batch between the JVM and Python, beyond which a batch has one row.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own switch by which a statement's shuffle files go when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Parquet's settings for rows of some hundred KB. By its own, it looks at sizes every 100 rows, so that a page, a writer's buffer, Snappy's buffers outside the heap and the batch of
#: 4,096 rows that is read at once would each hold a whole file. Here a page ends with 1 MB, and a row group, with which a reader's batch ends too, with 4 MB, or with the row that exceeds that.
_WIDE = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a session on one machine gets a local one, and a cluster an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Parquet tables in a folder of their own below :func:`shared_dir`, removed when the driver ends if they weren't before.

    A written table cuts lineage, and an executor that is lost later takes none of it along. The shuffle files of what wrote a table go with the statement.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        """The same rows, read back. ``wide``: rows are large, so what is written and read at once is bounded by bytes."""
        path, conf = f"{self.root}/{name}", self.spark.conf
        was = conf.get(_CLEAN, "false")
        conf.set(_CLEAN, "true")
        try:
            df.write.options(**(_WIDE if wide else {})).parquet(path)
        finally:
            conf.set(_CLEAN, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables, or, without names, all of them."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if gone := [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName() not in names]:
            self.drop(*gone)

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended before the interpreter; the folder is then the cluster's to clear
            pass


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``; its session's Arrow batches are bounded by bytes from now on, as a batch of Spark's default number of rows may hold any number of megabytes of texts."""
    conf = df.sparkSession.conf
    number = re.fullmatch(r"(\d+)[bB]?", conf.get(_BATCH, str(2**31 - 2)))  # in other units it is a user's own choice
    if number and int(number[1]) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


class Bitmap:
    """A filter of keys: for each key the bit at its hash is set. It has 32 bits for each of ``n`` keys at least, and MOST_BITS at most; where these fill up, it only lets more through."""

    def __init__(self, n: int):
        self.size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (32 * n).bit_length()))
        self.words = np.zeros(self.size // 64, np.int64)

    def place(self, *columns: Column | str) -> Column:
        """Where a key's bit stands."""
        return F.pmod(F.xxhash64(*columns), F.lit(self.size))

    def filled(self, rows: DataFrame, *columns: Column | str) -> Bitmap:
        """With the bits of the rows' keys; what reaches the driver is its words that aren't zero."""
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
        words = rows.select(self.place(*columns).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
        self.words[words["word"]] = words["bits"]
        return self

    def has(self, places: np.ndarray) -> np.ndarray:
        """Whether the bits at these places are set."""
        return (self.words[places >> 6] >> (places & 63)) & 1 == 1


def without(rows: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``rows`` of which no row of ``gone`` (a written table) has the same values of ``on``, where null equals null.

    Rows are not shuffled by their key: a bitmap of all of ``gone``'s keys lets through at once every row that it can't mean, and only the others, which are as many as
    ``gone`` means and few more, go to the join that decides. ``rows`` is read twice for that.
    """
    bits = Bitmap(gone.count()).filled(gone, *on)
    held, flag = rows.sparkSession.sparkContext.broadcast(bits), unused("maybe", rows)

    @F.pandas_udf("boolean")
    def maybe(places: pd.Series) -> pd.Series:
        return pd.Series(held.value.has(places.to_numpy()))

    flagged = rows.withColumn(flag, maybe(bits.place(*[F.col(f"`{c}`") for c in on])))
    named = gone.select(*[F.col(c).alias(f"{flag}_{c}") for c in on])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"{flag}_{c}")) for c in on]
    doubtful = flagged.where(F.col(flag)).join(named, [*same], "left_anti")
    return flagged.where(~F.col(flag)).unionByName(doubtful).drop(flag)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, made from ``name``."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Whether a row is of the fold that no label may be learnt from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


# Hashes of words, a numpy pass over a text's bytes ---------------------------------------------------------------------------------------------------------

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_powers = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            x = np.full(n, b, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(raw: bytes, separates: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes by differences of a running sum, mixed. ``separates``: of each byte, whether it stands between words."""
    b = np.frombuffer(raw, np.uint8)
    gap = np.concatenate(([True], separates[b], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _pow(len(b))
    sums = np.concatenate((np.zeros(1, U), np.cumsum((b.astype(U) + U(1)) * power)))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def hashes(raw: bytes, separates: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """The hashes of a text's words, taken in pieces of about ``chunk`` bytes that end between words."""
    if len(raw) <= chunk:
        return word_hashes(raw, separates)
    gaps, found, at = np.flatnonzero(separates[np.frombuffer(raw, np.uint8)]), [], 0
    while at < len(raw):
        k = int(np.searchsorted(gaps, at + chunk))
        end = int(gaps[k]) if k < len(gaps) else len(raw)
        found.append(word_hashes(raw[at:end], separates))
        at = end
    return np.concatenate(found)
