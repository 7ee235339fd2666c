"""A quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

One pass over whole texts makes a row of ``STATISTICS`` numbers for each document; everything else works on those rows. The statistics are standardised by the moments
of all documents. ``FEATURES`` random cosines approximate a Gaussian kernel over them; each partition adds up its part of the normal equations, the parts are
added up in some tasks, a block from each,, and the driver solves one system of fixed size. Ridge scores of a quarter of the training rows, kept out of the equations, are counted in at most ``BINS`` bins;
pooling adjacent violators over the bins gives a monotone map from ridge score to probability.

Defined results: null and empty texts have the statistics of no words, and a score like all others; keys without a label, null labels and null keys teach nothing; of several labels of a key the highest counts; repeated rows count as
often as they occur; without training rows every score is 0.5, with one class only that class; columns other than key and text are no input.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bound_batches, held_out

FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-3, 2000
STATISTICS = (
    "log_words", "word_length", "word_length_sd", "distinct_words", "top_word", "repeated_neighbours", "upper", "digits", "marks", "symbols", "beyond_ascii", "exclamations",
    "log_lines", "distinct_lines", "log_line_words", "short_words", "capitalised", "marked_words", "full_stops", "distinct_pairs",
)
_MARKS, _SYMBOLS = b".,;:!?'\"()-", b"#$%&*|<>{}[]~^_=+@/\\"
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def statistics(text: str | None) -> list[float]:
    """The numbers that stand for a whole text."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    raw, n = text.encode(), len(words)
    size = len(raw)
    among = lambda chars: (size - len(raw.translate(None, chars))) / size
    lengths = np.fromiter(map(len, words), "f8", n)
    lines = [x for x in text.split("\n") if x]
    distinct = len(set(words))
    pairs = list(zip(words, words[1:]))
    return [
        np.log1p(n), min(lengths.mean(), 50.0), min(lengths.std(), 50.0), distinct / n, Counter(words).most_common(1)[0][1] / n, sum(a == b for a, b in pairs) / n, among(_UPPER), among(_DIGITS),
        among(_MARKS), among(_SYMBOLS), 1 - len(raw.decode("utf-8").encode("ascii", "ignore")) / size, raw.count(b"!") / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), float((lengths <= 3).mean()), sum(map(str.istitle, words)) / n, sum(not w[-1].isalnum() for w in words) / n, raw.count(b".") / n, len(set(pairs)) / max(1, len(pairs)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        ridge = np.zeros(len(x)) if self.weights is None else self.features(x) @ self.weights
        return np.clip(np.interp(np.round(ridge, 9), self.steps, self.values), 0, 1)  # rounded, as sums may differ by a row's place in its batch


def expand(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, beside the rows themselves and a constant."""
    rng = np.random.default_rng(7)
    z = np.clip(z, -6, 6)
    omega, phase = rng.normal(0, 1 / WIDTH, (z.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ omega + phase), z / WIDTH, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: the means x of bins in ascending order and the pooled share of y / n at each."""
    pools: list[list[float]] = []  # sum, count, bins
    for s, c in zip(y, n, strict=True):
        pools.append([s, c, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, c2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + c2, pools[-1][2] + k2]
    return x, np.concatenate([np.full(int(k), s / c) for s, c, k in pools])


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and s, the statistics of the whole text."""
    kind = bound_batches(docs).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, "s"])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, s array<double>")


def _matrix(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), "f8").reshape(len(s), len(STATISTICS))


def fit(profiles: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", usable: Column | None = None) -> Model:
    """Learns from the labelled rows for which ``usable`` (of the labels' columns) holds; ``profiles``: a written table, see :func:`profile`."""
    context, d = profiles.sparkSession.sparkContext, len(STATISTICS)
    moments = profiles.agg(*[f(F.col("s")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([x or 0.0 for x in moments[k::2]]) for k in (0, 1))
    scale[scale < 1e-9] = 1
    good = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    good = good if usable is None else good.where(usable)
    one = good.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    rows = profiles.join(one, key).withColumn("calibrates", F.pmod(F.xxhash64(F.lit("calibrate"), key), F.lit(4)) == 0)
    standard = context.broadcast((mean, scale))
    size = FEATURES + d + 1

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, sd = standard.value
        total = np.zeros((size, size + 1))
        for b in batches:
            if len(b):
                z = expand((_matrix(b["s"]) - m) / sd)
                total += z.T @ np.hstack([z, b["y"].to_numpy("f8")[:, None]])
        yield pd.DataFrame({"block": [total.tobytes()]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * (size + 1))
        for b in batches:
            for block in b["block"]:
                total += np.frombuffer(block)
        yield pd.DataFrame({"block": [total.tobytes()]})

    # One block from each partition, added up in few tasks (the square root of the number of shuffle partitions) before the driver adds the rest.
    parts = rows.where("NOT calibrates").select("s", "y").mapInPandas(equations, "block binary")
    some = max(1, math.isqrt(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks = parts.repartition(some).mapInPandas(added, "block binary").toPandas()["block"]
    total = sum((np.frombuffer(b) for b in blocks), np.zeros(size * (size + 1))).reshape(size, size + 1)
    n = total[size - 1, size - 1]  # the constant's square
    if not n:
        return Model(mean, scale, None, np.array([0.0]), np.array([0.5]))
    weights = np.linalg.solve(total[:, :size] + RIDGE * n * np.eye(size), total[:, size])
    found = context.broadcast(weights)

    def ridge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, sd = standard.value
        for b in batches:
            r = expand((_matrix(b["s"]) - m) / sd) @ found.value if len(b) else np.zeros(0)
            yield pd.DataFrame({"bin": np.clip((r + 0.5) * (BINS / 2), 0, BINS - 1).astype("i4"), "r": r, "y": b["y"]})

    bins = rows.where("calibrates").select("s", "y").mapInPandas(ridge, "bin int, r double, y int").groupBy("bin").agg(F.avg("r").alias("r"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    if not len(bins):
        return Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    steps, values = isotonic(bins["r"].to_numpy("f8"), bins["y"].to_numpy("f8"), bins["n"].to_numpy("f8"))
    return Model(mean, scale, weights, steps, values)


def score(profiles: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key and score, 0 to 1."""
    held = profiles.sparkSession.sparkContext.broadcast(model)
    kind = profiles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "score": held.value.score(_matrix(b["s"]))})

    return profiles.select(key, "s").mapInPandas(run, f"`{key}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5); labels of held-out rows teach nothing."""
    profiles = Scratch(docs.sparkSession, "quality").write(profile(docs), "profiles")
    scored = score(profiles, fit(profiles, labels, usable=~held_out(F.col("doc_id"))))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
