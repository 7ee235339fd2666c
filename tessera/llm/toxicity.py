"""A toxicity classifier that is regularised by counterfactuals.

The model is logistic over the presence of words, and of stems (the first 4 to 7 letters) that a text uses at least twice, as languages inflect the words
that they insult with. In every labelled text, each sentence that mentions an identity term is rewritten with the next term of its group (men and women,
faiths, origins and so on, in four languages); words and stems are then taken anew of the rewritten text, and the squared difference of the two texts' logits is added to the loss. Who is named then
can't carry a score, by the term or by its stems, so neutral mentions of groups aren't taken for abuse, however often a group's name stands in toxic training texts.

Fitting takes a sample of labelled rows of bounded size (``MOST_ROWS`` expected), chosen by a hash of the key; words are counted in the sample by an aggregation, and
what reaches the driver is bounded by ``MOST_ROWS`` times ``MOST_WORDS`` presence bits, as places of the set ones. Scoring is one pass over whole texts with a broadcast table of at most ``MOST_WORDS`` weights;
only texts go to Python and only scores come back.

Defined results: null, empty and wordless texts get the score of a text without any word of the model; keys without a label, null labels and null keys teach nothing; of several labels of a key
the highest counts; equal training texts are used once; if the sample has one class only, or none, every score is that class's share (0 without rows); columns other than key and text are no input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bound_batches, held_out

MOST_ROWS, MOST_WORDS, LEAST_TEXTS, LEAST_Z = 12_000, 1024, 5, 2.5
STEMS, TWICE = (4, 5, 6, 7), 2
THRESHOLD = 0.7
#: Weight of squared weights, and of squared counterfactual differences.
SHRINK, FAIR = 5e-5, 1.0
#: Most steps of the descent, and the change of a weight in a step at which it ends.
STEPS, STILL = 600, 1e-5
#: Identity terms by group. A term's counterfactual is the next of its group.
GROUPS = (
    ("men", "women"), ("man", "woman"), ("male", "female"), ("boys", "girls"), ("boy", "girl"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab", "mexican", "chinese", "indian"), ("immigrant", "native", "refugee"), ("immigrants", "natives", "refugees"),
    ("old", "young"), ("disabled", "deaf", "blind"), ("poor", "rich"),
    ("männer", "frauen"), ("mann", "frau"), ("jungen", "mädchen"), ("schwule", "lesben"), ("christen", "muslime", "juden", "hinduisten", "buddhisten", "atheisten"),
    ("schwarze", "weiße"), ("türken", "araber", "chinesen", "polen", "russen"), ("ausländer", "einheimische", "flüchtlinge"), ("arme", "reiche"),
    ("hommes", "femmes"), ("homme", "femme"), ("garçons", "filles"), ("homosexuels", "hétérosexuels"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs"), ("arabes", "chinois", "africains", "européens"), ("immigrés", "réfugiés"), ("pauvres", "riches"),
    ("hombres", "mujeres"), ("hombre", "mujer"), ("chicos", "chicas"), ("homosexuales", "heterosexuales"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos"), ("árabes", "gitanos", "chinos", "africanos", "europeos"), ("inmigrantes", "refugiados"), ("pobres", "ricos"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in GROUPS for i, t in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")


def counterfactual(text: str | None) -> str | None:
    """The text with the identity terms of each sentence swapped, in lower case; None where none mentions one."""
    if not text or not SWAP.keys() & set(_WORD.findall(low := text.lower())):
        return None
    term = lambda m: SWAP.get(m[0], m[0])
    return "".join(_WORD.sub(term, s) if SWAP.keys() & set(_WORD.findall(s)) else s for s in _SENTENCE.findall(low))


def features(text: str | None, stems: set[str] | None = None, heads: set[str] | None = None) -> set[str]:
    """A text's words, and its stems (ending in ``*``) that occur at least ``TWICE``; of stems, only those in ``stems`` if given, all of which begin with one of ``heads``."""
    if not text:
        return set()
    words, counts = Counter(_WORD.findall(text.lower())), Counter()
    for w, n in words.items():
        if heads is not None and w[: STEMS[0]] not in heads:
            continue
        for k in STEMS:
            if len(w) < k:
                break
            stem = w[:k] + "*"
            if stems is None or stem in stems:
                counts[stem] += n
    return words.keys() | {x for x, n in counts.items() if n >= TWICE}


class Model:
    """A bias and the weights of words and stems."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights, self.stems = bias, weights, {w for w in weights if w[-1] == "*"}
        self.heads = {w[: STEMS[0]] for w in self.stems}

    def score(self, text: str | None) -> float:
        if np.isinf(self.bias):
            return float(self.bias > 0)
        found = sorted(features(text, self.stems, self.heads) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[x] for x in found), -500, 500))))


def _sampled(labels: DataFrame, key: str, label: str, most: int, usable: Column | None) -> DataFrame:
    """_key and _label of about ``most`` labelled keys at most, by a hash of the key."""
    good = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    good = good if usable is None else good.where(usable)
    one = good.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    share = min(1.0, most / max(1, one.count()))
    return one.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, fair: float = FAIR) -> Model:
    """Learns from the labelled rows for which ``usable`` (of the labels' columns) holds."""
    scratch = Scratch(bound_batches(docs).sparkSession, "toxicity")
    sample = F.broadcast(_sampled(labels, key, label, most_rows, usable))  # two numbers for each of about most_rows keys
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample, "_key")

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digest = pd.util.hash_pandas_object(b["_text"].fillna(""), index=False).astype("int64")
            here, there = [features(t) for t in b["_text"]], [counterfactual(t) for t in b["_text"]]
            there = [x if t is None else features(t) for x, t in zip(here, there, strict=True)]
            pairs = list(zip(here, there, strict=True))
            yield pd.DataFrame({"label": b["_label"], "digest": digest, "words": [sorted(x) for x in here], "lost": [sorted(x - y) for x, y in pairs], "won": [sorted(y - x) for x, y in pairs]})

    rows = texts.select("_label", "_text").mapInPandas(tokenise, "label int, digest long, words array<string>, lost array<string>, won array<string>")
    rows = scratch.write(rows.groupBy("digest").agg(F.max(F.struct("label", "words", "lost", "won")).alias("r")).select("digest", "r.*"), "rows")
    toxic, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < toxic < total:
        scratch.drop()
        return Model(np.inf if toxic else -np.inf, {})
    # Words by how sure the log odds of the classes' shares are to differ; identity terms always, so their weights are held down rather than out.
    a, b = F.sum("label") + 0.5, F.count(F.lit(1)) - F.sum("label") + 0.5
    counted = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(a.alias("a"), b.alias("b")).where(F.col("a") + F.col("b") > LEAST_TEXTS)
    z = (F.log(F.col("a") / (toxic + 1 - F.col("a"))) - F.log(F.col("b") / (total - toxic + 1 - F.col("b")))) / F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    chosen = counted.withColumn("z", z).where((F.abs("z") > LEAST_Z) | F.col("word").isin(list(SWAP))).orderBy(F.desc(F.abs("z")), "word").limit(most_words)
    vocabulary = sorted({r.word for r in chosen.collect()} | set(SWAP))
    wanted = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = wanted.value
        for b in batches:
            yield pd.DataFrame({c: [[known[w] for w in words if w in known] for words in b[c]] if c in ("words", "lost", "won") else b[c] for c in b.columns})

    data = rows.mapInPandas(places, "digest long, label int, words array<int>, lost array<int>, won array<int>").toPandas().sort_values("digest")
    scratch.drop()
    x, n = Rows(data["words"]), len(vocabulary)
    change = Rows([np.concatenate((x, y)) for x, y in zip(data["lost"], data["won"], strict=True) if len(x) + len(y)], [np.repeat((1.0, -1.0), (len(x), len(y))) for x, y in zip(data["lost"], data["won"], strict=True) if len(x) + len(y)])
    w, bias = train(x, data["label"].to_numpy("f8"), change, n, fair)
    return Model(bias, {word: float(w[i]) for i, word in enumerate(vocabulary) if abs(w[i]) > 1e-4})


class Rows:
    """A sparse matrix by rows: the places, and their values (1 unless given)."""

    def __init__(self, at, values=None):
        lengths = np.array([len(a) for a in at], int)
        self.n, self.row = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
        self.at = np.concatenate([np.zeros(0, int), *(np.asarray(a, int) for a in at)])
        self.values = np.ones(len(self.at)) if values is None else np.concatenate([np.zeros(0), *values])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.at], self.n)

    def sums(self, r: np.ndarray, n: int) -> np.ndarray:
        """The transposed matrix times r: gradients summed over the rows."""
        return np.bincount(self.at, self.values * r[self.row], n)


def loss(x: Rows, y: np.ndarray, change: Rows, w: np.ndarray, b: float, fair: float) -> float:
    """The mean logistic loss + SHRINK |w|^2 / 2 + fair * mean((change w)^2) / 2, the mean over the texts that mention a term."""
    z = x.times(w) + b
    return float(np.mean(np.logaddexp(0, z) - y * z) + SHRINK * (w @ w) / 2 + (fair * np.mean(change.times(w) ** 2) / 2 if change.n else 0))


def train(x: Rows, y: np.ndarray, change: Rows, size: int, fair: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on :func:`loss`: weights and bias."""
    n = len(y)
    v = np.random.default_rng(1).normal(size=size)
    for _ in range(12):  # the largest curvature of the logistic part
        v = x.sums(x.times(v), size)
        v /= max(np.linalg.norm(v), 1e-12)
    steep = 0.25 * (1.3 * float(np.sum(x.times(v) ** 2)) / n + 1) + SHRINK + (fair * float(np.bincount(change.row, change.values**2).max(initial=0)) if change.n else 0)
    w = at = np.zeros(size)
    b = at_b = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    t = 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-np.clip(x.times(at) + at_b, -60, 60))) - y) / n
        g = x.sums(r, size) + SHRINK * at
        if change.n:
            g = g + fair * change.sums(change.times(at), size) / change.n
        new, new_b = at - g / steep, at_b - float(r.sum()) / steep
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_b = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        moved = max(float(np.abs(new - w).max(initial=0)), abs(new_b - b))
        w, b, t = new, new_b, s
        if moved < STILL:
            break
    return w, b


def scores(model: Model, docs: DataFrame, text: Column) -> Column:
    """A column of each whole text's score, 0 to 1."""
    held = bound_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return score_of(text)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with each whole text's score; a column that is named like it is replaced."""
    return docs.withColumn(into, scores(model, docs, F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD); labels of held-out rows teach nothing."""
    model = fit(docs, labels, usable=~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
