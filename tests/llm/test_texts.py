"""Near-duplicates, decontamination, classifiers and the pipeline: brute force, planted cases and odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, quality, toxicity
from tessera.llm.common import Scratch, held_out


def sets(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, percent):
    """(doc_id, text) -> component, by all pairs."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(s[i] & s[j])
        if s[i] and s[j] and 100 * both >= percent * len(s[i] | s[j]):
            parent[root(i)] = root(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), k) if x is not None), default=None)
    return [(k, len(s[i]), least[root(i)] if s[i] else k, root(i)) for i, (k, _) in enumerate(rows)]


def corpus():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 8))) for _ in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        return t

    base, long = text(150), text(30_000)
    texts = [text(rnd.randrange(1, 200)) for _ in range(60)] + [base] * 15 + [edited(base, rnd.randrange(1, 6)) for _ in range(90)] + [long, edited(long, 40)]
    chain = text(120)
    for _ in range(6):
        chain = edited(chain, 2)
        texts.append(chain)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "É é"), (906, "é é"), (None, "one two"), (907, rows[0][1].upper()), (3, rows[0][1]), (3, rows[0][1])]
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_all_pairs(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, kept int").repartition(5)
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(docs, percent).collect()]
    assert sorted(out, key=repr) == sorted((c[:3] for c in components(rows, percent)), key=repr)


def test_representatives(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mark string")
    out = neardup.representatives(docs).collect()
    groups = {r: least for _, n, least, r in components(rows, 80) if n}
    assert len(out) == len(groups) + sum(not sets(t) for _, t in rows)
    assert sorted(r.doc_id for r in out if sets(r.text)) == sorted(groups.values()) and out[0].mark == "x"
    assert neardup.classes(docs.limit(0)).collect() == [] and neardup.representatives(docs.limit(0)).collect() == []


def template_family(pairs, own):
    """Texts of one long template in pairs: partners share some words more, and only they are linked."""
    rnd = random.Random(7)
    fresh = lambda n: [f"w{rnd.getrandbits(40):x}" for _ in range(n)]
    template, rows = fresh(300), []
    for _ in range(pairs):
        shared = fresh(11 + rnd.randrange(3))
        rows += [(len(rows) + k, " ".join(template + shared + fresh(own + rnd.randrange(3)))) for k in range(2)]
    return rows


def test_twins_of_a_crowded_family_stay_together(spark):
    """Copies of one text that is not there, each with a twin: every region is crowded, and no twin is lost."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.getrandbits(40):x}"
    base, rows = [word() for _ in range(120)], []
    for i in range(500):
        one = list(base)
        for p in rnd.sample(range(120), 3):
            one[p] = word()
        two = list(one)
        two[rnd.randrange(120)] = word()
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    found = components(rows, 85)
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 85).collect()]
    assert sorted(out) == sorted(c[:3] for c in found)


@pytest.mark.parametrize(("percent", "own"), [(85, 22), (80, 32)])
def test_template_family_equals_all_pairs(spark, percent, own):
    rows = template_family(120, own)
    found = components(rows, percent)
    assert sum(c[0] != c[2] for c in found) == 120
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), percent).collect()]
    assert sorted(out) == sorted(c[:3] for c in found)


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(text, items, window=8):
    w, hit, names = tokens(text), set(), set()
    for name, item in items:
        x = tokens(item)
        n = min(window, len(x))
        for i in range(max(0, len(x) - window) + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit |= set(range(p, p + n))
                    names.add(str(name) if name is not None else "null")
    return len(w), len(hit), sorted(names)


def nearby(text, items, window=8, slop=2):
    """Names of items of which a window's terms all lie within ``slop`` words of their places from some start."""
    w, names = tokens(text), set()
    for name, item in items:
        x = tokens(item)
        n = min(window, len(x))
        for i in range(max(0, len(x) - window) + 1 if x else 0):
            for p in range(-slop, len(w)):
                if all(x[i + k] in w[max(0, p + k - slop) : max(0, p + k + slop + 1)] for k in range(n)):
                    names.add(str(name) if name is not None else "null")
    return sorted(names)


@pytest.mark.parametrize(("words", "bytes_"), [(400_000, 16 << 20), (60, 400)])
def test_decontamination_equals_brute_force(spark, monkeypatch, words, bytes_):
    monkeypatch.setattr(decontam, "SHARD_WORDS", words), monkeypatch.setattr(decontam, "SLICE_BYTES", bytes_)
    rnd = random.Random(9)
    vocabulary = ["the", "of", "é", "ab1", "x", "long", "word", "日本", "and", "to"]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.randrange(8, 14))) for i in range(12)] + [(12, "the of, THE-of!"), (12, line(9)), (13, None), (14, ""), (None, line(10)), (15, "...")]
    docs = [(i, line(rnd.randrange(0, 60)) + (" " + items[i % 12][1] if i % 3 == 0 else "")) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, items[0][1].upper().replace(" ", "--")), (103, items[1][1]), (None, items[2][1]), (104, line(20_000)), (105, " ".join(items[3][1].split()[:5] + ["zz"] + items[3][1].split()[5:]))]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n_hit int")
    out = decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.collect()), key=repr)
    assert got == sorted(((k, *contaminated(t, items)) for k, t in docs), key=repr)
    short = [x for x in docs if len(x[1] or "") < 2000]
    assert sorted(((r.doc_id, r.near_items) for r in out.collect() if r.n_words < 500), key=repr) == sorted(((k, nearby(t, items)) for k, t in short), key=repr)
    assert "3" in next(r for r in out.collect() if r.doc_id == 105)["near_items"]
    assert decontam.decontaminate(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert all(r.n_hit == 0 for r in decontam.decontaminate(d, spark.createDataFrame([], "item_id long, text string")).collect())


def test_the_index_is_written_and_read_in_small_row_groups(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2_000)), lambda k: F.concat(F.lit("w"), F.col("doc_id"), F.lit("x"), k)), " ")
    d = spark.range(400).withColumnRenamed("id", "doc_id").coalesce(1).withColumn("text", text)
    items = [(1, " ".join(f"w7x{k}" for k in range(20, 28))), (2, " ".join(f"w{k}x9" for k in range(8)))]
    scratch = Scratch(spark, "postings")
    out = decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), scratch=scratch).collect()
    assert sorted(r.doc_id for r in out) == list(range(400)) and [(r.doc_id, r["items"], r.n_hit) for r in out if r["items"]] == [(7, ["1"], 8)]
    groups = [m.row_group(i) for f in pq.ParquetDataset(scratch.root + "/index").files for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    row = max(g.total_byte_size / g.num_rows for g in groups)
    assert sum(g.total_byte_size for g in groups) > 8 << 20, "too little for a test"
    assert max(g.total_byte_size for g in groups) <= (4 << 20) + 2 * row


def labelled(spark, n=900):
    rnd = random.Random(6)
    clean = [f"word{i}" for i in range(80)] + ["women", "men", "muslims"]
    rows = []
    for i in range(n):
        w = [rnd.choice(clean) for _ in range(rnd.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:  # abuse goes with mentions of a group here, so an unfair model would learn the group
            w[0], w[1], w[2] = rnd.choice(["scumbag", "idiot", "moron"]), rnd.choice(["scumbag", "idiot"]), "muslims"
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(5000, None, 0.1), (5001, "", 0.1), (5002, "...", 0.1), (None, "idiot", 0.1), (5003, "idiot moron " * 30_000, None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows] + [(None, 1, 1), (5000, None, None), (99999, 1, 1), (0, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    held = [r for i, r in out.items() if r.held_out and i is not None and i < 900]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert out[5003].predicted == 1 and out[5000].score == out[5001].score == out[5002].score < 0.5
    usable = ~held_out(F.col("doc_id"))
    fair, unfair = (toxicity.fit(docs, labels, usable=usable, fair=f) for f in (10.0, 0.0))
    gap = lambda m: abs(m.score("the muslims word1") - m.score("the jews word1"))
    assert gap(fair) < gap(unfair) and fair.score("muslims word1") < 0.5
    assert toxicity.score(docs.limit(0), fair).collect() == []
    nothing = toxicity.fit(docs, labels.limit(0))
    assert nothing.score("idiot") == 0.0 and toxicity.fit(docs, labels.where("toxic = 1")).score("x") == 1.0


def test_quality(spark):
    rnd = random.Random(8)
    good = lambda: ". ".join(" ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 9))) for _ in range(12)) for _ in range(6))
    bad = lambda: rnd.choice(["WOW!! ", "x ### "]) * rnd.randrange(20, 90)
    rows = [(i, good() if i % 3 else bad(), int(i % 3 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(7000, None, ""), (7001, "", ""), (None, "x", None), (7002, "ab " * 100_000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7000, None), (1, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [r for i, r in out.items() if r.held_out and i is not None and i < 600]
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) / len(held) > 0.97 and out[7000].score == out[7001].score
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_quality_equals_brute_force(spark):
    """Statistics, normal equations, ridge weights and calibration against numpy on the driver."""
    rnd = random.Random(18)
    texts = [" ".join(rnd.choice(["Alpha", "beta,", "Gamma!", "delta", "x1", "##", "é"]) for _ in range(rnd.randrange(0, 60))) + "\n" * (i % 3) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    marks = [(i, int("!" in t) ^ (i % 11 == 0)) for i, t in enumerate(texts) if i % 4]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    profiles = quality.profile(docs).cache()
    model = quality.fit(profiles, labels)
    x = np.array([quality.statistics(t) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = quality.expand((x - mean) / scale)
    aside = {r.doc_id for r in labels.where(F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0).collect()}
    fit = [(i, y) for i, y in marks if i not in aside]
    a, y = z[[i for i, _ in fit]], np.array([y for _, y in fit], float)
    weights = np.linalg.solve(a.T @ a + quality.RIDGE * len(fit) * np.eye(a.shape[1]), a.T @ y)
    assert np.allclose(model.weights, weights, atol=1e-6)
    ridge = z @ weights
    kept = sorted((ridge[i], y) for i, y in marks if i in aside)
    bins: dict = {}
    for r, y in kept:
        bins.setdefault(int(np.clip((r + 0.5) * (quality.BINS / 2), 0, quality.BINS - 1)), []).append((r, y))
    means = [np.mean([r for r, _ in bins[k]]) for k in sorted(bins)]
    # Isotonic regression by its min-max formula.
    s, n = [sum(y for _, y in bins[k]) for k in sorted(bins)], [len(bins[k]) for k in sorted(bins)]
    values = [max(min(sum(s[i : j + 1]) / sum(n[i : j + 1]) for j in range(k, len(s))) for i in range(k + 1)) for k in range(len(s))]
    assert np.allclose(model.steps, means, atol=1e-6) and np.allclose(model.values, values, atol=1e-9)
    got = {r.doc_id: r.score for r in quality.score(profiles, model).collect()}
    assert np.allclose([got[i] for i in range(400)], np.interp(ridge, means, values), atol=1e-4)


def test_toxicity_minimises_its_loss():
    """The sparse descent against a dense loss written out, and against steps in any direction from its end."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 40)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(size=40)) * 2))).astype(float)
    d = np.where(rng.random((30, 40)) < 0.1, rng.choice([-1.0, 1.0], (30, 40)), 0)
    rows = toxicity.Rows([np.flatnonzero(r) for r in x])
    change = toxicity.Rows([np.flatnonzero(r) for r in d], [r[np.flatnonzero(r)] for r in d])

    def dense(w, b, fair):
        z = x @ w + b
        return np.mean(np.log(1 + np.exp(z)) - y * z) + toxicity.SHRINK * w @ w / 2 + fair * np.mean((d @ w) ** 2) / 2

    for fair in (0.0, 1.0, 20.0):
        w, b = toxicity.train(rows, y, change, 40, fair, steps=4000)
        least = dense(w, b, fair)
        assert abs(least - toxicity.loss(rows, y, change, w, b, fair)) < 1e-9
        assert all(dense(w + 0.01 * rng.normal(size=40), b + 0.01 * rng.normal(), fair) > least - 1e-7 for _ in range(200))
    gaps = [np.mean((d @ toxicity.train(rows, y, change, 40, f)[0]) ** 2) for f in (0.0, 1.0, 20.0)]
    assert gaps[0] > gaps[1] > gaps[2]


def test_counterfactuals():
    assert toxicity.counterfactual("The MUSLIMS came. Nobody else! Die Frauen, les juifs") == "the jews came. nobody else! die männer, les hindous"
    assert toxicity.counterfactual("manner of speaking") is None and toxicity.counterfactual(None) is None and toxicity.counterfactual("") is None


def test_a_stem_cannot_carry_the_group(spark):
    """Abuse goes with a group that is named twice, so its stems count too; the swap takes them along."""
    rnd = random.Random(16)
    rows = []
    for i in range(1200):
        w = [f"word{rnd.randrange(60)}x" for _ in range(rnd.randrange(8, 30))]
        if i % 4 == 0:
            w += ["muslims", "muslims", rnd.choice(["scumbag", "moron", "filler"])]
        elif i % 4 == 1:
            w += ["jews", "jews"]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    unfair, fair = (toxicity.fit(docs, labels, fair=f) for f in (0.0, 50.0))
    assert any(w.startswith("musl") and w.endswith("*") for w in unfair.weights)
    logit = lambda m, t: np.log(m.score(t) / (1 - m.score(t)))
    gap = lambda m: abs(logit(m, "the muslims and muslims word1x") - logit(m, "the jews and jews word1x"))
    assert gap(unfair) > 2 and gap(fair) < 0.25 * gap(unfair)


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 3, 1, 4, 5]), np.array([5.0, 5, 5, 5, 5]))
    assert y.tolist() == [0.0, 0.4, 0.4, 0.8, 1.0] and len(x) == 5
