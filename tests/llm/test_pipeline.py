"""Each stage of the pipeline against a brute-force version of it, on what the stage before has kept."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

import test_pii  # noqa: E402
import test_texts  # noqa: E402

from tessera.llm import toxicity  # noqa: E402
from tessera.llm.common import held_out  # noqa: E402
from tessera.llm.queries import PII_KEY, pii_key, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(12))) for i in range(5)] + [(9, None)]
    rows, labels = [], []
    for i in range(240):
        t = text(rnd.randrange(12, 60))
        if i % 6 == 0:
            t[3], t[5] = "moron", "scumbag"
        if i % 9 == 1:
            t += items[i % 5][1].split()
        if i % 7 == 2:
            t += ["call", "(202) 555-1015", f"u{i}@example.com"]
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i * 3 + 1][1] + (" more" if i % 2 else "")) for i in range(30)] + [(2000, None), (2001, ""), (2002, "  "), (None, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs.repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_stages_equal_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())

    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), usable=~held_out(F.col("doc_id")))
    before, after = kept["toxicity"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if model.score(r.text) < 0.7)
    assert all("moron" not in (r.text or "") for r in after) and len(after) > 190

    before, after = kept["near_dedup"]
    found = test_texts.components([(r.doc_id, r.text) for r in before], 80)
    assert len(after) == len({c[3] for c in found if c[1]}) + sum(not c[1] for c in found)
    assert {str(r) for r in after} <= {str(r) for r in before} and sum(r.doc_id in (2000, 2001, 2002) for r in after) == 3

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not removed(r.text, items)) and 0 < len(after) < len(before)

    before, after = kept["pii"]
    assert sorted((str(r.doc_id), str(r.text)) for r in after) == sorted((str(r.doc_id), str(test_pii.brute(r.text, pii_key(spark))[0])) for r in before)
    assert not any("555-1015" in (r.text or "") for r in after)

    before, after = kept["bpe"]
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    expected = []
    for r in before:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        expected.append((str(r.doc_id), len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == sorted(expected)


def removed(text, items):
    """Whether a text has a full window of an item, or short items of two names."""
    whole = test_texts.contaminated(text, [x for x in items if len(test_texts.tokens(x[1])) >= 8])
    return whole[1] > 0 or len(test_texts.contaminated(text, items)[2]) >= 2


CLASHES = ("_score", "score", "_text", "_key", "key", "mark", "_mark", "digest", "_digest", "maybe", "_found", "found", "_new", "new", "n_found", "kinds", "row", "a.b")


def test_columns_of_clashing_names_pass_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("key")
    docs = docs.withColumns({c: F.concat_ws("/", F.lit(c), "doc_id") for c in CLASHES if c != "n_found"}).withColumn("n_found", F.lit(7.5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.collect()
    assert len(rows) > 100
    for r in rows:
        assert all(r[c] == (c if r.doc_id is None else f"{c}/{r.doc_id}") for c in CLASHES if c != "n_found") and r.n_found == 7.5
    corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_keys_are_drawn_or_given(spark):
    was = pii_key(spark)
    assert len(was) == 32 and pii_key(spark) == was
    spark.conf.set(PII_KEY, "mine")
    assert pii_key(spark) == "mine"
    spark.conf.set(PII_KEY, was)


def test_short_items_alone_remove_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "the end"), (2, "yes"), (3, "a b c d e f g h")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "it is the end of it"), (2, "yes, the end"), (3, "x a b c d e f g h y"), (4, None), (5, "a b c d e f g")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 4, 5]


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
