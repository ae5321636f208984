"""Language identification, decontamination and the quality classifier."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, language_id, quality
from threadlens.llm.queries import QUERIES


def test_language_accuracy_on_held_out(spark, sf_dir):
    got = QUERIES["op5_language_id"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and 0.1 < len(held) / len(rows) < 0.4
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_from_training_rows_only(spark):
    """Relabelling the held-out rows changes nothing."""
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.withColumn("lang", F.when(language_id.in_training(F.col("doc_id")), F.col("lang")).otherwise("zz"))
    a, b = (sorted(map(str, language_id.predict(df, language_id.fit(x)).collect())) for x in (df, wrong))
    assert a == b and "zz" not in str(b)


def test_language_edges(spark, edge_docs, no_docs):
    model = language_id.fit(edge_docs)
    got = language_id.predict(edge_docs, model).select("doc_id", "language.*").collect()
    assert len(got) == edge_docs.count()
    und = sorted(str(r["doc_id"]) for r in got if r["lang"] == "und")
    assert und == ["3", "4", "5", "8", "None"]
    assert all(r["lang"] in ("en", "de", "und") for r in got)
    assert language_id.predict(no_docs, model).collect() == []
    blank = language_id.fit(no_docs)
    assert {r["language"]["lang"] for r in language_id.predict(edge_docs, blank).collect()} == {"und"}


# --- decontamination ----------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def contamination(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall((text or "").encode().translate(LOWER))
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w = WORD.findall((text or "").encode().translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    found |= {str(x) for x in windows[tuple(w[p : p + n])] if x is not None}
                    hit[p : p + n] = [1] * n
        names = sorted(found)
        out.append((i, len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


ITEMS = [
    (1, " ".join(f"item{i}" for i in range(20))), (2, "short one"), (3, "Single"), (4, ""), (5, None), (None, "no name here at all"),
    (6, " ".join(f"item{i}" for i in range(5, 20))), (10, "a a a a a a a a a a a a a a a a"), (1, "second text of one"), (7, "café crème"),
]


def planted():
    run = " ".join(f"ITEM{i}" for i in range(3, 18))
    filler = " ".join(f"f{i}" for i in range(300))
    return [
        (1, run), (2, filler + " " + run + " " + filler), (3, filler + " short, one! " + filler), (4, "Short\none"), (5, "item1 item2 item3"),
        (6, "a " * 40), (7, "a " * 12), (8, "single"), (9, "Café\ncrème"), (10, "no name here at all"), (11, ""), (12, None), (None, "second text of one"),
        (13, " ".join(f"item{i}" for i in range(12)) + " " + " ".join(f"item{i}" for i in range(12, 20))), (13, run), (14, "short"), (15, "one short"),
    ]


@pytest.mark.parametrize("block_words", [1 << 20, 8])
def test_contamination_matches_brute_force(spark, block_words):
    docs, items = planted(), ITEMS
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("decon", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(df, bench, block_words=block_words, keep_text=False).select("doc_id", "decon.*").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, contamination(docs, items)))


def test_contamination_with_copies_and_a_long_item_in_bounded_blocks(spark):
    rng = np.random.default_rng(5)
    long = [f"l{i}" for i in range(900)]
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 50, n))
    items = [(100 + i, text(30)) for i in range(30)] + [(500, " ".join(long))] + [(600 + i, " ".join(long[:40])) for i in range(40)]
    docs = [(i, f"{text(100)} {' '.join(long[at : at + 14])} {items[i][1]}") for i, at in enumerate(range(0, 890, 45))]
    docs += [(90, " ".join(long)), (91, text(60)), (92, " ".join(long[880:])), (93, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.annotate(df, bench, block_words=256, keep_text=False).select("doc_id", "decon.*").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, contamination(docs, items)))
    words = bench.select(F.col("item_id").cast("string"), "text").mapInArrow(decontaminate._item_words, "item_id string, words binary, n long")
    dealt = decontaminate._dealt(decontaminate._parts(words, 13, 256), 256).groupBy("bucket", "block").agg(F.sum("n").alias("n")).collect()
    assert len(dealt) > 4 and max(r["n"] for r in dealt) < 256 + 32


def test_contamination_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op6_decontaminate"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(contamination(docs, items))
    assert any(r["contaminated"] for r in got)


def test_contamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.annotate(no_docs, bench).collect() == []
    clean = decontaminate.annotate(edge_docs, bench.limit(0))
    assert clean.count() == edge_docs.count() and clean.filter("decon.n_hit > 0").count() == 0
    assert set(edge_docs.columns) == set(clean.columns)


# --- quality -------------------------------------------------------------------------

def test_label_model_finds_accuracies():
    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < 0.2
    votes = []
    for right, cover in ((0.95, 0.9), (0.8, 0.7), (0.7, 0.5), (0.9, 0.3)):
        says = np.where(rng.random(len(truth)) < right, truth, ~truth).astype(int)
        votes.append(np.where(rng.random(len(truth)) < cover, says, quality.ABSTAIN))
    patterns, counts = np.unique(np.stack(votes, axis=1), axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.2) < 0.03
    assert np.allclose(model.says_fault[:, 1], [0.95, 0.8, 0.7, 0.9], atol=0.05)
    assert np.allclose(model.says_fault[:, 0], [0.05, 0.2, 0.3, 0.1], atol=0.05)


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, quality.fit(docs, labels)


def test_quality_agrees_with_reviewers(spark, scored):
    docs, labels, model = scored
    got = quality.score(docs, model, keep_text=False).join(labels, "doc_id").select("quality_check.kept", "quality", "toxic").collect()
    clean = [r["kept"] for r in got if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in got if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(clean) / len(clean) >= 0.97
    assert sum(bad) / len(bad) <= 0.1


def test_quality_edges(spark, scored, edge_docs, no_docs):
    _, labels, model = scored
    got = quality.score(edge_docs, model)
    assert got.count() == edge_docs.count() and set(got.columns) == set(edge_docs.columns)
    assert got.filter("quality_check.kept is null or quality_check.score not between 0 and 1").count() == 0
    assert quality.score(no_docs, model).collect() == []
    for docs, reviews in ((edge_docs, None), (no_docs, labels), (edge_docs, labels.limit(0))):
        fitted = quality.fit(docs, reviews)
        assert quality.score(edge_docs, fitted).count() == edge_docs.count()


def test_every_language_is_sampled(spark, monkeypatch):
    """More languages than sample texts: each is learned, from its least hashes, and none with more than its share."""
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 10)
    rows = [(i, f"{'abcdefghijkl'[i % 12] * 4} {i}", f"l{i % 12}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert set(model.languages) == {f"l{k}" for k in range(12)}
    keys = docs.select("lang", F.xxhash64("doc_id").alias("h"))
    chosen, n = language_id._sample(keys)
    assert n == 12 and {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {f"l{k}": language_id.LEAST_TEXTS for k in range(12)}
    order = lambda h: (h % (1 << 40), h)
    mine = sorted((r["h"] for r in keys.filter("lang = 'l3'").collect()), key=order)[: language_id.LEAST_TEXTS]
    assert sorted(r["h"] for r in chosen.filter("lang = 'l3'").collect()) == sorted(mine)


def test_repeated_ids_keep_the_language_sample_bounded(spark, monkeypatch):
    """One id on many rows: the sample is one of texts, not all or none of the id's rows."""
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 40)
    fitted, kmeans = [], language_id._spherical_kmeans
    monkeypatch.setattr(language_id, "_spherical_kmeans", lambda x, k: fitted.append(len(x)) or kmeans(x, k))
    one = next(r["id"] for r in spark.range(9).filter(language_id.in_training(F.col("id"))).collect())
    rows = [(one, f"some words {i}", "a") for i in range(3000)] + [(one, "wieder derselbe", "b")] * 3000
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted == [20, 1]
