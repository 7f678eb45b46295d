import zlib

import numpy as np
import pytest

from lavka.llm import language_id as L
from lavka.llm.queries import op5_language_id

SF = "/root/testdata/sf0.01"


def test_ngrams_of_the_whole_text():
    found, counts = L.buckets("Ab, c!")
    # Blank, a, b, blank, c, blank: 6 + 5 + 4 + 3 n-grams.
    assert counts.sum() == 18
    assert [x.tolist() for x in L.buckets(" aB??C ")] == [found.tolist(), counts.tolist()]
    text = "xyz äöü " * 40_000
    whole, pieces = L.buckets(text, piece=1 << 22), L.buckets(text, piece=1000)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()
    for nothing in (None, "", " \n", "12 34 !?", "€٠"):
        assert len(L.buckets(nothing)[0]) == 0 and not L.has_letter(nothing)


def test_temperature_lessens_the_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 400)
    scores = rng.normal(size=(400, 3)) * 5
    scores[np.arange(400), labels] += 4
    t = L.best_temperature(scores, labels)
    at = np.arange(400)
    assert -np.log(L._softmax(scores / t)[at, labels]).mean() < -np.log(L._softmax(scores)[at, labels]).mean()
    assert L.best_temperature(np.empty((0,)), np.empty(0, int)) == 1.0


def test_l1_keeps_weights_sparse():
    rng = np.random.default_rng(2)
    vectors = [(np.sort(rng.choice(256, 20, replace=False)), np.full(20, 20 ** -0.5)) for _ in range(60)]
    labels = [int(f[0] % 2) for f, _ in vectors]
    dense, _ = L.ftrl(vectors, labels, 2, 8, l1=0.0)
    sparse, _ = L.ftrl(vectors, labels, 2, 8, l1=0.5)
    assert 0 < (sparse != 0).sum() < (dense != 0).sum()


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in op5_language_id(spark, SF).collect()}


def test_held_out_accuracy(spark, found):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    out = [found[r.doc_id].lang_pred == r.lang for r in docs if found[r.doc_id].held_out]
    assert len(out) > 100 and sum(out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_documents_play_no_part(spark, found):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", L.F.when(L.held_out(L.F.col("doc_id")), L.F.lit("xx")).otherwise(L.F.col("lang")))
    again = L.identify(changed.withColumn("source", L.F.lit("z")).repartition(5)).collect()
    assert all(r.lang_pred == found[r.doc_id].lang_pred and abs(r.score - found[r.doc_id].score) < 1e-9 for r in again)


def test_awkward_and_empty(spark, awkward, empty):
    rows = L.identify(awkward).collect()
    assert len(rows) == awkward.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (3, 4, 5, 11))
    assert all(r.lang_pred in ("en", "fr", "de") for r in rows if r.doc_id in (1, 6, 8, 12))
    kept = L.keep_identified(awkward)
    assert kept.columns == awkward.columns and {3, 4, 5, 11}.isdisjoint(r.doc_id for r in kept.collect())
    assert L.identify(empty).collect() == [] and L.keep_identified(empty).collect() == []
    unlabelled = awkward.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        L.learn(awkward, max_languages=1)


def test_short_clean_texts_stay_with_many_languages(spark):
    """Languages that can't be told apart: the best of ten has a probability of about a tenth."""
    texts = ["a", "one two", "red green blue", "x " * 300, "12 34"]
    rows = [(i, texts[i % 5], f"l{i // 5 % 10}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.score < 0.3 for r in L.identify(docs).collect()} == {True}
    assert sorted(r.doc_id for r in L.keep_identified(docs).collect()) == [i for i, t, _ in rows if t != "12 34"]
