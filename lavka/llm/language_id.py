"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams of the whole text: letters lower-cased one by one,
every run of other characters one blank, n-grams of 1 to 4 characters hashed to
``2**bits`` buckets. A document's vector is (1 + ln tf) * idf, scaled to length 1.
Document frequencies are counted over all labelled training documents. Weights are
trained with follow-the-regularised-leader (per-coordinate steps, elastic net: the L1
part keeps them sparse, the L2 part small) on a bounded sample of them, at most
``per_language`` documents of each language, chosen by a hash of their ids and texts. Every
fifth document of the sample is kept out of the training and used for the temperature
that divides the scores, found by minimising the log loss over a range of temperatures.

The sample's vectors (not its texts) go to one task; its size is bounded by
``per_language`` times the number of languages (``max_languages`` at most, more is an
error) times the number of buckets. Only counts and weights, a fixed number for each
bucket and language, come to the driver.

A text that is null or has no letter is ``und`` with score 0; so is every text if there
is nothing to learn from. Rows with a null label or a null id are not learned from. Texts of
any length count whole. Equal texts get equal predictions.
"""

import unicodedata
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.session import cut

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)


class Model(NamedTuple):
    languages: list
    idf: np.ndarray       # per bucket
    weights: np.ndarray   # per bucket and language
    bias: np.ndarray
    temperature: float
    bits: int


_letters = None


def letter_table():
    """Per code point: its lower-case letter, or a blank."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters = table
    return _letters


def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def buckets(text, bits=15, piece=1 << 16):
    """(buckets, counts) of the n-grams of a whole text; empty without a letter."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_table()[codes]
    letter = letters != 32
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # One blank for each run of other characters, one at each end.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.concatenate([[32], letters[keep], [32] * int(letter[-1])]).astype(np.uint32)
    counts = np.zeros(1 << bits, np.int64)
    for start in range(0, len(chars), piece):
        part = chars[start:start + piece + max(SIZES) - 1]
        hashed = np.zeros(len(part), np.uint32)
        for n in SIZES:
            size = min(piece, len(part) - n + 1)
            if size <= 0:
                break
            hashed = hashed[:len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1:] * np.uint32(0x9E3779B1)
            index = (hashed[:size] + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
            counts += np.bincount(index, minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found, counts[found]


def vector(found, counts, idf):
    values = (1.0 + np.log(counts)) * idf[found]
    length = np.sqrt(values @ values)
    return values / length if length else values


def _softmax(scores):
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def ftrl(vectors, labels, languages, bits, alpha=2.0, beta=1.0, l1=0.02, l2=0.05, epochs=4, seed=5):
    """(weights, bias) after ``epochs`` passes of follow-the-regularised-leader."""
    size = (1 << bits) + 1  # the last is the bias
    z, n = np.zeros((size, languages)), np.zeros((size, languages))

    def weight(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            found, values = vectors[i]
            at, x = np.append(found, size - 1), np.append(values, 1.0)
            w = weight(at)
            off = _softmax(x @ w)
            off[labels[i]] -= 1.0
            g = x[:, None] * off
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    w = weight(np.arange(size))
    return w[:-1], w[-1]


def best_temperature(scores, labels):
    """The divisor of the scores with the least log loss; 1 without documents to tell.

    Every other language of a document counts as one label in all documents, so that
    a sample without errors does not make every later score certain.
    """
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.05, 20.0, 241)
    count, languages = scores.shape
    truth = np.full(scores.shape, 1.0 / (count + languages))
    truth[np.arange(count), labels] = (count + 1.0) / (count + languages)
    loss = [-(truth * np.log(np.maximum(_softmax(scores / t), 1e-300))).sum(axis=1).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


# ---- training ---------------------------------------------------------------

def document_frequencies(rows, bits):
    """(number of documents with a letter, documents per bucket) over all rows (text)."""

    def count(batches):
        documents, found_in = 0, np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found, _ = buckets(text.as_py(), bits)
                found_in[found] += 1
                documents += len(found) > 0
        at = np.flatnonzero(found_in)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found_in[at], documents))], ["bucket", "n"])

    # One row per bucket and task, then one per bucket.
    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found_in, documents = np.zeros(1 << bits, np.int64), 0
    for bucket, n in counted.collect():
        if bucket < 0:
            documents = n
        else:
            found_in[bucket] = n
    return documents, found_in


def learn(labelled, bits=15, per_language=500, max_languages=256, epochs=4):
    """Model from ``labelled`` (doc_id, text, lang); rows with a null in doc_id or lang are left out."""
    rows = labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    rows = rows.withColumn("check", F.xxhash64(F.coalesce("text", F.lit(""))))
    place = F.xxhash64("doc_id", "check")
    # Of rows that repeat id, text and language one counts, so a language is never drowned by copies.
    counts = dict(map(tuple, rows.groupBy("lang").agg(
        F.approx_count_distinct(place, 0.02)).limit(max_languages + 1).collect()))
    languages = sorted(counts)
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    documents, found_in = document_frequencies(rows, bits)
    idf = np.where(found_in > 0, np.log((1.0 + documents) / (1.0 + found_in)) + 1.0, 0.0)
    nothing = Model(languages, idf, np.zeros((1 << bits, len(languages))), np.zeros(len(languages)), 1.0, bits)
    if not documents:
        return nothing
    number = {language: i for i, language in enumerate(languages)}
    # Of a large language only about twice the wanted documents meet in the window.
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, 2.0 * per_language / max(n, 1)))])
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "check")
    drawn = rows.select("doc_id", "check", "lang", place.alias("place"))
    # Whatever the draw, the first document of every language is in the sample.
    first = drawn.groupBy("lang").agg(F.min(F.struct("place", "doc_id", "check")).alias("_first")).select(
        "_first.doc_id", "_first.check", "lang", "_first.place")
    drawn = drawn.where(F.pmod("place", F.lit(2 ** 30)) < share[F.col("lang")] * 2.0 ** 30)
    chosen = (
        drawn.unionByName(first).distinct()
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
        .select(F.col("doc_id").alias("_id"), F.col("check").alias("_check"), F.col("lang").alias("_lang"), "n")
    )
    # At most per_language * max_languages rows.
    same = (F.col("doc_id") == F.col("_id")) & (F.col("check") == F.col("_check")) & (F.col("lang") == F.col("_lang"))
    sample = rows.join(F.broadcast(cut(chosen)), same).groupBy("n", "lang").agg(F.min("text").alias("text"))

    def vectors(batches):
        for batch in batches:
            for n, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, counts = buckets(text, bits)
                if len(found):
                    yield pa.RecordBatch.from_pydict({
                        "n": pa.array([n], pa.int32()), "label": pa.array([number[lang]], pa.int32()),
                        "found": pa.array([found.astype(np.int32)], pa.list_(pa.int32())),
                        "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))})

    def fit(batches):
        learned, kept_out = ([], []), ([], [])
        for batch in batches:
            for n, label, found, counts in zip(*batch.columns, strict=True):
                to = kept_out if n.as_py() % 5 == 0 else learned
                found = found.values.to_numpy()
                to[0].append((found, vector(found, counts.values.to_numpy(), idf)))
                to[1].append(label.as_py())
        weights, bias = ftrl(*learned, len(languages), bits, epochs=epochs)
        scores = np.array([x @ weights[f] + bias for f, x in kept_out[0]])
        # Rows of the weights, then the bias (bucket -1), then the temperature (bucket -2).
        at, language = np.nonzero(weights)
        one = np.arange(len(languages))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([at, one * 0 - 1, [-2]])),
            pa.array(np.concatenate([language, one, [0]])),
            pa.array(np.concatenate([weights[at, language], bias, [best_temperature(scores, np.array(kept_out[1], int))]])),
        ], ["bucket", "language", "value"])

    fitted = (
        sample.select("n", "text", "lang").mapInArrow(vectors, "n int, label int, found array<int>, counts array<int>")
        .repartition(1).sortWithinPartitions("n", "label", F.hash("found"))
        .mapInArrow(fit, "bucket long, language long, value double")
    )
    weights, bias, temperature = nothing.weights, nothing.bias, 1.0
    for bucket, language, value in fitted.collect():
        if bucket >= 0:
            weights[bucket, language] = value
        elif bucket == -1:
            bias[language] = value
        else:
            temperature = value
    return Model(languages, idf, weights, bias, temperature, bits)


# ---- prediction -------------------------------------------------------------

def predict_text(text, model):
    """(language, probability) of one text."""
    found, counts = buckets(text, model.bits)
    if not len(found) or not model.languages or not model.idf.any():
        return UNKNOWN, 0.0
    scores = (vector(found, counts, model.idf) @ model.weights[found] + model.bias) / model.temperature
    chance = _softmax(scores)
    best = int(np.argmax(chance))
    return model.languages[best], float(min(1.0, chance[best]))


def predict(docs, model, id_col="doc_id", text_col="text"):
    """Rows (doc_id, lang_pred, score)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # A fixed size for any input: buckets times languages.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [predict_text(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id):
    """True for the quarter of documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs, **options):
    """Per document: doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs, **options):
    """``docs`` with a language, however near the second best is; all columns as they are. Only ``und`` goes."""
    model = learn(docs.where(~held_out(F.col("doc_id"))), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        return pd.Series([predict_text(t, shared.value)[0] != UNKNOWN for t in texts], dtype=bool)

    return docs.where(identified(F.col("text")))
