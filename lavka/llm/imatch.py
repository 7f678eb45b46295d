"""I-Match document fingerprints over randomised lexicons.

Terms are the words of a text, lower-cased, with ASCII punctuation as white space.
The lexicon is every term whose inverse document frequency ln(N / df) lies in a band;
both are exact over all documents. A text keeps its distinct lexicon terms (all its
distinct terms if fewer than ``least`` are in the lexicon), sorts them, and hashes
them once for each of several random subsets of the lexicon; a term's hash decides which
subsets it is in. The fingerprint is the list of these hashes. The first subset is
the whole lexicon, as in plain I-Match; the others have rates from 1/4 to 1/1024, so
that short and long texts both have subsets that a small change leaves alone. The likeness of two fingerprints is the share of equal hashes among the subsets
that are not empty in both; it is 1 for equal fingerprints.

Size of the lexicon. A term in the band occurs in at least N * exp(-high) documents, so there
are at most exp(high) times the mean number of distinct terms of a document, however
many documents there are (about 3,000 times 200 terms of 8 bytes, 5 MB, with
the default band), which is why it is broadcast.

Null text counts as empty; a text without terms has an empty fingerprint of zeros.
Equal texts have equal fingerprints. An empty table gives an empty result.
"""

import hashlib
import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lavka.llm.tables import shuffle_tasks

RATES = tuple(4.0 ** -n for n, times in enumerate((1, 3, 4, 8, 8, 8)) for _ in range(times))
# Terms of a text to lower-case and split: ASCII punctuation becomes a blank.
PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
EMPTY = "0" * 12
# A task's counts are passed on when it holds so many different terms.
HELD_TERMS = 400_000
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Lexicon(NamedTuple):
    terms: np.ndarray  # sorted 64-bit hashes
    rates: tuple
    seed: int
    least: int


def terms(text):
    """The distinct terms of a whole text."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split())


def _hashed(found):
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def document_frequencies(docs, text_col="text"):
    """Rows (term, n): 64-bit hash of a term and the number of documents it is in."""

    def count(batches):
        held = Counter()

        def passed_on():
            out = pa.RecordBatch.from_arrays([
                pa.array(_hashed(held).view(np.int64)), pa.array(np.fromiter(held.values(), np.int64, len(held)))],
                ["term", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(terms(text.as_py()))
                if len(held) >= HELD_TERMS:
                    yield passed_on()
        yield passed_on()

    return docs.select(text_col).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def build_lexicon(docs, low=2.0, high=8.0, rates=RATES, seed=11, least=3, text_col="text"):
    """Lexicon of the terms with low <= ln(N / df) <= high."""
    total = docs.count()
    counted = document_frequencies(docs, text_col)
    idf = F.log(F.lit(float(total)) / F.col("n"))
    found = counted.where((idf >= low) & (idf <= high)).select("term")
    inside = found.toPandas()["term"].to_numpy(np.int64).view(np.uint64)
    return Lexicon(np.sort(inside), tuple(rates), seed, least)


def sub_hashes(text, lexicon):
    """One 48-bit hash per subset, 0 where the text has no term in it."""
    hashed = np.sort(_hashed(terms(text)))
    if len(lexicon.terms) and len(hashed):
        at = np.minimum(np.searchsorted(lexicon.terms, hashed), len(lexicon.terms) - 1)
        inside = hashed[lexicon.terms[at] == hashed]
        if len(inside) >= lexicon.least:
            hashed = inside
    out = np.zeros(len(lexicon.rates), np.uint64)
    raw = hashed.astype("<u8")
    salts = np.array([(lexicon.seed * 1_000_003 + k + 1) * 0x9E3779B97F4A7C15 % 2 ** 64 for k in range(len(out))], np.uint64)
    limits = np.array([int(rate * 2 ** 32) for rate in lexicon.rates], np.uint64)
    # One row per subset: which of the terms are in it.
    draw = hashed[None, :] ^ salts[:, None]
    draw = (draw ^ draw >> np.uint64(30)) * np.uint64(MIX[0])
    draw = (draw ^ draw >> np.uint64(27)) * np.uint64(MIX[1])
    inside = draw >> np.uint64(32) < limits[:, None]
    for k in np.flatnonzero(inside.any(axis=1)).tolist():
        out[k] = (xxhash.xxh64_intdigest(raw[inside[k]].tobytes(), k) >> 16) or 1
    return out


def fingerprint(hashes):
    return "".join(f"{h:012x}" for h in hashes.tolist())


def likeness(a, b):
    """Share of equal hashes among the subsets that are not empty in both; 1 if all are."""
    filled = (a != 0) | (b != 0)
    return float((a[filled] == b[filled]).mean()) if filled.any() else 1.0


def edited(text, following):
    """``text`` with its last third replaced by the first as many code points of ``following``."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


# ---- each document beside the next one --------------------------------------

def in_sequence(docs, id_col="doc_id", text_col="text"):
    """Rows (bucket, guest, doc_id, text) in which each document is followed by the next one.

    The order is by descending id (null last), ties by text; the first document
    follows the last. Buckets are ranges of ids, as many as there are shuffle tasks; each
    gets the first document of the bucket after it as a guest. Which documents those are is known
    from one narrow pass, so texts are shuffled once and a guest is one row per bucket.
    """
    tasks = shuffle_tasks(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / tasks for i in range(1, tasks)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10_000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)
    rows = rows.withColumn("bucket", _bounds_above(F.col("doc_id"), bounds))
    # One row per bucket.
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return rows.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    # A head goes to the bucket before its own too, the very first one to the last.
    head, before = [NO_ID] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, h in enumerate(heads):
        head[h["bucket"]] = NO_ID if h["head"] is None else h["head"]
        before[h["bucket"]] = heads[i - 1]["bucket"]
    at = F.col("bucket") + 1
    is_head = F.coalesce(F.col("doc_id"), F.lit(NO_ID)) == F.element_at(_constants(head), at)
    own = F.struct(F.col("bucket").cast("long").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.element_at(_constants(before), at).alias("bucket"), F.lit(1).alias("guest"))
    return rows.select(
        F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("at"), "doc_id", "text",
    ).select("at.*", "doc_id", "text").repartitionByRange(len(heads), "bucket").sortWithinPartitions(
        "bucket", "guest", F.desc_nulls_last("doc_id"), "text")


# Stands for a null id among constants.
NO_ID = -2 ** 63


def _constants(values):
    """An array column of constants, one literal however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bounds_above(value, bounds):
    """How many of the falling ``bounds`` are not below ``value``; all of them for null.

    Searched in two steps, so that the work is the square root of their number.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) or 1
    above = F.size(F.filter(_constants(bounds[::step]), lambda b: b >= value))
    first = F.greatest(above - 1, F.lit(0)) * step
    found = first + F.size(F.filter(F.slice(_constants(bounds), first + 1, F.lit(step)), lambda b: b >= value))
    return F.when(value.isNull(), F.lit(len(bounds))).when(above == 0, F.lit(0)).otherwise(found).cast("int")


SCHEMA = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprints(docs, id_col="doc_id", text_col="text", **options):
    """Per document: doc_id, fingerprint."""
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, text_col=text_col, **options))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprint(sub_hashes(t.as_py(), shared.value)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def fingerprints_and_edits(docs, id_col="doc_id", text_col="text", **options):
    """Per document: its fingerprint, that of its edited text, and how alike both and the next document's are."""
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, text_col=text_col, **options))
    rows = in_sequence(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]]

    def run(batches):
        lexicon = shared.value
        bucket, waiting, closed = None, None, False

        def pair(one, following):
            doc_id, text, hashes = one
            changed = edited(text, following[1])
            new = sub_hashes(changed, lexicon)
            return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                    fingerprint(hashes), fingerprint(new), likeness(hashes, new), likeness(hashes, following[2]))

        for batch in batches:
            out = []
            for at, guest, doc_id, text in zip(*batch.columns, strict=True):
                at, guest = at.as_py(), guest.as_py()
                if at != bucket:
                    bucket, waiting, closed = at, None, False
                if closed:  # only the first guest is needed
                    continue
                text = text.as_py()
                one = (doc_id.as_py(), text, sub_hashes(text, lexicon))
                if waiting is not None:
                    out.append(pair(waiting, one))
                waiting, closed = one, guest == 1
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    types = [to_arrow_type(rows.schema["doc_id"].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")

