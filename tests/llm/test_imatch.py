import hashlib
import math
from collections import Counter

import numpy as np

from lavka.llm import imatch as I


def documents(spark, n=150):
    rng = np.random.default_rng(4)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, 40_000) % 3000]
    return spark.createDataFrame(
        [(i, " ".join(words[i * 200:i * 200 + int(rng.integers(1, 200))])) for i in range(n)], "doc_id long, text string")


def test_lexicon_holds_the_band(spark):
    docs = documents(spark)
    counts = Counter()
    rows = docs.collect()
    for r in rows:
        counts.update(I.terms(r.text))
    for low, high in ((2.0, 8.0), (1.0, 3.0), (0.0, 20.0), (30.0, 40.0)):
        inside = {t for t, n in counts.items() if low <= math.log(len(rows) / n) <= high}
        assert I.build_lexicon(docs, low, high).terms.tolist() == sorted(I._hashed(inside).tolist())


def test_counts_passed_on_early_are_the_same(spark, monkeypatch):
    docs = documents(spark)
    whole = sorted(map(tuple, I.document_frequencies(docs).collect()))
    assert sum(n for _, n in whole) == sum(len(I.terms(r.text)) for r in docs.collect())


def plain_hashes(text, lexicon):
    """Subset by subset, term by term."""
    import xxhash
    hashed = sorted(xxhash.xxh64_intdigest(t) for t in I.terms(text))
    known = set(lexicon.terms.tolist())
    inside = [h for h in hashed if h in known]
    hashed = inside if len(inside) >= lexicon.least else hashed
    whole, out = 2 ** 64, []
    for k, rate in enumerate(lexicon.rates):
        chosen = b""
        for h in hashed:
            d = h ^ (lexicon.seed * 1_000_003 + k + 1) * 0x9E3779B97F4A7C15 % whole
            d = (d ^ d >> 30) * I.MIX[0] % whole
            d = (d ^ d >> 27) * I.MIX[1] % whole
            if d >> 32 < int(rate * 2 ** 32):
                chosen += h.to_bytes(8, "little")
        out.append((xxhash.xxh64_intdigest(chosen, k) >> 16 or 1) if chosen else 0)
    return out


def brute(rows, lexicon):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[:len(text) - n] + following[:n]
        a, b, c = (plain_hashes(t, lexicon) for t in (text, changed, following))

        def like(x, y):
            pairs = [(p, q) for p, q in zip(x, y, strict=True) if p or q]
            return sum(p == q for p, q in pairs) / len(pairs) if pairs else 1.0

        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(f"{h:012x}" for h in a),
                    "".join(f"{h:012x}" for h in b), like(a, b), like(a, c)))
    return out


def test_against_brute_force(spark, awkward):
    for docs in (documents(spark).repartition(7), awkward):
        lexicon = I.build_lexicon(docs)
        expected = brute([(r.doc_id, r.text) for r in docs.collect()], lexicon)
        found = I.fingerprints_and_edits(docs).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_equal_texts_and_edits(spark):
    docs = documents(spark)
    rows = I.fingerprints_and_edits(docs).collect()
    assert sum(r.near_edited for r in rows) > 3 * sum(r.near_next for r in rows)
    by_text = {r.doc_id: r.text for r in docs.collect()}
    prints = {}
    for r in I.fingerprints(docs).collect():
        assert prints.setdefault(by_text[r.doc_id], r.fingerprint) == r.fingerprint


def test_one_document_follows_itself_and_empty(spark, empty):
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    row = I.fingerprints_and_edits(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b c d" + b" " + b"a b").hexdigest()
    assert I.fingerprints_and_edits(empty).collect() == [] and I.fingerprints(empty).collect() == []


def test_bounds_in_two_steps(spark):
    bounds = list(range(1000, 0, -7))
    values = [None, -5, 0, 1, 8, 500, 993, 994, 1000, 1001]
    frame = spark.createDataFrame([(v,) for v in values], "v long").select("v", I._bounds_above(I.F.col("v"), bounds).alias("n"))
    for r in frame.collect():
        assert r.n == (len(bounds) if r.v is None else sum(b >= r.v for b in bounds))
