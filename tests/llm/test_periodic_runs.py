import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa

from lavka.llm import periodic_runs as P
from lavka.llm.queries import op12_periodic_runs, planted_rounds
from lavka.llm.words import chunks, word_arrays


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    """All runs, period by period, smallest first."""
    runs, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            length = at - start + q
            if length >= max(6, 4 * q) and not any((start, length) == r[:2] for r in runs):
                runs.append((start, length, q))
            at += at == start
            at += at + q < n and words[at] != words[at + q]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def report(doc_id, words):
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    collapsed = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest, collapsed)


def planted(doc_id, words):
    code, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or code % 10 or not n:
        return words
    g = code // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def random_words(rng):
    out = []
    for _ in range(rng.randint(1, 4)):
        sigma = rng.choice([1, 2, 2, 3, 5])
        part = [rng.randrange(sigma) for _ in range(rng.randint(1, rng.choice([3, 8, 25])))]
        if rng.random() < 0.4:
            part = [rng.randrange(sigma) for _ in range(rng.randint(1, 4))] * rng.randint(1, 12) + part[:5]
        out += part * rng.randint(1, 9)
    return out[:300]


def test_runs_against_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        words = random_words(rng)
        assert list(map(tuple, P.runs_of(np.array(words)).T.tolist())) == brute(words), words


def test_long_runs():
    for words in ([7] * 5000, list(range(700)) * 5, ([1] * 300 + [2]) * 9, [1, 2] * 900 + [3] + [1, 2] * 900):
        assert list(map(tuple, P.runs_of(np.array(words)).T.tolist())) == brute(words)


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(333)
    tree = P.RangeSuccessor(values)
    low = rng.integers(0, 333, 2000)
    high = low + rng.integers(1, 334 - low)
    bound = rng.integers(0, 340, 2000)
    found = tree.next(low, high, bound)
    assert found.tolist() == [min((v for v in values[a:b].tolist() if v >= c), default=333)
                              for a, b, c in zip(low, high, bound, strict=True)]


def test_words():
    texts = [None, "", " ", "a", "Ab  c\x0b\x0cd\r\n", "é É Z", "x", " y"]
    array = pa.array(texts)[1:]
    for lower in (False, True):
        words, counts = word_arrays(array, lower)
        expected = [words_of("".join(c.lower() if c.isascii() and lower else c for c in t)) for t in texts[1:]]
        assert words.to_pylist() == [w.encode() for ws in expected for w in ws]
        assert counts.tolist() == [len(w) for w in expected]
    assert list(chunks(pa.array(["aaaa", None, "b" * 20, "cc", "d"]), 5)) == [(0, 2), (2, 3), (3, 5)]


def test_awkward_and_empty(awkward, empty):
    extra = awkward.unionByName(awkward.selectExpr(*[
        "concat('say ', repeat('na NA ', 9), 'boom') as text" if c == "text" else c for c in awkward.columns]))
    found = P.run_report(extra).collect()
    expected = [report(r.doc_id, words_of(r.text)) for r in extra.collect()]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert max(r.n_runs for r in found) >= 1
    assert P.run_report(empty).collect() == [] and planted_rounds(empty).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = [report(r.doc_id, planted(r.doc_id, words_of(r.text))) for r in docs if len(r.text or "") < 6_000]
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs) and sum(r[1] > 0 for r in expected) > 10
    assert [found[r[0]] for r in expected] == expected
