import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lavka.llm import simhash_dedup as S


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{key: (fingerprint, smallest key reachable)} for {key: fingerprint}."""
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    values = np.array([prints[k] for k in keys], np.uint64)
    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = sorted((root(k), root(keys[j])))
            parent[b] = a
    return {k: root(k) for k in keys}


def test_the_code_is_perfect():
    words = S._codewords()
    weights = np.bitwise_count(words.astype(np.uint64))
    assert sorted(set(weights.tolist())) == [0, 7, 8, 11, 12, 15, 16, 23]
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    code = S._codewords()
    index, near = S.nearest_index(words), S.near_indices(words)
    for w, i, n in zip(words, index, near, strict=True):
        distance = np.bitwise_count((code ^ w).astype(np.uint64))
        assert distance[i] <= 3
        assert sorted(n[n >= 0]) == np.flatnonzero(distance <= 4).tolist()


def test_no_pair_within_three_bits_is_missed():
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(3000)]
    other = [b ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 3))) for b in base]
    a, b = (np.array(v, np.uint64).view(np.int64) for v in (base, other))
    index = dict.fromkeys(range(len(a)), frozenset())
    rows, keys = S._keys(a, True)
    assert len(rows) == 11 * len(a)
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        index[r] |= {k}
    hit = set()
    for r, k in zip(*(x.tolist() for x in S._keys(b, False)), strict=True):
        if k in index[r]:
            hit.add(r)
    assert len(hit) == len(a)


def test_fingerprint():
    for text in (None, "", " ", "a", "a B", "a b c", "x y z " * 400, "Éa b\u00a0c d\x0be", "ÀB " * 70000):
        assert S.fingerprint(S.shingle_hashes(text)) == plain_fingerprint(text)


def check(docs):
    rows = docs.collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    expected = brute_components(prints)
    found = S.near_duplicates(docs, block_rows=64).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted(
        (r.doc_id, f"{prints[r.doc_id]:016x}", expected[r.doc_id]) for r in rows)


def test_against_brute_force(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_crowded_keys_and_chains(spark):
    """Many fingerprints close to each other, in blocks smaller than the group."""
    random.seed(3)
    center, prints = random.getrandbits(64), {}
    for _ in range(700):
        prints[center ^ sum(1 << i for i in random.sample(range(64), random.randint(0, 4)))] = 1
    walk = random.getrandbits(64)
    for i in range(60):
        walk ^= 1 << (i % 64)
        prints[walk] = 1
    prints = dict(enumerate(prints))
    values = {k: v - (1 << 64) if v >> 63 else v for k, v in prints.items()}
    frame = spark.createDataFrame([(v,) for v in values.values()], "fp long")
    links = S.links(frame, 3, block_rows=100)
    found = {r.node: r.component for r in S.components(links).collect()}
    expected = brute_components(prints)
    groups, theirs = {}, {}
    for k, v in values.items():
        groups.setdefault(expected[k], set()).add(v)
        theirs.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).isEmpty()


def test_awkward_and_empty(awkward, empty):
    found = {(r.doc_id, r.fingerprint): r.component_id for r in S.near_duplicates(awkward).collect()}
    zero = "0" * 16
    assert {k: v for k, v in found.items() if k[1] == zero} == {(i, zero): 3 for i in (3, 4, 5, None)}
    assert {v for (i, _), v in found.items() if i in (1, 2)} == {1}
    left = S.drop_near_copies(awkward)
    assert left.columns == awkward.columns
    ids = sorted((r.doc_id for r in left.select("doc_id").collect()))
    assert 2 not in ids and 7 not in ids and 1 in ids and 6 in ids
    assert S.near_duplicates(empty).collect() == [] and S.drop_near_copies(empty).collect() == []


def test_one_row_of_each_component_stays(spark):
    """Repeated ids with different texts, null ids, repeated rows."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(5, a), (5, b), (3, b), (7, b), (None, b), (None, c), (None, c), (None, c + " "), (8, d), (8, d), (9, d.upper())]
    left = S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text.strip()) for r in left), key=str) == sorted([(5, a), (3, b), (None, c), (8, d)], key=str)
