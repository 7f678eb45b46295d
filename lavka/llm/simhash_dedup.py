"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: bit i is set when it is set in more than half
of the XXH64 hashes of its word shingles. Documents are linked when their fingerprints
differ in at most 3 bits; a document's component is what can be reached by links.

Candidates. The fingerprint is cut into segments of 22, 21 and 21 bits, each a word of
23 bits for the binary Golay code, whose 4096 codewords have every word within
distance 3 of exactly one. If two words differ in at most one bit, the codeword
nearest to the first lies within distance 4 of the second; a word has 1 or 6
codewords that near. So one side of the join gives the index of the nearest codeword,
the other side all indices within 4, and no pair with at most one error is missed.

Pigeonhole. Three errors over three segments leave these cases, each with a kind of key:
  two segments without error             both as they are (42 or 43 bits)
  one without error, one with one error  the one as it is, the other's codeword (33)
  one error in each                      two codewords, and the half of the third
                                         segment without error as it is (34 or 35)
Keys of 33 bits and more keep chance candidates few even for billions of texts.
Every candidate pair is verified on all 64 bits.

Copies. Only distinct fingerprints take part, each with its smallest doc_id. Near
copies can still crowd one key; such a key is split by every fourth bit of the fingerprint in four
ways, of which three errors leave one as it is. Rows of a split key that is crowded still
are compared in blocks of ``block_rows``, any number of them, and a block reports links that
connect what it found connected (fewer than its rows), never all pairs. No candidate is dropped.

Components are found by alternating large-star and small-star steps on the links,
written to the shared folder after each round.

Null text counts as empty; a text without words has fingerprint 0 and is linked like
any other. Rows with a null doc_id get a fingerprint, and a null component if no
document with an id is reachable. Rows that repeat a doc_id are alike.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lavka.llm.tables import free_names, one_of_alike
from lavka.operators.sizing import broadcast_if_small, lookup_side
from lavka.session import cut

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit from below, bits
GENERATOR = 0b101011100011  # of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text, words=3, seed=42):
    """XXH64 of every run of ``words`` words; fewer words are one shingle."""
    # bytes.lower() and bytes.split() know ASCII letters and white space only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], np.uint64)


def fingerprint(hashes):
    """Bit i is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i:i + 65536]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs, words=3, seed=42, id_col="doc_id", text_col="text"):
    """Rows (doc_id, fp, check): the fingerprint as a signed 64-bit integer, and a hash that tells texts apart."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column(2)],
                ["doc_id", "fp", "check"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_check(F.col(text_col)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fp long, check long")


def text_check(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


# ---- the code ---------------------------------------------------------------

def _codewords():
    """All 4096 codewords; a codeword's top 12 bits are its index."""
    words = np.arange(4096, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return words | rest


def _syndrome(words):
    rest = np.array(words, np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _code_tables():
    """Per syndrome: the error of at most 3 bits, and all errors of at most 4 bits (padded with -1)."""
    nearest = np.zeros(2048, np.int64)
    near = [[] for _ in range(2048)]
    errors = [sum(1 << i for i in c) for n in range(5) for c in combinations(range(23), n)]
    for error, syndrome in zip(errors, _syndrome(errors).tolist(), strict=True):
        near[syndrome].append(error)
        if error.bit_count() <= 3:
            nearest[syndrome] = error
    table = np.full((2048, max(map(len, near))), -1, np.int64)
    for i, found in enumerate(near):
        table[i, :len(found)] = found
    return nearest, table


_tables = None


def code_tables():
    global _tables
    if _tables is None:
        _tables = _code_tables()
    return _tables


def nearest_index(words):
    """Index of the codeword within distance 3."""
    nearest, _ = code_tables()
    return (words ^ nearest[_syndrome(words)]) >> 11


def near_indices(words):
    """Indices of all codewords within distance 4, one row per word; -1 where there are fewer."""
    errors = code_tables()[1][_syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def _segments(fp):
    fp = fp.view(np.uint64)
    return [((fp >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]


def _keys(fp, index_side):
    """(row numbers, keys) of fingerprints: one key per kind, or all kinds' near keys."""
    parts = _segments(fp)
    rows = np.arange(len(fp))
    coded = [nearest_index(p)[:, None] if index_side else near_indices(p) for p in parts]
    out_rows, out_keys, kind = [], [], 0

    def add(*fields):
        """Fields are (values, bits); values of one dimension, or two for several keys."""
        nonlocal kind
        key, good = np.full((len(fp), 1), kind, np.int64), np.ones((len(fp), 1), bool)
        for values, bits in fields:
            values = values if values.ndim == 2 else values[:, None]
            key = ((key[:, :, None] << bits) | np.maximum(values, 0)[:, None, :]).reshape(len(fp), -1)
            good = (good[:, :, None] & (values >= 0)[:, None, :]).reshape(len(fp), -1)
        out_rows.append(np.broadcast_to(rows[:, None], key.shape)[good])
        out_keys.append(key[good])
        kind += 1

    for i, j in ((0, 1), (0, 2), (1, 2)):
        add((parts[i], 22), (parts[j], 22))
    for i in range(3):
        for j in range(3):
            if i != j:
                add((parts[i], 22), (coded[j], 12))
    for half in (parts[2] & 1023, parts[2] >> 10):
        add((coded[0], 12), (coded[1], 12), (half, 11))
    return np.concatenate(out_rows), np.concatenate(out_keys)


def keyed(fps, index_side):
    """Rows (key, fp) of a frame of distinct fingerprints."""

    def run(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(all_fp), 8192):
                fp = all_fp[i:i + 8192]
                rows, keys = _keys(fp, index_side)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


# ---- links ------------------------------------------------------------------

# Rows of a key up to which its pairs are simply joined.
FEW = 16


def _forest(left, right, bits):
    """Links (a, b) that connect what pairs of left x right within ``bits`` connect: a spanning forest."""
    values, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    left_at, right_at = where[:len(left)], where[len(left):]
    label = np.arange(len(values))
    links = []
    for value, at in zip(left, left_at, strict=True):
        met = right_at[np.bitwise_count((right ^ value).view(np.uint64)) <= bits]
        old = np.unique(label[met])
        for other in old[old != label[at]]:
            links.append((value, values[met[label[met] == other][0]]))
            label[label == other] = label[at]
    return links


def parted(rows):
    """Rows (key, fp) with four keys for each: the old one and every fourth bit of the fingerprint.

    Three errors leave one of four parts as it is.
    """
    every_fourth = 0x1111111111111111
    masks = [every_fourth << i if i < 3 else (every_fourth << i) - (1 << 64) for i in range(4)]
    parts = F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return rows.select(F.explode(parts).alias("key"), "fp")


def _met(index, query, bits):
    """(links, crowded): verified links from keys of up to FEW index rows, and the other keys, None if there are none.

    The list of crowded keys is broadcast if short, so that each side is shuffled once,
    for the join, whether or not there are any.
    """
    crowded = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW))
    none = crowded.isEmpty()
    if not none:
        crowded = broadcast_if_small(crowded)
        index, query = (side.join(crowded, "key", "left_anti") for side in (index, query))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits
    found = query.join(index.withColumnRenamed("fp", "other"), "key").where((F.col("other") < F.col("fp")) & close)
    return found.select(F.col("other").alias("a"), F.col("fp").alias("b")), None if none else crowded


def links(fps, bits=3, block_rows=2048):
    """Verified links (a, b), a < b, between distinct fingerprints.

    All pairs with at most ``bits`` <= 3 differing bits are connected by them, though
    within a crowded key not each by a link of its own.
    """
    if bits > 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    index, query = keyed(fps, True), keyed(fps, False)
    found, crowded = _met(index, query, bits)
    if crowded is not None:
        index, query = (cut(parted(side.join(crowded.select("key"), "key", "left_semi")).distinct()) for side in (index, query))
        more, crowded = _met(index, query, bits)
        found = found.unionByName(more)
    if crowded is not None:
        found = found.unionByName(crowded_links(index.join(crowded, "key"), query, bits, block_rows))
    return found.distinct()


def crowded_links(index, query, bits, block_rows):
    """Links of keys with many rows: the index side in blocks, each met by all query rows of its key."""
    sizes = index.groupBy("key").agg(F.max("_n").alias("_n"))
    blocks = F.ceil(F.col("_n") / block_rows).cast("int")
    left = index.select(
        "key", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"), F.lit(0).alias("side"), "fp")
    right = query.join(sizes, "key").select(
        "key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("side"), "fp")
    rows = left.unionByName(right).repartition("key", "block").sortWithinPartitions("key", "block", "side", "fp")

    def run(batches):
        """Rows of one (key, block) come together, its index side first; query rows are met in slices."""
        at, own, waiting = None, [], []

        def met():
            if not own or not waiting:
                return []
            return _forest(np.array(own, np.int64), np.array(waiting, np.int64), bits)

        def report(found):
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for key, block, side, fp in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
                if (key, block) != at:
                    yield from report(met())
                    at, own, waiting = (key, block), [], []
                if side == 0:
                    own.append(fp)
                else:
                    waiting.append(fp)
                    if len(waiting) >= 4 * block_rows:
                        yield from report(met())
                        waiting = []
        yield from report(met())

    return rows.mapInArrow(run, "a long, b long")


# ---- components -------------------------------------------------------------

def components(edges):
    """Rows (node, component) for edges (a, b): component is the smallest node reachable.

    Large-star links every larger neighbour of a node to the smallest node around it,
    small-star does so for the smaller neighbours; both keep what is connected
    connected, and end in stars after few rounds.
    """
    edges = cut(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select(
            F.col("a").alias("_a"), F.least("a", "_m").alias("m"))
        large = both.where("b > a").join(lookup_side(least, "_a"), F.col("a") == F.col("_a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lookup_side(least.select(F.col("a").alias("_a"), "m"), "_a"), F.col("a") == F.col("_a")).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        edges = cut(small)
        # Nothing has moved once rows and hashes are those of the round before.
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _members(docs, words, bits, seed, block_rows, id_col, text_col):
    """Per document: doc_id, fp, check, component_id and the component's smallest fingerprint as ``_component``."""
    rows = cut(fingerprints(docs, words, seed, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct, bits, block_rows))
    # The smallest doc_id of a component of fingerprints.
    member = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("_component"), "first_id")
    smallest = member.groupBy("_component").agg(F.min("first_id").alias("component_id"))
    by_fp = member.join(lookup_side(smallest.withColumnRenamed("_component", "_c"), "_c"), F.col("_component") == F.col("_c"))
    by_fp = by_fp.select("_fp", "component_id", "_component")
    return rows.join(lookup_side(by_fp, "_fp"), F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs, words=3, bits=3, seed=42, block_rows=2048, id_col="doc_id", text_col="text"):
    """Per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return _members(docs, words, bits, seed, block_rows, id_col, text_col).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs, words=3, bits=3, seed=42, block_rows=2048, id_col="doc_id", text_col="text"):
    """``docs`` with one row per component, the one with the smallest id; all columns as they are.

    A null id comes after any other. Of rows with that id the one with the smallest
    fingerprint, then the smallest hash of the text, stays; of rows that repeat both id
    and text the one whose columns hash to the smallest number, and only such rows are
    shuffled a second time. Columns may have any names.
    """
    stay_id, stay_check, repeats = free_names(docs, "_stay_id", "_stay_check", "_same")
    members = _members(docs, words, bits, seed, block_rows, id_col, text_col)
    alike = members.groupBy("_component", "doc_id", "fp", "check").agg(F.count(F.lit(1)).alias("same"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", "check", "same")
    stays = cut(alike.groupBy("_component").agg(F.min(first).alias("_first")).select(
        F.col("_first.doc_id").alias(stay_id), F.col("_first.check").alias(stay_check),
        F.col("_first.same").alias(repeats)))
    check = text_check(F.col(text_col))
    # Equal texts share a component, so id and text find one row, or rows alike in both.
    same_row = F.col(id_col).eqNullSafe(F.col(stay_id)) & (check == F.col(stay_check))
    single = docs.join(lookup_side(stays.where(f"{repeats} = 1"), stay_id, stay_check), same_row, "left_semi")
    if stays.where(f"{repeats} > 1").isEmpty():
        return single
    repeated = docs.join(stays.where(f"{repeats} > 1"), same_row, "left_semi")
    return single.unionByName(one_of_alike(repeated.withColumn(stay_check, check), [id_col, stay_check]).drop(stay_check))
