import collections
import re

import numpy as np
import pytest

from lavka.llm import mixing
from lavka.llm.mixing import dealt_blocks, mix, mixed_documents, share_of, shuffled, taken_words, targets


def brute_targets(sizes):
    """Share out, cap, share the excess again until nothing is above its limit."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    capped, total = set(), 1.5 * sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(2 * sizes[i] for i in capped)
        level = left / sum(weight[i] for i in free) if free else 0
        above = {i for i in free if level * weight[i] >= 2 * sizes[i]}
        if not above:
            return [2.0 * s if i in capped else level * weight[i] for i, s in enumerate(sizes)]
        capped |= above


@pytest.mark.parametrize("sizes", [[], [0], [5], [10, 10, 10], [1000, 1, 1, 0], [3, 900, 20, 7, 7, 7], [0, 0]])
def test_targets(sizes):
    assert targets(sizes) == pytest.approx(brute_targets(sizes))


def test_splitting_tree_is_exact_and_repeatable():
    blocks, per = [70, 0, 333, 5], 16
    shards = -(-sum(blocks) // per)
    shares = [share_of(i, shards, blocks, per, 3) for i in range(shards)]
    assert np.sum([h for _, h in shares], axis=0).tolist() == blocks
    assert [int(h.sum()) for _, h in shares] == [per] * (shards - 1) + [sum(blocks) - per * (shards - 1)]
    ends = np.zeros(4, int)
    for first, here in shares:
        assert (first == ends).all()
        ends += here
    assert all((a[1] == share_of(i, shards, blocks, per, 3)[1]).all() for i, a in enumerate(shares))


def test_blocks_are_dealt_once(spark):
    rows = dealt_blocks(spark, [50, 0, 31], 8, 1).collect()
    assert collections.Counter((r.src, r.block) for r in rows) == {
        **{(0, b): 1 for b in range(50)}, **{(2, b): 1 for b in range(31)}}
    assert collections.Counter(r.shard for r in rows) == {**dict.fromkeys(range(10), 8), 10: 1}


def documents(spark, n=400):
    return spark.createDataFrame(
        [(i, " ".join(["w"] * (i * 37 % 90)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(n)],
        "doc_id long, text string, source string")


def test_taken_words_meet_the_targets(spark):
    rows = taken_words(documents(spark), block_words=16, shard_blocks=8).collect()
    taken, target, size = collections.Counter(), {}, {}
    for r in rows:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(taken[s] == int(target[s]) for s in target)
    again = taken_words(documents(spark).repartition(13), block_words=16, shard_blocks=8).collect()
    assert sorted(rows) == sorted(again)


def test_pieces_cover_each_block_once(spark):
    _, pieces = mix(documents(spark), block_words=16, shard_blocks=8)
    rows = shuffled(pieces).collect()
    words = collections.Counter()
    for r in rows:
        words[r.src, r.block] += r.words
    assert set(words.values()) - {16} == {w for k, w in words.items() if w != 16}
    assert sum(w != 16 for w in words.values()) <= 8  # the last block of a quota
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())


def test_mixed_documents(spark, awkward):
    docs = documents(spark)
    taken = {r.doc_id: r for r in taken_words(docs, block_words=16, shard_blocks=8).collect()}
    found = collections.Counter()
    for r in mixed_documents(docs, block_words=16, shard_blocks=8).collect():
        found[r.doc_id] += len(r.text.split())
    assert found == {i: r.taken for i, r in taken.items() if r.taken}
    rows = mixed_documents(awkward, length_col="n_chars")
    assert rows.columns == awkward.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows.collect())
    assert words == sum(r.taken for r in taken_words(awkward).collect())


def test_awkward_and_empty(awkward, empty):
    rows = taken_words(awkward).collect()
    assert len(rows) == awkward.count() and all(r.taken <= 2 * r.size for r in rows)
    assert all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert taken_words(empty).collect() == [] and mixed_documents(empty).collect() == []


def test_same_as_sql(spark, tables):
    from lavka.llm.queries import ORACLE, QUERIES
    found = QUERIES["op7_source_mixing"](spark, "/root/testdata/sf0.001")
    result = tables.execute(ORACLE["op7_source_mixing"])
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(result.fetchall())


def test_too_many_sources(spark):
    with pytest.raises(ValueError, match="sources"):
        mix(documents(spark), max_sources=3)
    assert mixing.MAX_EPOCHS == 2
