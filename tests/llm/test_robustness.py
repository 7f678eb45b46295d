"""Pipeline stages on columns with the names they use inside, on repeated rows, and on counts beyond any test table."""

import numpy as np
import pytest

from lavka.llm import exact_dedup, language_id, mixing, simhash_dedup

INSIDE = [
    "_stay_id", "_stay_check", "_same", "_id", "_source", "_id_check", "_size", "_words", "_place", "_check", "_text", "_row",
    "_run", "_whole", "_first", "_component", "_fp", "fp", "check", "same", "unknown", "digest", "key", "node", "component",
    "src", "epoch", "shard", "position", "block", "words", "place", "quota", "n", "_order", "_start", "_src",
]


@pytest.fixture(scope="module")
def clashing(spark, awkward):
    """Rows alike in id and text that differ elsewhere, and a column for every name used inside."""
    rows = awkward.unionByName(awkward.where("doc_id = 10 or doc_id is null").selectExpr(*[
        "'z' as source" if c == "source" else c for c in awkward.columns]))
    return rows.selectExpr("*", *[f"concat('{c}-', source, '-', n_chars) as {c}" for c in INSIDE])


STAGES = {
    "language": lambda docs: language_id.keep_identified(docs),
    "exact": lambda docs: exact_dedup.drop_exact_copies(docs),
    "near": lambda docs: simhash_dedup.drop_near_copies(docs),
    "mix": lambda docs: mixing.mixed_documents(docs, length_col="n_chars"),
}


@pytest.mark.parametrize("stage", list(STAGES))
def test_any_column_names_and_the_same_rows_in_every_run(clashing, stage):
    rows = STAGES[stage](clashing)
    assert rows.columns == clashing.columns
    found = sorted(map(str, rows.collect()))
    assert found and found == sorted(map(str, STAGES[stage](clashing.repartition(9)).collect()))
    assert STAGES[stage](clashing.where("1 = 0")).collect() == []


def test_rows_alike_but_for_their_source_keep_it(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d", "x"), (1, "a b c d", "y")] + [(i, "w " * i, "xyz"[i % 3]) for i in range(2, 40)],
        "doc_id long, text string, source string")
    documents, pieces = mixing.mix(docs)
    taken = documents.join(pieces.select("src", "start", "epoch").distinct(), ["src", "start"]).where("doc_id = 1")
    expected = sorted(r.source for r in taken.collect())
    found = sorted(r.source for r in mixing.mixed_documents(docs).where("doc_id = 1").collect())
    assert found == expected and "x" in found and "y" in found


def test_mixed_documents_come_in_the_order_of_the_mix(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(f"w{i}" for _ in range(40)), f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    options = {"block_words": 16, "shard_blocks": 8}
    documents, pieces = mixing.mix(docs, **options)
    first = {}
    for r in mixing.shuffled(pieces).join(documents.select("src", "start", "doc_id").withColumnRenamed("doc_id", "id"), ["src", "start"]).collect():
        place = (r.shard, r.position)
        first[r.id, r.epoch] = min(place, first.get((r.id, r.epoch), place))
    order = [k[0] for k in sorted(first, key=first.get)]
    assert [r.doc_id for r in mixing.mixed_documents(docs, **options).collect()] == order
    plan = mixing.taken_words(docs, **options)._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffled" not in plan and sorted(order) != order


def test_splitting_tree_beyond_a_billion_blocks():
    blocks, per = [7 * 10 ** 11, 3, 0, 2 * 10 ** 9, 10 ** 12 + 1], 1 << 20
    shards = -(-sum(blocks) // per)
    for shard in (0, 1, shards // 3, shards - 2, shards - 1):
        first, here = mixing.share_of(shard, shards, blocks, per, 3)
        size = per if shard < shards - 1 else sum(blocks) - per * (shards - 1)
        assert int(here.sum()) == size and (here >= 0).all() and (first >= 0).all()
        assert (first + here <= np.array(blocks)).all() and int(first.sum()) == shard * per
        again = mixing.share_of(shard, shards, blocks, per, 3)
        assert (again[0] == first).all() and (again[1] == here).all()
        if shard + 1 < shards:
            assert (mixing.share_of(shard + 1, shards, blocks, per, 3)[0] == first + here).all()
    # Shares are near those of the whole, as the distribution says.
    assert abs(here[0] / max(1, here.sum()) - blocks[0] / sum(blocks)) < 0.05
    first, _ = mixing.share_of(shards // 2, shards, blocks, per, 3)
    assert abs(first[4] / first.sum() - blocks[4] / sum(blocks)) < 1e-5


def test_sample_is_bounded_and_never_empty(spark):
    """A third and more of the rows with one id: with different texts, and copies of one text."""
    words = {"aa": ["alpha", "beta"], "bb": ["über", "straße"], "cc": ["ночь", "день"]}
    for hot in (17, 4, 123456):
        rows = [(hot, f"{words['aa'][i % 2]} {i}", "aa") for i in range(1500)] + [(hot, "über straße", "bb")] * 1500
        rows += [(i, f"{words['cc'][i % 2]} {i}", "cc") for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language_id.learn(docs, per_language=50)
        assert model.languages == ["aa", "bb", "cc"]
        for text, language in (("alpha beta", "aa"), ("über straße", "bb"), ("ночь день", "cc")):
            assert language_id.predict_text(text, model)[0] == language
