"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is a stream: its documents in the order of a keyed digest of their ids,
cut into blocks of ``block_words`` words. A source's quota is the number of words
its target asks for; words beyond the end of the stream start it again (a second
epoch), so the quota is a number of whole blocks and one shorter block at the end.

The blocks are dealt to output shards of ``shard_blocks`` blocks by a binary tree:
a node holds how many blocks of each source its shards get together and how many
shards there are; its left child's share is one draw from the multivariate
hypergeometric distribution, the right child gets the rest. All quotas are thus
exact, at every node. A shard finds its share by walking down from the root; the
draws depend on the seed and the node alone, so shards need no exchange and a
repeated task gives the same. The walk also sums up what went to the shards on its
left, hence which draws of a source are the shard's. Draw number j takes block
(a * j + c) mod n of the source (a keyed permutation), so shards hold disjoint,
scattered blocks. Inside a shard, blocks are shuffled by a keyed digest.

Sizes, streams and pieces never meet in one task: a hot source is spread by its
running word counts. One row per source goes to the driver (``max_sources`` rows at
most, more is an error), nothing else does.

A null text has 0 words, a null source is a source of its own, placed last. Rows
that repeat a doc_id are separate documents. Documents without words take no part
(taken is 0). An empty table gives an empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka.llm.tables import WORD, free_names, one_of_alike, running_start, shuffle_tasks, word_count
from lavka.operators.sizing import lookup_side
from lavka.session import cut

WEIGHTS = (3, 1, 2)
MAX_EPOCHS = 2
MAX_SOURCES = 1_000_000
LARGEST_DRAW = 1_000_000_000  # blocks; numpy's draws end below


def targets(sizes, weights=WEIGHTS, share=1.5, most=MAX_EPOCHS):
    """Target words of each source, given the sources' sizes in code point order.

    The total is ``share`` times all words, split by weight. No target exceeds
    ``most`` times its source; what is above is shared out again by weight. Sources
    reach that limit in order of size by weight, so one pass over this order finds
    the common level of the others.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] * 1.0 / weight[i], i))
    left, weights_left, level = share * sum(sizes), sum(weight), None
    for i in order:
        level = left / weights_left
        if most * sizes[i] > level * weight[i]:
            break
        left, weights_left, level = left - most * sizes[i], weights_left - weight[i], None
    return [float(most * s) if level is None else min(float(most * s), level * w)
            for s, w in zip(sizes, weight, strict=True)]


def source_table(rows, weights, share, most, max_sources):
    """The sources with rank, size and target: one row each, in code point order, null last."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    # Strings are compared by code point in Python.
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in found]
    return [(i, r["source"], s, t) for i, (r, s, t) in
            enumerate(zip(found, sizes, targets(sizes, weights, share, most), strict=True))]


def draw(rng, here, n):
    """How many of ``n`` blocks are of each source: a multivariate hypergeometric draw.

    Numpy draws below 10^9 blocks. Above, sources are drawn one by one from the normal distribution of the
    same mean and variance, which at that size differs by less than a block's share could show; the
    counts are whole, within what is there, and add up to ``n`` in either case.
    """
    total = int(here.sum())
    if total < LARGEST_DRAW:
        return rng.multivariate_hypergeometric(here, n, method="marginals")
    left = np.zeros(len(here), np.int64)
    for i, own in enumerate(here.tolist()):
        rest = total - own
        if total < LARGEST_DRAW:
            found = int(rng.hypergeometric(own, rest, n)) if n else 0
        else:
            share = own / total
            spread = math.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
            found = round(n * share + spread * rng.standard_normal())
        left[i] = min(own, n, max(0, n - rest, found))
        total, n = rest, n - int(left[i])
    return left


def share_of(shard, shards, blocks, shard_blocks, seed):
    """(first draw, number of draws) per source of one shard: a walk down the splitting tree."""
    first, here = np.zeros(len(blocks), np.int64), np.array(blocks, np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        # Shards are full but for the last, so the left child's size is known.
        left = draw(np.random.default_rng([seed, low, high]), here, (middle - low) * shard_blocks)
        if shard < middle:
            here, high = left, middle
        else:
            first, here, low = first + left, here - left, middle
    return first, here


def _permutation(source, n, seed):
    """Multiplier and offset of a keyed permutation j -> (a * j + c) mod n."""
    draw = np.random.default_rng([seed, source, n])
    a = int(draw.integers(1, max(2, n)))
    while math.gcd(a, n) != 1:
        a += 1
    return a, int(draw.integers(0, n))


def dealt_blocks(spark, blocks, shard_blocks, seed):
    """Rows (shard, src, block): every block of every source's quota, once."""
    shards = -(-sum(blocks) // shard_blocks)
    keyed = [_permutation(i, n, seed) if n else (1, 0) for i, n in enumerate(blocks)]

    def deal(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, here = share_of(shard, shards, blocks, shard_blocks, seed)
                for src in np.flatnonzero(here):
                    a, c = keyed[src]
                    block = [(a * j + c) % blocks[src] for j in range(int(first[src]), int(first[src] + here[src]))]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([shard] * len(block), pa.int64()),
                        "src": pa.array([int(src)] * len(block), pa.int32()),
                        "block": pa.array(block, pa.int64())})

    return spark.range(shards).mapInArrow(deal, "shard long, src int, block long")


def mix(docs, weights=WEIGHTS, share=1.5, most=MAX_EPOCHS, block_words=1024, shard_blocks=1024, seed=7,
        max_sources=MAX_SOURCES):
    """The mix as (documents, pieces).

    ``documents``: doc_id, source, src, size, start, source_size, target; one row per
    document. ``pieces``: shard, position in the shard, src, start, doc_id, epoch,
    first_word, words: which words of which document go where. A piece never crosses
    a block, and a document is identified by (src, start).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_check"))
    rows = cut(rows.withColumn("_order", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))))
    sources = source_table(rows, weights, share, most, max_sources)
    known = spark.createDataFrame(
        [(i, s, int(n), t) for i, s, n, t in sources],
        T.StructType([T.StructField("src", T.IntegerType()), T.StructField("_source", rows.schema["source"].dataType),
                      T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    # At most max_sources rows, see source_table.
    documents = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["_source"])).drop("_source")
    documents = running_start(documents, ["src"], ["_order", "doc_id", "_check"], "size", "start").drop("_order")
    documents = cut(documents)

    quotas = [int(t) for _, _, _, t in sources]
    blocks = [-(-q // block_words) for q in quotas]
    quota = F.col("target").cast("long")
    span = documents.where("size > 0").select(
        "src", "start", "doc_id", "size", quota.alias("quota"),
        F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch"), "source_size",
    ).withColumn("low", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn(
        "high", F.least(F.col("low") + F.col("size"), "quota")).where("low < high")
    pieces = span.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))))
    begin = F.greatest("low", F.col("block") * block_words)
    pieces = pieces.select(
        "src", "block", "start", "doc_id", "epoch", (begin - F.col("low")).alias("first_word"),
        (F.least(F.col("high"), (F.col("block") + 1) * block_words) - begin).alias("words"),
    ).join(dealt_blocks(spark, blocks, shard_blocks, seed).hint("merge"), ["src", "block"])
    return documents, pieces


def shuffled(pieces, seed=7):
    """``pieces`` with their position in the shard: blocks in keyed order, a block's pieces together.

    A shard has shard_blocks blocks, so the sort of one shard is bounded.
    """
    order = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed), "src", "block"), "src", "block", "epoch", "start", "first_word")
    return pieces.withColumn("position", F.row_number().over(order) - 1)


def taken_words(docs, seed=7, **options):
    """Per document: doc_id, size, source_size, target and taken, the words the mix takes of it.

    The mix is written, every shard in its shuffled order, and what it takes is read back from it.
    """
    documents, pieces = mix(docs, seed=seed, **options)
    taken = cut(shuffled(pieces, seed)).groupBy("src", "start").agg(F.sum("words").alias("taken")).select(
        F.col("src").alias("_src"), F.col("start").alias("_start"), "taken")
    same = (F.col("src") == F.col("_src")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return documents.join(taken, same, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs, length_col=None, seed=7, **options):
    """``docs`` as the mix takes them, all columns as they are: one row per document and epoch.

    Rows come in the order of the mix: by shard, and in a shard by the shuffled place of a row's first piece. Where a
    quota ends inside a document (at most one per source), that row's text is
    the words taken, joined by one blank, and ``length_col`` (if given) its length. Of rows that
    repeat id, source and text, one carries the takes of all: the one whose columns hash to the
    smallest number. Columns may have any names.
    """
    documents, pieces = mix(docs, seed=seed, **options)
    place = F.min(F.struct("shard", "position")).alias("place")
    takes = cut(shuffled(pieces, seed)).groupBy("src", "start", "epoch").agg(F.sum("words").alias("words"), place).join(
        documents.where("size > 0").select("src", "start", "size", "doc_id", "source", "_check"), ["src", "start"])
    own_id, own_source, own_check, size, taken, at, same = free_names(
        docs, "_id", "_source", "_id_check", "_size", "_words", "_place", "_same")
    takes = takes.select(
        F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("_check").alias(own_check),
        F.col("size").alias(size), F.col("words").alias(taken), F.col("place").alias(at))
    check = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    alike = documents.groupBy(
        F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("_check").alias(own_check)).agg(
        F.count(F.lit(1)).alias(same)).where(f"{same} > 1").drop(same)
    key = (F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source))
           & (check == F.col(own_check)))
    if not alike.isEmpty():
        again = docs.join(alike, key, "left_semi").withColumn(own_check, check)
        docs = docs.join(alike, key, "left_anti").unionByName(
            one_of_alike(again, ["doc_id", "source", own_check]).drop(own_check))
    rows = docs.join(lookup_side(takes, own_id, own_check), key)
    part = F.col(taken) < F.col(size)
    words = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(taken).cast("int")))
    rows = rows.withColumn("text", F.when(part, words).otherwise(F.col("text")))
    if length_col:
        kind = docs.schema[length_col].dataType
        rows = rows.withColumn(length_col, F.when(part, F.length("text").cast(kind)).otherwise(F.col(length_col)))
    order = [F.col(f"{at}.shard"), F.col(f"{at}.position"), F.col(own_id), F.col(own_check)]
    rows = rows.repartitionByRange(shuffle_tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    return rows.drop(own_id, own_source, own_check, size, taken, at)
