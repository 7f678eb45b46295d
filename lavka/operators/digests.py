"""Differences of two large snapshots by digests: only buckets that differ are compared row by row.

A row's bucket comes from its key, its digest from all columns. The digests of a bucket's rows
add up to the bucket's (exclusive or, with the count); those of ``FANOUT`` neighbouring buckets to that of
their parent, and so on up to one root: a tree, one narrow row a node, which a snapshot is stored with. Two snapshots are
compared from the root down: children are looked at only below nodes that differ, so equal
parts cost nothing, and the rows of equal buckets are filtered out before the join.

A bucket passes for equal if its rows' 64-bit digests agree in exclusive or, sum of their upper
halves and number: for a change to be missed two of them would have to collide at once.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.operators.changes import change_feed
from lavka.operators.sizing import broadcast_if_small

FANOUT = 64
LEVELS = 3  # FANOUT ** LEVELS buckets at most


def bucket_of(key, levels=LEVELS):
    return F.pmod(F.xxhash64(key), F.lit(FANOUT ** levels)).cast("long")


def digest_tree(table, key, levels=LEVELS):
    """Rows (level, node, rows, xor, sum): level 0 is the root, ``levels`` the buckets; nodes without rows are left out."""
    columns = [F.col(c) for c in sorted(table.columns)]
    # Null and empty differ: the hash skips nulls, so their places are hashed, too.
    nulls = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    digest = F.xxhash64(*columns, nulls)
    leaves = table.select(bucket_of(F.col(key), levels).alias("node"), digest.alias("_d")).groupBy("node").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_d").alias("xor"),
        F.sum(F.shiftrightunsigned("_d", 32).cast("decimal(38,0)")).alias("sum"))
    nodes = [leaves.withColumn("level", F.lit(levels))]
    for level in range(levels - 1, -1, -1):
        up = nodes[-1].groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(
            F.sum("rows").alias("rows"), F.bit_xor("xor").alias("xor"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
        nodes.append(up.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, nodes).select("level", "node", "rows", "xor", "sum")


def changed_buckets(before, after, levels=LEVELS):
    """Buckets (node) in which two stored trees differ, found from the root down."""
    wanted = None
    for level in range(levels + 1):
        old, new = (tree.where(F.col("level") == level) for tree in (before, after))
        if wanted is not None:
            # Children of what differs: the other nodes of the level are not compared.
            parent = F.floor(F.col("node") / FANOUT).cast("long")
            old, new = (side.join(wanted, parent == F.col("_parent"), "left_semi") for side in (old, new))
        theirs = new.select("node", F.col("rows").alias("_rows"), F.col("xor").alias("_xor"), F.col("sum").alias("_sum"))
        same = F.col("rows").eqNullSafe(F.col("_rows")) & F.col("xor").eqNullSafe(F.col("_xor")) & F.col("sum").eqNullSafe(F.col("_sum"))
        differing = old.join(theirs, "node", "full").where(~same).select("node")
        wanted = broadcast_if_small(differing.withColumnRenamed("node", "_parent"))
    return differing


def change_feed_by_digest(before, after, key, trees, levels=LEVELS):
    """``change_feed`` of two snapshots with their stored trees: rows of equal buckets are not joined."""
    wanted = broadcast_if_small(changed_buckets(*trees, levels).withColumnRenamed("node", "_node"))
    old, new = (
        side.join(wanted, bucket_of(F.col(key), levels) == F.col("_node"), "left_semi") for side in (before, after))
    return change_feed(old, new, key)
