"""Lookup sides of joins: broadcasts backed by a count, and shuffles that may be split."""

from pyspark.sql import functions as F

# Rows up to which a narrow frame is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000


def broadcast_if_small(rows, limit=BROADCAST_ROWS):
    """Mark a derived dimension for broadcast after counting that it is small.

    Stored tables need no such mark, Spark knows the size of their files. A
    dimension computed from a large table (such as its distinct values) looks
    as large as that table until it has run.
    """
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def lookup_side(keys, *on):
    """Let the join on ``on`` that follows shuffle the aggregated keys anew.

    A join that reuses the partitioning of an aggregate is left alone by
    adaptive execution. With a shuffle of its own on both sides it may split
    the partitions of hot keys on the large side. The keys are spread by
    another hash, so that Spark does not take them for partitioned already.
    """
    return keys.repartition(F.xxhash64(*on))
