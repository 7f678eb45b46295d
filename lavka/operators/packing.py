"""Ordered rows of a key packed into cells of bounded size.

Row number n of a key, counted from 0 in the given order, belongs to part
n div ``part_rows``: that is the one rule for every key, so parts have no gaps and do
not depend on the partitioning. Keys with at most ``part_rows`` rows have part 0 only.
Keys that a task can hold (``PART_ROWS`` rows, however small the parts are) are
shuffled once and cut into their parts there. A larger key is not gathered anywhere: its
rows are sorted in ranges over all tasks, and their numbers come from one count per range.
Reading the parts in order gives the whole sequence.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.operators.numbering import ranged
from lavka.operators.sizing import BROADCAST_ROWS, lookup_side
from lavka.session import cut

PART_ROWS = 4096


def _keys_beyond(rows, key, size):
    return rows.groupBy(key).count().where(F.col("count") > size).select(key)


def large_keys(rows, key, part_rows=PART_ROWS):
    """Keys with more rows than one part holds, or None when there are none.

    One counting job over the key column; it combines before the shuffle, so a
    hot key costs one counter per task.
    """
    large = cut(_keys_beyond(rows, key, part_rows))
    found = large.limit(BROADCAST_ROWS + 1).count()
    if not found:
        return None
    return F.broadcast(large) if found <= BROADCAST_ROWS else lookup_side(large, key)


def _gathered(rows, key, packed):
    """Aggregate once, after the shuffle: packing before it would save no bytes."""
    return rows.repartition(key).groupBy(key).agg(packed)


def _gathered_parts(rows, key, order, packed, part_rows, several=None):
    """Number the rows of each key after their one shuffle and aggregate its parts there; a task holds a key at a time.

    With ``several``, keys that are not in it are one part.
    """
    rows = rows.repartition(key)
    part = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / part_rows)
    if several is not None:
        # The keys are partitioned like the rows by their aggregate, which the join reuses.
        rows = rows.join(several.select(key, F.lit(True).alias("_several")), key, "left")
        part = F.when(F.col("_several"), part).otherwise(0)
    return rows.withColumn("part", part).groupBy(key, "part").agg(packed)


def with_number(rows, key, order):
    """``rows`` with ``_n``: the row's number among those of its key, from 0."""
    stored = ranged(rows, key, order)
    # A key's rows in a range are neighbours; what is before them is one count per key and range.
    counts = stored.groupBy(key, "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        key, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return stored.join(counts, [key, "_range"]).withColumn("_n", F.col("_place") + F.col("_shift")).drop(
        "_range", "_place", "_shift")


def pack(rows, key, order, packed, part_rows=PART_ROWS, probe=None, task_rows=PART_ROWS, cut_all=False):
    """One row per key and part, holding the aggregate column ``packed``.

    ``order`` is a column unique within a key. ``probe`` is a cheaper frame
    with at least as many rows per key as ``rows``, for the size check: a key that
    fits a part there is one part, unless ``cut_all``. A task gathers keys with at most
    ``task_rows`` rows, and those that are one part.
    """
    large = large_keys(rows if probe is None else probe, key, max(part_rows, task_rows))

    def whole(some):
        if part_rows < task_rows:
            several = None if probe is None or cut_all else _keys_beyond(probe, key, part_rows)
            return _gathered_parts(some, key, order, packed, part_rows, several)
        return _gathered(some, key, packed).select("*", F.lit(0).cast("long").alias("part"))

    if large is None:
        return whole(rows)
    parts = pack_large(rows.join(large, key, "left_semi"), key, order, packed, part_rows)
    ordinary = whole(rows.join(large, key, "left_anti"))
    return ordinary.unionByName(parts.select(*ordinary.columns))


def pack_large(rows, key, order, packed, part_rows=PART_ROWS):
    """One row per key and part, for keys of any size; no key is gathered."""
    numbered = with_number(rows, key, order).withColumn("part", F.floor(F.col("_n") / part_rows))
    return numbered.groupBy(key, "part").agg(packed)


def pack_laid_out(rows, key, packed):
    """One row per key, part 0, for rows laid out by the key whose keys all fit one part: no shuffle."""
    return rows.groupBy(key).agg(packed).select("*", F.lit(0).cast("long").alias("part"))
