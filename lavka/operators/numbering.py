"""Dense surrogate keys in insertion order, and sums over earlier rows, without a one-task sort.

Rows are range-partitioned by their order, sorted and stored with their place in
the range. What lies before a range is one total per range, as many numbers as there
are shuffle tasks, whatever the row numbers look like.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.session import cut

# monotonically_increasing_id() counts a partition's rows in its lower bits.
_PLACE_BITS = 33


def last_key(table, key):
    """Largest key of a table (0 when empty), as a scalar column."""
    return F.coalesce(table.agg(F.max(key).cast("long")).scalar(), F.lit(0).cast("long"))


def ranged(rows, *order):
    """``rows`` in ranges of ``order``, stored, with ``_range`` and ``_place`` (from 0) in it."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    stored = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    return stored.withColumns({
        "_range": F.shiftright("_at", _PLACE_BITS).cast("int"),
        "_place": F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
    }).drop("_at")


def number_rows(rows, order, key, base, **counted):
    """Add ``key`` = base + 1, base + 2, ... in the order of ``order``.

    The order columns are unique together (see operators.gate), so the keys depend on
    the data alone, and a task that runs again gives the same ones.

    ``counted`` maps further columns to (base, weight): they get base plus the
    running sum of the weight up to and including the row.
    """
    order = [order] if isinstance(order, str) else list(order)
    weights = {name: weight for name, (_, weight) in counted.items()}
    stored = ranged(rows.withColumns({f"_w_{n}": w.cast("long") for n, w in weights.items()}), *order)
    totals = stored.groupBy("_range").agg(
        F.count("*").alias("_rows"), *[F.sum(f"_w_{n}").alias(f"_w_{n}") for n in weights]
    ).collect()  # one row per range
    before, starts = [0] * (1 + len(weights)), []
    for total in sorted(map(tuple, totals)):
        starts.append((total[0], *before))
        before = [a + (b or 0) for a, b in zip(before, total[1:])]
    names = ["_start", *[f"_start_{n}" for n in weights]]
    start = rows.sparkSession.createDataFrame(
        starts, ", ".join(["_range int", *[f"{n} long" for n in names]]))
    out = stored.join(F.broadcast(start), "_range").withColumn(
        key, base + F.col("_start") + F.col("_place") + 1)
    if weights:
        so_far = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({
            n: counted[n][0] + F.col(f"_start_{n}") + F.sum(f"_w_{n}").over(so_far) for n in weights})
    return out.drop("_range", "_place", *names, *[f"_w_{n}" for n in weights])
