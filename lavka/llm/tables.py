"""Shared helpers: tables, lower-casing, running totals over any number of tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words are runs of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def free_names(rows, *names):
    """``names``, each with as many underscores in front as make it no column of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def one_of_alike(rows, keys):
    """One row per ``keys`` (null is a value): the one whose whole row has the smallest hash, the same in every run."""
    whole, first = free_names(rows, "_whole", "_first")
    every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    kept = rows.select(*keys, every.alias(whole)).groupBy(*[k for k in keys]).agg(
        F.min_by(whole, F.xxhash64(whole)).alias(first))
    return kept.select(*[F.col(f"{first}.`{c}`").alias(c) for c in rows.columns])


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text):
    """``text`` with A-Z lower-cased and every other character as it is.

    lower() on pure ASCII text is the same and much faster than translate().
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(rows, group, order, value, name):
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same group.

    Rows are range-partitioned by group and order, so that a hot group is spread
    over many tasks, and stored. Each range sums on its own; what lies before it
    in its group comes from one total per range and group. ``order`` must place
    rows that differ; rows alike in all of group and order may come in any order.
    """
    spark = rows.sparkSession
    ranged = cut(
        rows.repartitionByRange(shuffle_tasks(spark), *group, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_range").alias("_g_range"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    started = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_g_range")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (
        started.join(totals, same)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_range", "_inside", "_before", "_g_range", *[f"_g_{c}" for c in group])
    )
