"""Tables laid out by a key once, so that joins and aggregates on the key need no shuffle later.

Rows are stored in buckets of the key, sorted by it, as an external table of the session's catalogue in the
shared folder. Tables of the same key and number of buckets meet bucket by bucket; a table without buckets is
shuffled to them alone. Take at least as many buckets as the session has shuffle partitions, or
Spark may prefer to shuffle both sides.

A key with very many rows would make its bucket as large. Such keys are kept apart, in a table without buckets
that the operators read in ranges. With small parts, keys that a task can hold are shuffled once, too, and told
apart there.
"""

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavka.operators.packing import PART_ROWS, large_keys
from lavka.session import shared_dir


class LaidOut(NamedTuple):
    usual: DataFrame
    hot: DataFrame | None  # rows of keys with more rows than a part, and without a key; None if there are none


def bucketed(rows, key, buckets, folder=None):
    """``rows`` stored in buckets of ``key`` and read back."""
    spark = rows.sparkSession
    name = f"laid_out_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(
        "path", f"{folder or shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def _told_apart(rows, key, buckets, part_rows, folder):
    """``rows`` in buckets, and those of keys with more than ``part_rows`` rows (or None): one shuffle, one write.

    No key has more rows than a task can hold. The latter are read from their own folder, as a table without buckets.
    """
    spark = rows.sparkSession
    name = f"laid_out_{uuid.uuid4().hex}"
    path = f"{folder or shared_dir(spark)}/{name}"
    several = F.count("*").over(Window.partitionBy(key)) > part_rows
    rows.repartition(buckets, key).withColumn("_apart", several).write.partitionBy("_apart").bucketBy(
        buckets, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    stored = spark.table(name)
    usual = stored.where(~F.col("_apart")).drop("_apart")
    if stored.where("_apart").isEmpty():
        return usual, None
    return usual, spark.read.schema(rows.schema).parquet(f"{path}/_apart=true")


def lay_out(rows, key, buckets, part_rows=PART_ROWS, folder=None):
    """``rows`` by ``key``, those of keys with more than ``part_rows`` rows apart."""
    keyed, unkeyed = rows.where(rows[key].isNotNull()), rows.where(rows[key].isNull())
    large = large_keys(keyed, key, max(part_rows, PART_ROWS))
    apart, hot = unkeyed, None
    if large is not None:
        apart = apart.unionByName(keyed.join(large, key, "left_semi"))
        keyed = keyed.join(large, key, "left_anti").select(*rows.columns)
    if large is not None or not unkeyed.isEmpty():
        path = f"{folder or shared_dir(rows.sparkSession)}/laid_out_{uuid.uuid4().hex}"
        apart.write.parquet(path)
        hot = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if part_rows >= PART_ROWS:
        return LaidOut(bucketed(keyed, key, buckets, folder), hot)
    usual, several = _told_apart(keyed, key, buckets, part_rows, folder)
    return LaidOut(usual, hot if several is None else several if hot is None else several.unionByName(hot))


def together(table):
    """All rows of a laid-out table, for operators that don't depend on the layout."""
    return table.usual if table.hot is None else table.usual.unionByName(table.hot)
