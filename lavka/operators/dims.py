"""Dimension keys: look up a name, create the missing ones."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.functions.text import blank_to_null
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.sizing import lookup_side
from lavka.session import cut


class Dimension(NamedTuple):
    created: DataFrame  # new rows for the table
    keys: DataFrame  # every known name (trimmed) with its key


def exact_keys(table, key, name):
    """Name -> smallest key with exactly that name."""
    keys = table.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(key).alias(key))
    return lookup_side(keys, name)


def _trimmed(table, key, name, out):
    return (
        table.where(F.col(name).isNotNull())
        .groupBy(F.trim(name).alias(out))
        .agg(F.min(key).alias(key))
    )


def trimmed_keys(table, key, name, out):
    """Trimmed name -> smallest key; one row per name, combined before the shuffle."""
    return lookup_side(_trimmed(table, key, name, out), out)


def get_or_create(table, key, name, incoming, cell, row_no="row_no"):
    """Keys for the names in ``incoming[cell]``, with rows for those not in the table.

    Names are matched after trimming. New keys follow the order in which the
    names first appear, so running the same input again creates nothing.
    """
    # Both sides of the anti join have one row per name; only the join of the rows can be skewed.
    known = _trimmed(table, key, name, "name")
    wanted = (
        incoming.select(blank_to_null(F.col(cell)).alias("name"), F.col(row_no).alias("first_row"))
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min("first_row").alias("first_row"))
    )
    # Few rows out of a whole file, read again by every use of the keys.
    missing = cut(wanted.join(known, "name", "left_anti"))
    # Names that first appear in one row, or in none with a number, go by name.
    missing = missing.withColumn("first_row", F.coalesce("first_row", F.lit(2 ** 63 - 1)))
    fresh = number_rows(missing, ["first_row", "name"], key, last_key(table, key))
    return Dimension(
        created=fresh.select(key, F.col("name").alias(name)),
        keys=lookup_side(known.unionByName(fresh.select("name", key)), "name"),
    )


def attach_key(rows, cell, dimension):
    """Add the dimension key of a text cell; blank gives NULL."""
    return rows.withColumn("name", blank_to_null(F.col(cell))).join(
        dimension.keys, "name", "left"
    ).drop("name")
