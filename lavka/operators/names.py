"""Sorted name lists of the dimensions."""

from pyspark.sql import functions as F


def name_list(table, id_col, name_col, collation=None):
    """All names in order; duplicates and the missing name stay.

    The id breaks ties, so equal names spread over several sort partitions.
    Without a collation names compare by code point.
    """
    key = F.collate(F.col(name_col), collation) if collation else F.col(name_col)
    return table.orderBy(key.asc_nulls_last(), id_col).select(name_col)


def manufacturer_names(products, collation=None):
    """Distinct non-blank manufacturers, trimmed."""
    name = F.trim("product_manufac")
    rows = products.select(name.alias("manufacturer_name")).where("manufacturer_name <> ''").distinct()
    key = F.col("manufacturer_name")
    return rows.orderBy(F.collate(key, collation) if collation else key)


def pickup_list(points):
    return points.select(
        F.col("pp_id").alias("pickup_point_id"), F.col("pp_name").alias("pickup_address")
    ).orderBy("pickup_point_id")
