"""Bulk import steps: landing rows -> new table rows and rejects.

Each step cleans its input once and keeps the checked rows in the shared folder.
"""

from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.functions.numbers import is_number, unreadable, whole
from lavka.operators.cleaning import ABORT, SKIP, clean_orders, clean_products, clean_users
from lavka.operators.dims import attach_key, get_or_create
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.ordering import HEADER
from lavka.operators.products import COLUMNS
from lavka.operators.resolve import item_rejects, lenient_items, resolve_items
from lavka.operators.users import new_users
from lavka.session import cut


class UserImport(NamedTuple):
    users: DataFrame
    rejects: DataFrame


class ProductImport(NamedTuple):
    products: DataFrame
    suppliers: DataFrame
    categories: DataFrame
    rejects: DataFrame


class OrderImport:
    """Headers are numbered at once; items are resolved when they are first asked for."""

    def __init__(self, orders, pickup_points, statuses, header_rejects, items):
        self.orders, self.pickup_points, self.statuses = orders, pickup_points, statuses
        self._header_rejects, self._make_items = header_rejects, items

    @cached_property
    def _items(self):
        return self._make_items()

    @property
    def order_items(self):
        return self._items[0]

    @property
    def rejects(self):
        return self._header_rejects.unionByName(self._items[1])


def import_users(raw, users, salt):
    cleaned = clean_users(raw, salt, cut)
    return UserImport(new_users(cleaned.rows, users), cleaned.rejects)


def import_products(raw, products, suppliers, categories):
    """Products are always appended; missing suppliers and categories are created."""
    cleaned = clean_products(raw, cut)
    supplier_keys = get_or_create(suppliers, "supp_id", "supp_name", cleaned.rows, "supp_name")
    category_keys = get_or_create(categories, "categ_id", "categ_name", cleaned.rows, "categ_name")
    rows = number_rows(cleaned.rows, "row_no", "product_id", last_key(products, "product_id"))
    keyed = attach_key(attach_key(rows, "supp_name", supplier_keys), "categ_name", category_keys)
    return ProductImport(
        keyed.select("row_no", "product_id", *COLUMNS),
        supplier_keys.created,
        category_keys.created,
        cleaned.rejects,
    )


def _numbered_items(headers):
    """Items given by product number; only for orders without an item text.

    A missing product number, or text that is no number, means no item; a number that
    is no product key at all is refused. A quantity below 1 or a missing one counts as
    1; an unreadable quantity is refused.
    """
    number, quantity = whole(F.col("product_no")), whole(F.col("quantity"))
    return headers.where(F.col("order_text").isNull() & is_number(F.col("product_no"))).select(
        "row_no",
        "order_id",
        F.lit(0).alias("pos"),
        number.cast("long").alias("product_id"),
        F.greatest(F.coalesce(quantity, F.lit(1)), F.lit(1)).alias("product_quantity"),
        F.when(number.isNull(), "bad_product_number")
        .when(unreadable(F.col("quantity"), quantity), "bad_quantity").alias("_bad"),
    )


def import_items(headers, products, order_items):
    """Items of imported headers (row_no, order_id, item cells) and their rejects."""
    written = headers.where(F.col("order_text").isNotNull())
    resolved = cut(resolve_items(written, products, "order_id"))
    from_text = lenient_items(resolved).select(
        "row_no", "order_id", "pos", "product_id", F.col("qty").alias("product_quantity")
    )
    by_number = _numbered_items(headers)
    readable = by_number.where(F.col("_bad").isNull()).drop("_bad")
    known = products.select("product_id")
    items = from_text.unionByName(readable.join(known, "product_id", "left_semi"))
    numbered = number_rows(
        items, ["row_no", "pos"], "order_item_id", last_key(order_items, "order_item_id")
    )
    text_rejects = item_rejects(resolved).select(
        F.lit("order_items").alias("source"), "row_no", F.col("problem").alias("reason"),
        F.when(F.col("problem") == "unknown_article", SKIP).otherwise(ABORT).alias("severity"),
    )
    number_rejects = by_number.where("_bad is not null").select("row_no", F.col("_bad").alias("reason")).unionByName(
        readable.join(known, "product_id", "left_anti").select(
            "row_no", F.lit("unknown_product").alias("reason")
        )
    ).select(F.lit("order_items").alias("source"), "row_no", "reason", F.lit(ABORT).alias("severity"))
    return (
        numbered.select("row_no", "order_item_id", "order_id", "product_id", "product_quantity"),
        text_rejects.unionByName(number_rejects),
    )


def import_orders(raw, addresses, orders, order_items, products, points, statuses):
    """Order headers and items; missing pickup points and statuses are created."""
    cleaned = clean_orders(raw, cut, addresses)
    headers = number_rows(cleaned.rows, "row_no", "order_id", last_key(orders, "order_id"))
    point_keys = get_or_create(points, "pp_id", "pp_name", headers, "pickup_address")
    status_keys = get_or_create(statuses, "status_id", "status_name", headers, "status_name")
    keyed = attach_key(attach_key(headers, "pickup_address", point_keys), "status_name", status_keys)
    return OrderImport(
        keyed.select("row_no", "order_id", *HEADER),
        point_keys.created,
        status_keys.created,
        cleaned.rejects,
        lambda: import_items(headers, products, order_items),
    )


def outcome(stage, rows):
    """Count of rows a stage has added."""
    return rows.agg(F.count("*").alias("rows")).select(
        F.lit(stage).alias("stage"), F.lit("imported").alias("outcome"), F.lit("").alias("reason"), "rows"
    )


def outcomes(spark, counts):
    """The same of counts known already, such as those observed while the rows were written."""
    return spark.createDataFrame(
        [(stage, "imported", "", rows) for stage, rows in counts.items()], "stage string, outcome string, reason string, rows long")


def summary(rejects, empty_orders=None, counts=None, **stages):
    """Rows imported and refused per stage and reason, and orders left without items.

    ``counts`` are stages whose rows have been counted.
    """
    out = rejects.groupBy("source", "severity", "reason").agg(F.count("*").alias("rows")).select(
        F.col("source").alias("stage"), F.col("severity").alias("outcome"), "reason", "rows"
    )
    if counts:
        out = out.unionByName(outcomes(rejects.sparkSession, counts))
    for stage, rows in stages.items():
        out = out.unionByName(outcome(stage, rows))
    if empty_orders is not None:
        out = out.unionByName(outcome("orders", empty_orders).withColumn("outcome", F.lit("without_items")))
    return out


def orders_without_items(orders, items):
    return orders.join(items.select("order_id").distinct(), "order_id", "left_anti")
