"""Catalogue listing, search and point lookup."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from lavka.functions.text import search_pattern

SEARCHED = (
    "article", "product_name", "description", "category_name",
    "manufacturer_name", "supplier_name", "unit_name",
)


def catalog_rows(products, categories, suppliers):
    """Products with the names of their category and supplier, unsorted.

    The dimension sides carry no broadcast hint: Spark broadcasts them when
    their measured size allows it and shuffles (splitting hot keys) otherwise.
    """
    return (
        products.join(categories, "categ_id", "left")
        .join(suppliers, "supp_id", "left")
        .select(
            "product_id",
            F.col("product_art").alias("article"),
            "product_name",
            F.col("categ_name").alias("category_name"),
            F.col("product_desc").alias("description"),
            F.col("product_manufac").alias("manufacturer_name"),
            F.col("supp_name").alias("supplier_name"),
            F.col("product_price").alias("price"),
            F.col("product_unit").alias("unit_name"),
            F.col("product_stock").alias("stock_quantity"),
            F.col("product_discount").alias("discount"),
            F.col("product_photo").alias("photo"),
        )
    )


def search(catalog, text, literal=False):
    """Rows with the text in any searched column, whatever the case."""
    if not text.strip():
        return catalog
    pattern = search_pattern(text, literal)
    return catalog.where(reduce(or_, [F.col(c).ilike(pattern) for c in SEARCHED]))


def sort_catalog(catalog, order=None):
    """By stock (``asc`` or ``desc``), else by product id; ids break ties."""
    stock = {
        "asc": [F.col("stock_quantity").asc_nulls_last()],
        "desc": [F.col("stock_quantity").desc_nulls_first()],
    }.get(order, [])
    return catalog.orderBy(*stock, F.col("product_id"))


def list_catalog(products, categories, suppliers, text="", supplier=None, order=None, literal=False):
    """The catalogue page: every given filter applies, an empty one is left out."""
    rows = search(catalog_rows(products, categories, suppliers), text, literal)
    if supplier:
        rows = rows.where(F.col("supplier_name") == supplier)
    return sort_catalog(rows, order)


def product_by_id(products, categories, suppliers, product_id):
    return catalog_rows(products.where(F.col("product_id") == product_id), categories, suppliers)


def products_by_id(products, categories, suppliers, keys):
    """Batch form of the point lookup: the catalogue rows of all given ids.

    The ids are reduced to distinct ones before the shuffle, so a hot id does
    not travel more than once per task.
    """
    wanted = keys.select("product_id").distinct()
    return catalog_rows(products.join(wanted, "product_id", "left_semi"), categories, suppliers)
