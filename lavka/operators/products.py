"""Keyed maintenance of the product table from form input.

Form columns: article, product_name, unit, price, supplier, manufacturer,
category, discount, stock_quantity, description, photo (text cells). Supplier
and category must match an existing name exactly; otherwise the key is NULL.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka import schemas
from lavka.functions.numbers import money, unreadable, whole
from lavka.functions.text import blank_to_null, strip
from lavka.operators.cleaning import ABORT, SKIP, Cleaned, as_is, first_problem, product_checks, split, too_long
from lavka.operators.dims import exact_keys
from lavka.operators.gate import numbered_wrongly
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.sizing import lookup_side
from lavka.session import cut

COLUMNS = [f.name for f in schemas.PRODUCTS if f.name != "product_id"]


class Updated(NamedTuple):
    table: DataFrame
    rejects: DataFrame


class Deletion(NamedTuple):
    deleted: DataFrame
    blocked: DataFrame


def clean_forms(forms, row_no="row_no", *keep, stage=as_is):
    """Form rows as product columns, with the rows the table would refuse."""
    price, discount, stock = (
        money(F.col("price")), whole(F.col("discount")), whole(F.col("stock_quantity"))
    )
    rows = numbered_wrongly(forms, row_no).select(
        row_no,
        "_number",
        *keep,
        F.coalesce(strip(F.col("article")), F.lit("")).alias("product_art"),
        "product_name",
        blank_to_null(F.col("unit")).alias("product_unit"),
        price.alias("product_price"),
        blank_to_null(F.col("supplier")).alias("supp_name"),
        blank_to_null(F.col("manufacturer")).alias("product_manufac"),
        blank_to_null(F.col("category")).alias("categ_name"),
        F.coalesce(discount, F.lit(0)).alias("product_discount"),
        F.coalesce(stock, F.lit(0)).alias("product_stock"),
        F.col("description").alias("product_desc"),
        blank_to_null(F.col("photo")).alias("product_photo"),
        unreadable(F.col("price"), price).alias("_price"),
        unreadable(F.col("discount"), discount).alias("_discount"),
        unreadable(F.col("stock_quantity"), stock).alias("_stock"),
    )
    cleaned = split(rows, "products", first_problem(
        (F.col("_discount"), "bad_discount", ABORT),
        (F.col("_stock"), "bad_stock", ABORT),
        (F.col("_price"), "bad_price", ABORT),
        *product_checks(),
        (
            too_long("product_art", "product_name", "product_unit", "product_manufac",
                     "product_desc", "product_photo"),
            "too_long", ABORT,
        ),
    ), row_no, stage)
    return Cleaned(cleaned.rows.drop("_price", "_discount", "_stock"), cleaned.rejects)


def _with_keys(rows, suppliers, categories):
    return rows.join(exact_keys(suppliers, "supp_id", "supp_name"), "supp_name", "left").join(
        exact_keys(categories, "categ_id", "categ_name"), "categ_name", "left"
    )


def insert_products(forms, products, suppliers, categories):
    """New product rows with the next ids, in form order, and the refused forms."""
    cleaned = clean_forms(forms)
    new = number_rows(cleaned.rows, "row_no", "product_id", last_key(products, "product_id"))
    keyed = _with_keys(new, suppliers, categories)
    return Cleaned(keyed.select("row_no", "product_id", *COLUMNS), cleaned.rejects)


def update_products(changes, products, suppliers, categories):
    """Products after the changes: all columns of a changed product are replaced.

    Of several valid changes of a product the one with the highest
    ``change_no`` wins. A change of an unknown product does nothing and is
    reported.
    """
    cleaned = clean_forms(changes, "change_no", "product_id", stage=cut)
    # One change per product is left before the names are looked up; change numbers are unique.
    winners = cleaned.rows.groupBy("product_id").agg(F.max("change_no").alias("change_no")).select("change_no")
    new = cleaned.rows.join(lookup_side(winners, "change_no"), "change_no", "left_semi")
    last = _with_keys(new, suppliers, categories).select("product_id", F.struct(*COLUMNS).alias("new"))
    table = products.join(last, "product_id", "left").select(
        "product_id",
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS],
    )
    unknown = (
        cleaned.rows.select("change_no", "product_id")
        .join(products.select("product_id"), "product_id", "left_anti")
        .select(
            F.lit("products").alias("source"), F.col("change_no").alias("row_no"),
            F.lit("unknown_product").alias("reason"), F.lit(SKIP).alias("severity"),
        )
    )
    return Updated(table, cleaned.rejects.unionByName(unknown))


def delete_products(keys, products, items):
    """Which of the products can go; one that items point to is blocked.

    Item rows are reduced to their distinct products first: a hot product is
    one row per task by the time it is shuffled.
    """
    wanted = products.select("product_id").join(
        keys.select("product_id").distinct(), "product_id", "left_semi"
    )
    used = items.select("product_id").distinct()
    return Deletion(
        wanted.join(used, "product_id", "left_anti"), wanted.join(used, "product_id", "left_semi")
    )
