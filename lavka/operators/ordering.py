"""Keyed maintenance of orders and their items from form input.

Form columns: product_article (the order line), status_name, pickup_point_id,
receiver_code, user_name, order_date, delivery_date. An order is taken whole or
refused: its line must hold an item, and every article must exist.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka import schemas
from lavka.functions.numbers import typed_code
from lavka.functions.text import bad_quantity, blank_to_null, entry_article, entry_quantity, order_entries, strip
from lavka.operators.cleaning import ABORT, first_problem, split, too_long
from lavka.operators.dims import exact_keys
from lavka.operators.gate import numbered_wrongly
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.products import Deletion
from lavka.operators.resolve import article_keys
from lavka.operators.sizing import lookup_side
from lavka.session import cut

HEADER = [f.name for f in schemas.ORDERS if f.name != "order_id"]


class Placed(NamedTuple):
    headers: DataFrame
    items: DataFrame
    rejects: DataFrame


class Replaced(NamedTuple):
    orders: DataFrame
    items: DataFrame
    rejects: DataFrame


def _refused(rows, row_no, reason):
    return rows.select(
        F.lit("orders").alias("source"), F.col(row_no).alias("row_no"),
        F.lit(reason).alias("reason"), F.lit(ABORT).alias("severity"),
    )


def _checked(forms, products, statuses, points, row_no, *keep):
    """Valid forms as order headers with the count of their ``lines``, their entries, and the rejects.

    Entries are resolved once and stored: row number, pos, product_id, quantity.
    """
    code = typed_code(F.col("receiver_code"))
    digits = F.coalesce(strip(F.col("receiver_code")).rlike("^[+-]?[0-9]+$"), F.lit(False))
    rows = numbered_wrongly(forms, row_no).select(
        row_no,
        "_number",
        *keep,
        "order_date",
        F.col("delivery_date").alias("order_pup_date"),
        F.col("pickup_point_id").cast("long").alias("pp_id"),
        blank_to_null(F.col("user_name")).alias("user_name"),
        code.alias("order_pp_code"),
        blank_to_null(F.col("status_name")).alias("status_name"),
        order_entries(F.col("product_article")).alias("lines"),
        (digits & code.isNull()).alias("_code"),
    )
    local = split(rows, "orders", first_problem(
        (F.size("lines") == 0, "no_items", ABORT),
        (F.exists("lines", lambda e: bad_quantity(entry_quantity(e))), "bad_quantity", ABORT),
        (F.col("_code"), "bad_pickup_code", ABORT),
        (too_long("user_name"), "too_long", ABORT),
    ), row_no, stage=cut)
    rows = local.rows.drop("_code")

    entries = cut(
        rows.select(row_no, F.posexplode("lines").alias("pos", "line"))
        .select(
            row_no, "pos", entry_article(F.col("line")).alias("art"),
            entry_quantity(F.col("line")).alias("product_quantity"),
        )
        .join(article_keys(products), "art", "left")
        .select(row_no, "pos", "product_id", "product_quantity")
    )
    unknown_article = entries.where(F.col("product_id").isNull()).select(row_no).distinct()
    resolved = rows.withColumn("lines", F.size("lines")).join(unknown_article, row_no, "left_anti")
    unknown_point = resolved.where(F.col("pp_id").isNotNull()).join(
        points.select("pp_id"), "pp_id", "left_anti"
    ).select(row_no)
    accepted = cut(resolved.join(unknown_point, row_no, "left_anti").join(
        exact_keys(statuses, "status_id", "status_name"), "status_name", "left"
    ))
    rejects = local.rejects.unionByName(
        _refused(unknown_article, row_no, "unknown_article")
    ).unionByName(_refused(unknown_point, row_no, "unknown_pickup_point"))
    return accepted.select(row_no, *keep, *HEADER, "lines"), entries, rejects


def _numbered(rows, row_no, items, key=None):
    """Give every order the number its items end with, in form order.

    All items of an accepted order are stored, so the count of its lines tells
    the numbers of its items; they need no sort of their own.
    """
    counted = {"last_item": (last_key(items, "order_item_id"), F.col("lines"))}
    name, base = key or ("_number", F.lit(0))
    return number_rows(rows, row_no, name, base, **counted)


def _items(headers, entries, row_no):
    """Item rows of numbered orders."""
    first = headers.select(
        F.col(row_no).alias("_no"), "order_id", (F.col("last_item") - F.col("lines") + 1).alias("first"))
    return entries.join(lookup_side(first, "_no"), F.col(row_no) == F.col("_no")).select(
        (F.col("first") + F.col("pos")).alias("order_item_id"), "order_id", "product_id", "product_quantity")


def place_orders(forms, orders, items, products, statuses, points):
    """New order headers and items with the next ids, and the refused forms."""
    accepted, entries, rejects = _checked(forms, products, statuses, points, "row_no")
    headers = _numbered(accepted, "row_no", items, ("order_id", last_key(orders, "order_id")))
    return Placed(headers.select("row_no", "order_id", *HEADER), _items(headers, entries, "row_no"), rejects)


def replace_orders(changes, orders, items, products, statuses, points):
    """Orders and items after the changes: header fields and all items are replaced.

    Of several valid changes of an order the one with the highest
    ``change_no`` wins. New items get new ids; a change of an unknown order is
    refused.
    """
    known = orders.select("order_id")
    unknown = changes.select("change_no", "order_id").join(known, "order_id", "left_anti")
    of_known = changes.join(known, "order_id", "left_semi")
    accepted, entries, rejects = _checked(of_known, products, statuses, points, "change_no", "order_id")
    # Change numbers are unique here, so the largest of an order is one change.
    winners = accepted.groupBy("order_id").agg(F.max("change_no").alias("change_no")).select("change_no")
    last = _numbered(accepted.join(winners, "change_no", "left_semi"), "change_no", items)
    new = last.select("order_id", F.struct(*HEADER).alias("new"))
    table = orders.join(new, "order_id", "left").select(
        "order_id",
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in HEADER],
    )
    fresh = _items(last, entries, "change_no")
    changed = lookup_side(last.select("order_id"), "order_id")
    kept = items.join(changed, "order_id", "left_anti").select(*fresh.columns)
    return Replaced(
        table,
        kept.unionByName(fresh),
        rejects.unionByName(_refused(unknown, "change_no", "unknown_order")),
    )


def delete_orders(keys, orders, items):
    """Which of the orders can go; one that still has items is blocked."""
    wanted = orders.select("order_id").join(
        keys.select("order_id").distinct(), "order_id", "left_semi"
    )
    used = items.select("order_id").distinct()
    return Deletion(
        wanted.join(used, "order_id", "left_anti"), wanted.join(used, "order_id", "left_semi")
    )
