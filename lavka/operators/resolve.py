"""Order lines -> product keys, and pickup cells -> addresses."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka.functions.numbers import is_number, whole
from lavka.functions.text import bad_quantity, blank_to_null, explode_order_text, strip
from lavka.operators.dims import trimmed_keys
from lavka.operators.gate import numbered_wrongly
from lavka.operators.numbering import number_rows
from lavka.session import cut


BAD_QUANTITY, UNKNOWN_ARTICLE = "bad_quantity", "unknown_article"


def article_keys(products):
    """Trimmed article -> product_id; of several products the smallest id."""
    return trimmed_keys(products, "product_id", "product_art", "art")


def resolve_items(requests, products, *keep, row_no="row_no", text="order_text"):
    """One row per parsed item: row_no, pos, art, qty, product_id, problem.

    ``problem`` is NULL, ``bad_quantity`` or ``unknown_article``; the caller
    decides whether it spoils the item or the whole order. An unreadable
    quantity is found first, then an unknown article, then a quantity below 1.
    Articles compare by exact characters, blanks around them aside. ``keep`` names
    columns to carry along.
    """
    return (
        explode_order_text(requests, text, row_no, *keep)
        .join(article_keys(products), "art", "left")
        .withColumn(
            "problem",
            F.when(F.col("qty").isNull(), BAD_QUANTITY)
            .when(F.col("product_id").isNull(), UNKNOWN_ARTICLE)
            .when(bad_quantity(F.col("qty")), BAD_QUANTITY),
        )
    )


def lenient_items(resolved):
    """Items that can be stored; the others are reported by ``item_rejects``."""
    return resolved.where(F.col("problem").isNull()).drop("problem")


def item_rejects(resolved):
    return resolved.where(F.col("problem").isNotNull())


def strict_orders(resolved, row_no="row_no"):
    """Per order: accepted when every item resolves, else the reason, a bad quantity first.

    Reasons are compared as numbers, which a hash aggregate can do.
    """
    rank = F.when(F.col("problem") == BAD_QUANTITY, 1).when(F.col("problem") == UNKNOWN_ARTICLE, 2)
    worst = F.when(F.col("_rank") == 1, BAD_QUANTITY).when(F.col("_rank") == 2, UNKNOWN_ARTICLE)
    return resolved.groupBy(row_no).agg(F.count("*").alias("items"), F.min(rank).alias("_rank")).select(
        row_no, "items", worst.alias("problem"))


class AddressList(NamedTuple):
    addresses: DataFrame
    rejects: DataFrame


def address_list(lines):
    """Address list without blank lines, numbered from 1 by what is kept, and the refused lines.

    A blank line therefore shifts the numbers of the lines after it. A line without a row
    number, or with another's, has no place in the list: it is refused, and a strict import stops.
    """
    rows = cut(numbered_wrongly(lines.select("row_no", blank_to_null(F.col("address")).alias("address"))))
    kept = rows.where(F.col("_number").isNull() & (F.lower("address") != "nan")).select("row_no", "address")
    rejects = rows.where("_number is not null").select(
        F.lit("pickup_points").alias("source"), "row_no", F.col("_number").alias("reason"), F.lit("abort").alias("severity"))
    numbered = number_rows(kept, "row_no", "ordinal", F.lit(0).cast("long")).select("ordinal", "address")
    return AddressList(cut(numbered), rejects)


def kept_addresses(lines):
    """The addresses of ``address_list``."""
    return address_list(lines).addresses


def resolve_pickups(rows, addresses, cell="pickup"):
    """Add ``pickup_address`` for a cell with a list number or an address.

    A number within the list gives that address, any other number nothing;
    text is the address itself. Without a list every text is an address.
    """
    value = strip(F.col(cell))
    listed = addresses.agg(F.count("*")).scalar()
    ordinal = F.when(is_number(value), whole(value)).cast("long")
    return (
        rows.withColumn("ordinal", ordinal)
        .join(addresses, "ordinal", "left")
        .withColumn(
            "pickup_address",
            F.when((listed > 0) & is_number(value), F.col("address")).otherwise(
                blank_to_null(F.col(cell))
            ),
        )
        .drop("ordinal", "address")
    )
