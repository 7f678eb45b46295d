"""Presentation columns of a catalogue row: prices, labels, highlighting."""

from pyspark.sql import functions as F

from lavka import fixed
from lavka.functions.text import blank_to_null, default_if_blank

_CENTS = "decimal(12,2)"


def net_price(price, discount):
    """Price after the percentage discount, to the cent; no discount below zero."""
    off = F.greatest(F.coalesce(discount, F.lit(0)), F.lit(0))
    return F.round(F.coalesce(price, F.lit(0)) * (F.lit(100) - off) / 100, 2).cast(_CENTS)


def highlight(discount, stock):
    return (
        F.when(discount > fixed.BIG_DISCOUNT, F.lit("big_discount"))
        .when(F.coalesce(stock, F.lit(0)) == 0, F.lit("out_of_stock"))
        .otherwise(F.lit("plain"))
    )


def highlight_colour(discount, stock):
    pairs = [F.lit(x) for pair in fixed.HIGHLIGHT_COLOURS.items() for x in pair]
    return F.create_map(*pairs)[highlight(discount, stock)]


def header(category, name):
    """``category | name``, or the one that is present, or the no-value sign."""
    category, name = blank_to_null(category), blank_to_null(name)
    both = F.concat(category, F.lit(" | "), name)
    return F.coalesce(both, name, category, F.lit(fixed.NO_VALUE))


def or_no_value(c):
    """Empty -> no-value sign; text of spaces is kept as it is."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(fixed.NO_VALUE))


def discount_label(discount):
    shown = F.concat(discount.cast("string"), F.lit(" %"))
    return F.when(discount != 0, shown).otherwise(F.lit(fixed.NO_VALUE))


def price_label(price, discount):
    """One price, or the old and the new price when there is a discount."""
    old = F.coalesce(price, F.lit(0)).cast(_CENTS).cast("string")
    new = net_price(price, discount).cast("string")
    prices = F.when(discount > 0, F.concat(old, F.lit(" "), new)).otherwise(old)
    return F.concat(F.lit(fixed.PRICE_BEFORE), prices, F.lit(fixed.PRICE_AFTER))


def card_columns(catalog):
    """Catalogue rows -> one row per product card."""
    price, discount, stock = F.col("price"), F.col("discount"), F.col("stock_quantity")
    return catalog.select(
        "product_id",
        header(F.col("category_name"), F.col("product_name")).alias("header"),
        default_if_blank(F.col("description"), fixed.NO_VALUE).alias("description"),
        or_no_value(F.col("manufacturer_name")).alias("manufacturer"),
        or_no_value(F.col("supplier_name")).alias("supplier"),
        or_no_value(F.col("unit_name")).alias("unit"),
        F.coalesce(stock, F.lit(0)).alias("stock"),
        discount_label(discount).alias("discount_label"),
        F.coalesce(price, F.lit(0)).cast(_CENTS).alias("price"),
        net_price(price, discount).alias("net_price"),
        F.coalesce(discount > 0, F.lit(False)).alias("has_discount"),
        price_label(price, discount).alias("price_label"),
        default_if_blank(F.col("photo"), fixed.DEFAULT_PHOTO).alias("photo"),
        highlight(discount, stock).alias("highlight"),
        highlight_colour(discount, stock).alias("colour"),
    )
