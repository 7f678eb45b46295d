"""Landing rows -> typed rows, with every refused row and its reason.

Severity tells what the row does to a strict import: a ``skip`` row is left
out, an ``abort`` row (unreadable number, broken constraint) stops the import.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavka import fixed
from lavka.functions.numbers import money, parse_date, unreadable, whole
from lavka.functions.roles import role_code
from lavka.functions.text import blank_to_null, default_if_blank, first_non_blank, secret_hash
from lavka.operators.gate import numbered_wrongly
from lavka.operators.resolve import resolve_pickups

SKIP, ABORT = "skip", "abort"


class Cleaned(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def first_problem(*checks):
    """First failing check of (condition, reason, severity) as a struct, or NULL.

    A wrong row number (see ``numbered_wrongly``) comes before all of them.
    """
    number = F.col("_number")
    found = F.when(number.isNotNull(), F.struct(number.alias("reason"), F.lit(ABORT).alias("severity")))
    for condition, reason, severity in checks:
        outcome = F.struct(F.lit(reason).alias("reason"), F.lit(severity).alias("severity"))
        found = found.when(condition, outcome)
    return found


def as_is(rows):
    return rows


def split(rows, source, problem, row_no="row_no", stage=as_is):
    """Separate the rows without a problem from the rejects.

    ``stage`` may write the checked rows somewhere, so that the readers of the
    two halves do not clean the input once more.
    """
    checked = stage(rows.withColumn("_problem", problem))
    return Cleaned(
        checked.where(F.col("_problem").isNull()).drop("_problem", "_number"),
        checked.where(F.col("_problem").isNotNull()).select(
            F.lit(source).alias("source"),
            F.col(row_no).alias("row_no"),
            "_problem.reason",
            "_problem.severity",
        ),
    )


def too_long(*columns):
    """Any of the texts overflows its column."""
    over = F.lit(False)
    for c in columns:
        over = over | (F.coalesce(F.char_length(c), F.lit(0)) > fixed.MAX_TEXT)
    return over


def clean_users(raw, salt, stage=as_is, gate=numbered_wrongly):
    """User sheet: trimmed login, stored role code, hashed secret."""
    login, secret = blank_to_null(F.col("login")), F.coalesce("password", F.lit(""))
    rows = gate(raw).select(
        "row_no",
        "_number",
        role_code(F.col("role")).alias("user_role"),
        blank_to_null(F.col("full_name")).alias("user_name"),
        login.alias("user_login"),
        secret_hash(login, secret, salt).alias("user_secret"),
    )
    return split(rows, "users", first_problem(
        (F.col("user_login").isNull(), "blank_login", SKIP),
        (too_long("user_role", "user_name", "user_login"), "too_long", ABORT),
    ), stage=stage)


def clean_products(raw, stage=as_is):
    """Product sheet: numbers cut or rounded as stored, defaults for blank cells."""
    price, discount, stock = money(F.col("price")), whole(F.col("discount")), whole(F.col("stock"))
    texts = {
        "product_art": blank_to_null(F.col("article")),
        "product_name": blank_to_null(F.col("product_name")),
        "product_unit": default_if_blank(F.col("unit"), fixed.DEFAULT_UNIT),
        "supp_name": blank_to_null(F.col("supplier")),
        "product_manufac": blank_to_null(F.col("manufacturer")),
        "categ_name": blank_to_null(F.col("category")),
        "product_desc": F.when(blank_to_null(F.col("description")).isNotNull(), F.col("description")),
        "product_photo": default_if_blank(F.col("photo"), fixed.DEFAULT_PHOTO),
    }
    zero = F.lit(0)
    rows = numbered_wrongly(raw).select(
        "row_no",
        "_number",
        *[c.alias(name) for name, c in texts.items()],
        F.coalesce(price, zero.cast("decimal(10,2)")).alias("product_price"),
        F.coalesce(discount, zero).alias("product_discount"),
        F.coalesce(stock, zero).alias("product_stock"),
        unreadable(F.col("price"), price).alias("_price"),
        unreadable(F.col("discount"), discount).alias("_discount"),
        unreadable(F.col("stock"), stock).alias("_stock"),
    )
    cleaned = split(rows, "products", first_problem(
        (F.col("product_name").isNull(), "blank_name", SKIP),
        (F.col("_price"), "bad_price", ABORT),
        (F.col("_discount"), "bad_discount", ABORT),
        (F.col("_stock"), "bad_stock", ABORT),
        (F.col("product_art").isNull(), "blank_article", SKIP),
        *product_checks(),
        (too_long(*texts), "too_long", ABORT),
    ), stage=stage)
    return Cleaned(cleaned.rows.drop("_price", "_discount", "_stock"), cleaned.rejects)


def product_checks():
    """Table constraints of a product; a missing value passes."""
    discount = F.col("product_discount")
    return (
        (F.col("product_price") < 0, "check_price", ABORT),
        ((discount < 0) | (discount > fixed.MAX_DISCOUNT), "check_discount", ABORT),
    )


def clean_orders(raw, stage=as_is, addresses=None):
    """Order sheet headers; item cells are carried along for ``import_items``.

    With ``addresses`` the pickup cell is resolved too, and its address checked.
    """
    code = whole(F.col("code"))
    client = default_if_blank(F.col("client"), fixed.NO_VALUE)
    rows = numbered_wrongly(raw).select(
        "row_no",
        "_number",
        parse_date(F.col("order_date")).alias("order_date"),
        parse_date(F.col("delivery_date")).alias("order_pup_date"),
        client.alias("user_name"),
        "pickup",
        code.alias("order_pp_code"),
        blank_to_null(F.col("status")).alias("status_name"),
        first_non_blank(*[F.col(c) for c in fixed.ORDER_TEXT_COLUMNS]).alias("order_text"),
        "product_no",
        "quantity",
        unreadable(F.col("code"), code).alias("_code"),
    )
    texts = ["user_name", "status_name"]
    if addresses is not None:
        rows = resolve_pickups(rows, addresses)
        texts.append("pickup_address")
    cleaned = split(rows, "orders", first_problem(
        (F.col("order_date").isNull(), "bad_order_date", SKIP),
        (F.col("_code"), "bad_pickup_code", ABORT),
        (too_long(*texts), "too_long", ABORT),
    ), stage=stage)
    return Cleaned(cleaned.rows.drop("_code"), cleaned.rejects)
