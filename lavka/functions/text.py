"""Text cleaning, order-line parsing and formatting, as column expressions."""

import re

from pyspark.sql import functions as F

from lavka import fixed

# All whitespace characters; SQL trim() removes only the space.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# One order item in a comma-joined token list: an article, then its quantity if
# the whole next token is digits (inner spaces are tolerated here and rejected
# by the cast). Matches do not overlap and run left to right, which is exactly
# the pairing rule of the order line.
_ITEM = r"[^,]+(?:,[0-9][0-9 ]*(?=,|\z))?"


def strip(c):
    """Remove whitespace of any kind from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c):
    return F.nullif(strip(c), F.lit(""))


def default_if_blank(c, default):
    return F.coalesce(blank_to_null(c), F.lit(default))


def first_non_blank(*columns):
    """First cell that holds text; the text ``nan`` is an empty cell."""
    cells = [blank_to_null(c) for c in columns]
    return F.coalesce(*[F.when(~c.rlike("(?i)^nan$"), c) for c in cells])


def secret_hash(login, secret, salt):
    """Salted hash that stands in for the secret in stored and reported rows."""
    return F.sha2(F.concat_ws(":", F.lit(salt), strip(login), strip(secret)), 256)


def order_entries(text):
    """Order line -> its items as texts, each ``article`` or ``article,digits``.

    Newlines, semicolons and commas separate tokens; blank tokens vanish. A
    token of digits after an article is its quantity. Linear in the length of
    the text.
    """
    tokens = F.filter(
        F.transform(F.split(F.translate(text, "\n;", ",,"), ","), strip), lambda t: t != ""
    )
    entries = F.regexp_extract_all(F.array_join(tokens, ","), F.lit(_ITEM), F.lit(0))
    return F.coalesce(entries, F.expr("cast(array() as array<string>)"))


def entry_article(entry):
    return F.substring_index(entry, ",", 1)


def entry_quantity(entry):
    """1 when left out; NULL when the digits are no INT, so callers can reject it."""
    left_out = F.instr(entry, ",") == 0
    return F.when(left_out, F.lit(1)).otherwise(F.substring_index(entry, ",", -1).try_cast("int"))


def parse_order_text(text):
    """Order line -> ARRAY<STRUCT<art STRING, qty INT>>."""
    return F.transform(
        order_entries(text),
        lambda e: F.struct(entry_article(e).alias("art"), entry_quantity(e).alias("qty")),
    )


def explode_order_text(rows, text, *keep):
    """One row per item: the kept columns, pos, art, qty.

    Entries are taken apart after the explode, in generated code.
    """
    entries = rows.select(*keep, F.posexplode(order_entries(F.col(text))).alias("pos", "entry"))
    return entries.select(
        *keep, "pos", entry_article(F.col("entry")).alias("art"), entry_quantity(F.col("entry")).alias("qty")
    )


def bad_quantity(qty):
    """Quantity that cannot be stored: unreadable, or not above zero."""
    return qty.isNull() | (qty < 1)


def item_text(article, quantity):
    """Editable form of one item: article, and the quantity unless it is 1."""
    name = blank_to_null(article)
    number = F.coalesce(F.nullif(quantity, F.lit(0)), F.lit(1))
    return F.when(number != 1, F.concat(name, F.lit(", "), number.cast("string"))).otherwise(name)


def format_order_items(items):
    """ARRAY<STRUCT<article, quantity>> -> the editable order line."""
    parts = F.transform(items, lambda i: item_text(i["article"], i["quantity"]))
    return F.coalesce(F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "), F.lit(""))


def listed_item(article, quantity):
    """Read-only form of one item: article, with a multiplier above 1."""
    times = F.when(quantity > 1, F.concat(F.lit(" ×"), quantity.cast("string")))
    return F.concat(article, F.coalesce(times, F.lit("")))


def search_pattern(text, literal=False):
    """LIKE pattern for a substring search.

    ``%`` and ``_`` in the text are live wildcards and a backslash takes the
    next character literally; with ``literal`` all three stand for themselves.
    """
    if literal:
        return "%" + re.sub(r"([%_\\])", r"\\\1", text.strip()) + "%"
    return re.sub(
        r"\\(.)",
        lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1),
        "%" + text.strip() + "%",
        flags=re.DOTALL,
    )


def display_name(*columns):
    """First non-empty name, stripped, or the no-value sign."""
    picked = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
    return F.coalesce(blank_to_null(picked), F.lit(fixed.NO_VALUE))
