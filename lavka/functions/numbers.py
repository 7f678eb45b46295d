"""Lenient readings of numbers and dates; unreadable text gives NULL."""

from pyspark.sql import functions as F

from lavka.functions.text import blank_to_null, strip

# A plain decimal number; keeps out suffixes and words that casts also accept.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_number(c):
    return F.coalesce(strip(c).rlike(NUMBER), F.lit(False))


def whole(c):
    """Number cut to an INT (12.9 -> 12); blank, unreadable or too big -> NULL."""
    return F.when(is_number(c), strip(c).try_cast("double").try_cast("int"))


def money(c):
    """Number as DECIMAL(10,2), half up; blank, unreadable or too big -> NULL."""
    return F.when(is_number(c), strip(c).try_cast("decimal(10,2)"))


def unreadable(c, value):
    """The cell holds text, but no value came out of it."""
    return blank_to_null(c).isNotNull() & value.isNull()


def typed_code(c):
    """Pickup code from a form: digits with an optional sign, else NULL."""
    text = strip(c)
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def parse_date(c):
    """Day.month.year, then ISO (a time part is ignored); else NULL."""
    text = strip(c)
    iso = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$"), F.left(text, F.lit(10)))
    return F.coalesce(F.try_to_date(text, "d.M.yyyy"), iso.try_cast("date"))


def iso_date(c):
    return F.date_format(c, "yyyy-MM-dd")
