"""Schemas of the eight retail tables and of the landing frames."""

from pyspark.sql import types as T

from lavka import fixed

_LONG, _INT, _TEXT, _DATE = T.LongType(), T.IntegerType(), T.StringType(), T.DateType()
MONEY = T.DecimalType(10, 2)


def _struct(**columns):
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SUPPLIERS = _struct(supp_id=_LONG, supp_name=_TEXT)
PICKUP_POINTS = _struct(pp_id=_LONG, pp_name=_TEXT)
CATEGORIES = _struct(categ_id=_LONG, categ_name=_TEXT)
STATUSES = _struct(status_id=_LONG, status_name=_TEXT)
# The secret is stored as a salted hash (see functions.text.secret_hash).
USERS = _struct(user_id=_LONG, user_role=_TEXT, user_name=_TEXT, user_login=_TEXT, user_secret=_TEXT)
PRODUCTS = _struct(
    product_id=_LONG, product_art=_TEXT, product_name=_TEXT, product_unit=_TEXT,
    product_price=MONEY, supp_id=_LONG, product_manufac=_TEXT, categ_id=_LONG,
    product_discount=_INT, product_stock=_INT, product_desc=_TEXT, product_photo=_TEXT,
)
ORDERS = _struct(
    order_id=_LONG, order_date=_DATE, order_pup_date=_DATE, pp_id=_LONG,
    user_name=_TEXT, order_pp_code=_INT, status_id=_LONG,
)
ORDER_ITEMS = _struct(order_item_id=_LONG, order_id=_LONG, product_id=_LONG, product_quantity=_INT)

TABLES = {
    "suppliers": SUPPLIERS,
    "pickup_points": PICKUP_POINTS,
    "categories": CATEGORIES,
    "statuses": STATUSES,
    "users": USERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

PRIMARY_KEYS = {
    "suppliers": "supp_id",
    "pickup_points": "pp_id",
    "categories": "categ_id",
    "statuses": "status_id",
    "users": "user_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}

# (table, column, referenced table); the column has the referenced key's name.
FOREIGN_KEYS = (
    ("products", "supp_id", "suppliers"),
    ("products", "categ_id", "categories"),
    ("orders", "pp_id", "pickup_points"),
    ("orders", "status_id", "statuses"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)


def landing(headers):
    """Landing frame: the row number within the file, then text cells."""
    return T.StructType(
        [T.StructField("row_no", _LONG)] + [T.StructField(c, _TEXT) for c in headers.values()]
    )


RAW_USERS = landing(fixed.USER_HEADERS)
RAW_PRODUCTS = landing(fixed.PRODUCT_HEADERS)
RAW_ORDERS = landing(fixed.ORDER_HEADERS)
RAW_POINTS = _struct(row_no=_LONG, address=_TEXT)

REJECTS = _struct(source=_TEXT, row_no=_LONG, reason=_TEXT, severity=_TEXT)
# Of streams: the file the row number counts in, where a stream is read by file.
STREAM_REJECTS = T.StructType([*REJECTS.fields, T.StructField("file", _TEXT)])
