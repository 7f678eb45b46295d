import tempfile

import pytest

from lavka.session import local_session


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return local_session(4, partitions=4, memory="4g", **{"spark.checkpoint.dir": shared})


@pytest.fixture
def folder():
    """A new folder per test; nothing is cleared afterwards."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="session")
def shop(spark):
    """A small shop with the awkward rows: padding, NULL keys, missing names."""
    make = spark.createDataFrame
    return {
        "suppliers": make([(1, "Alfa"), (2, " Beta "), (3, None), (4, "Alfa")], "supp_id long, supp_name string"),
        "categories": make([(1, "Boots"), (2, "Обувь")], "categ_id long, categ_name string"),
        "statuses": make([(1, "Новый"), (2, "Завершён")], "status_id long, status_name string"),
        "pickup_points": make([(1, "Main st. 1"), (2, " Side st. 2 ")], "pp_id long, pp_name string"),
        "products": make([
            (1, "A1", "Red boots", "шт.", 100.0, 1, "Kari ", 1, 20, 0, "warm", "1.jpg"),
            (2, " B2 ", "Туфли", "шт.", 50.0, 2, " ", 2, 15, 0, None, None),
            (3, "C3", "100% wool", "пара", 10.005, None, None, None, 0, 7, "a_b", None),
            (4, "A1 ", "Copy", None, None, 4, "kari", 2, None, None, "back\\slash", " "),
            (5, None, "No article", "шт.", 1.0, 3, "Kari", 1, 3, 7, "", None),
        ], "product_id long, product_art string, product_name string, product_unit string, price double, "
           "supp_id long, product_manufac string, categ_id long, product_discount int, product_stock int, "
           "product_desc string, product_photo string",
        ).selectExpr(
            "product_id", "product_art", "product_name", "product_unit",
            "cast(price as decimal(10,2)) as product_price", "supp_id", "product_manufac", "categ_id",
            "product_discount", "product_stock", "product_desc", "product_photo",
        ),
        "orders": make([
            (1, "2025-01-01", None, 1, "Ann", 901, 1), (2, "2025-02-01", "2025-02-03", None, None, None, 2),
            (3, None, None, 2, "Bob", 5, None), (4, "2025-02-01", None, 1, "Cy", 1, 1),
        ], "order_id long, d string, p string, pp_id long, user_name string, order_pp_code int, status_id long"
        ).selectExpr("order_id", "cast(d as date) as order_date", "cast(p as date) as order_pup_date",
                     "pp_id", "user_name", "order_pp_code", "status_id"),
        "order_items": make([
            (10, 1, 2, 3), (11, 1, 1, 1), (12, 2, 5, 2), (13, 2, 3, 1), (14, None, 1, 1),
        ], "order_item_id long, order_id long, product_id long, product_quantity int"),
    }


@pytest.fixture
def order_shop(shop):
    return [shop[n] for n in ("orders", "order_items", "products", "statuses", "pickup_points")]


@pytest.fixture
def catalog_shop(shop):
    return [shop[n] for n in ("products", "categories", "suppliers")]
