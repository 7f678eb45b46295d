import datetime
import glob
import os
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lavka import fixed, schemas
from lavka.operators import cleaning, dims, imports, resolve, users
from lavka.plans.importing import ImportRefused, run_import
from lavka.sources import files, tables


def raw(spark, schema, *rows):
    """Landing rows given by column name."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def reasons(rejects):
    return sorted((r.row_no, r.reason, r.severity) for r in rejects.collect())


PRODUCTS = [
    {"row_no": 1, "product_name": " Boots ", "article": " A9 ", "price": "10.005", "discount": "15.9",
     "stock": "7.9", "supplier": "Nova", "category": "Boots", "unit": " ", "photo": " x.jpg "},
    {"row_no": 2, "product_name": " ", "article": "A", "price": "free"},
    {"row_no": 3, "product_name": "x", "article": "A", "price": "free"},
    {"row_no": 4, "product_name": "x", "article": " "},
    {"row_no": 5, "product_name": "x", "article": "A", "price": "-1"},
    {"row_no": 6, "product_name": "x", "article": "A", "discount": "101"},
    {"row_no": 7, "product_name": "x", "article": "A", "stock": "many"},
    {"row_no": 8, "product_name": "x" * 256, "article": "A"},
    {"row_no": 9, "product_name": "plain", "article": "A1"},
    {"row_no": 10, "product_name": "x", "article": "A", "discount": "half"},
]


def test_clean_products(spark):
    cleaned = cleaning.clean_products(raw(spark, schemas.RAW_PRODUCTS, *PRODUCTS))
    assert reasons(cleaned.rejects) == [
        (2, "blank_name", "skip"), (3, "bad_price", "abort"), (4, "blank_article", "skip"),
        (5, "check_price", "abort"), (6, "check_discount", "abort"), (7, "bad_stock", "abort"),
        (8, "too_long", "abort"), (10, "bad_discount", "abort")]
    rows = {r.row_no: r for r in cleaned.rows.collect()}
    assert sorted(rows) == [1, 9]
    first = rows[1]
    assert (first.product_art, first.product_name, first.product_unit) == ("A9", "Boots", "шт.")
    assert (first.product_price, first.product_discount, first.product_stock) == (Decimal("10.01"), 15, 7)
    assert (first.product_photo, rows[9].product_photo) == ("x.jpg", "picture.png")
    assert (rows[9].product_price, rows[9].product_discount, rows[9].product_stock) == (Decimal("0.00"), 0, 0)


def test_import_products_appends_and_creates(spark, shop):
    done = imports.import_products(
        raw(spark, schemas.RAW_PRODUCTS, *PRODUCTS), shop["products"], shop["suppliers"], shop["categories"])
    assert [tuple(r) for r in done.suppliers.collect()] == [(5, "Nova")]
    assert done.categories.count() == 0
    rows = {r.row_no: r for r in done.products.collect()}
    assert (rows[1].product_id, rows[1].supp_id, rows[1].categ_id) == (6, 5, 1)
    assert (rows[9].product_id, rows[9].supp_id) == (7, None)


def test_users_first_row_wins(spark):
    table = spark.createDataFrame([(4, "client", "T", " taken ", "h")], schemas.USERS)
    rows = raw(
        spark, schemas.RAW_USERS,
        {"row_no": 5, "login": "ann", "role": "Courier"},
        {"row_no": 2, "login": " ann ", "role": " Менеджер ", "full_name": " Ann ", "password": " s "},
        {"row_no": 3, "login": "taken"}, {"row_no": 1, "login": " "}, {"row_no": 4, "login": "bob"},
        {"row_no": 6, "login": "Ann"},
    )
    done = imports.import_users(rows, table, "salt")
    found = sorted((r.row_no, r.user_id, r.user_login, r.user_role, r.user_name) for r in done.users.collect())
    assert found == [
        (2, 5, "ann", "manager", "Ann"), (4, 6, "bob", "client", None), (6, 7, "Ann", "client", None)]
    assert reasons(done.rejects) == [(1, "blank_login", "skip")]
    stored = table.unionByName(done.users.select(*schemas.USERS.fieldNames()))
    assert imports.import_users(rows, stored, "salt").users.count() == 0
    attempts = spark.createDataFrame(
        [(1, " ann", "s "), (2, "ann", "S"), (3, "nobody", "s")], "attempt_id int, login string, secret string")
    matched = users.signin_matches(attempts, stored, "salt").orderBy("attempt_id").collect()
    assert [(r.user_id, r.role_name, r.matched) for r in matched] == [
        (5, "manager", True), (None, None, False), (None, None, False)]
    assert "user_secret" not in matched[0].asDict()


def test_hot_login(spark):
    rows = spark.range(1, 3001).selectExpr(
        "id as row_no", "case when id % 3 = 0 then 'hot' else concat('u', id) end as user_login",
        "'client' as user_role", "cast(id as string) as user_name", "'h' as user_secret")
    new = users.new_users(rows, spark.createDataFrame([], schemas.USERS))
    assert new.count() == 2001
    assert new.where("user_login = 'hot'").first().user_name == "3"


def addresses(spark):
    lines = [(1, " Main st. 1 "), (2, " "), (3, "nan"), (4, "Far st."), (5, None)]
    return resolve.kept_addresses(spark.createDataFrame(lines, schemas.RAW_POINTS))


@pytest.mark.parametrize("listed, expected", [
    (True, ["Main st. 1", "Far st.", None, None, "By hand", None, "Far st."]),
    (False, ["1", "2.0", "3", "0", "By hand", None, "2.9"]),
])
def test_pickup_cells(spark, listed, expected):
    cells = ["1", "2.0", "3", "0", " By hand ", " ", "2.9"]
    rows = spark.createDataFrame(list(enumerate(cells)), "row_no long, pickup string")
    known = addresses(spark)
    known = known if listed else known.where("false")
    out = resolve.resolve_pickups(rows, known).orderBy("row_no").collect()
    assert [r.pickup_address for r in out] == expected


ORDERS = [
    {"row_no": 1, "order_date": "27.02.2025", "delivery_date": "x", "pickup": "1", "code": "901.0",
     "status": " Новый ", "order_line": " ", "order_article": "A1, 2\nZ9; C3,5"},
    {"row_no": 2, "order_date": "30.02.2025"},
    {"row_no": 3, "order_date": "2025-03-01", "client": " Ann ", "pickup": "Far st.", "code": "call"},
    {"row_no": 4, "order_date": "2025-03-01", "client": " Ann ", "pickup": "Other", "status": "Ждёт",
     "product_no": "3.0", "quantity": "0"},
    {"row_no": 5, "order_date": "01.03.2025", "product_no": "99"},
    {"row_no": 6, "order_date": "01.03.2025", "order_line": "A1,0, C3, 1 000", "product_no": "1"},
    {"row_no": 7, "order_date": "01.03.2025", "product_no": "1", "quantity": "two"},
    {"row_no": 8, "order_date": "01.03.2025", "product_no": "none", "quantity": "two"},
]


def import_orders(spark, shop):
    return imports.import_orders(
        raw(spark, schemas.RAW_ORDERS, *ORDERS), addresses(spark), shop["orders"], shop["order_items"],
        shop["products"], shop["pickup_points"], shop["statuses"])


def test_import_orders(spark, shop):
    done = import_orders(spark, shop)
    heads = {r.row_no: r for r in done.orders.collect()}
    day = datetime.date
    assert sorted((n, r.order_id) for n, r in heads.items()) == [(1, 5), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10)]
    one = heads[1]
    assert (one.order_date, one.order_pup_date, one.pp_id) == (day(2025, 2, 27), None, 1)
    assert (one.user_name, one.order_pp_code, one.status_id) == ("—", 901, 1)
    assert [tuple(r) for r in done.pickup_points.collect()] == [(3, "Other")]
    assert [tuple(r) for r in done.statuses.collect()] == [(3, "Ждёт")]
    items = sorted((r.order_item_id, r.order_id, r.product_id, r.product_quantity) for r in done.order_items.collect())
    assert items == [(15, 5, 1, 2), (16, 5, 3, 5), (17, 6, 3, 1)]
    assert reasons(done.rejects) == [
        (1, "unknown_article", "skip"), (2, "bad_order_date", "skip"), (3, "bad_pickup_code", "abort"),
        (5, "unknown_product", "abort"), (6, "bad_quantity", "abort"), (6, "bad_quantity", "abort"),
        (7, "bad_quantity", "abort")]


def test_summary_counts_every_row(spark, shop):
    done = import_orders(spark, shop)
    empty = imports.orders_without_items(done.orders, done.order_items)
    counts = {(r.stage, r.outcome, r.reason): r["rows"] for r in imports.summary(
        done.rejects, empty, orders=done.orders, order_items=done.order_items).collect()}
    assert counts[("orders", "imported", "")] == 6
    assert counts[("orders", "without_items", "")] == 4
    assert counts[("order_items", "abort", "bad_quantity")] == 3


def land(spark, folder, products, orders):
    paths = {n: f"{folder}/landing/{n}" for n in ("users", "products", "orders", "points")}
    files.write_landing(raw(spark, schemas.RAW_PRODUCTS, *products), paths["products"], fixed.PRODUCT_HEADERS)
    files.write_landing(raw(spark, schemas.RAW_ORDERS, *orders), paths["orders"], fixed.ORDER_HEADERS)
    files.write_landing(spark.createDataFrame([(1, "Main st. 1")], schemas.RAW_POINTS), paths["points"])
    return paths  # no users file: that stage imports nothing


def test_strict_import_publishes_all_or_nothing(spark, folder):
    root = f"{folder}/shop"
    bad = land(spark, f"{folder}/bad", PRODUCTS, ORDERS)
    with pytest.raises(ImportRefused):
        run_import(spark, bad, root, "run1", "salt")
    assert tables.read_table(spark, root, "products").count() == 0

    good = land(spark, f"{folder}/good", [PRODUCTS[0], PRODUCTS[3], PRODUCTS[8]], ORDERS[:2])
    report = run_import(spark, good, root, "run2", "salt")
    counts = {(r.stage, r.outcome, r.reason): r["rows"] for r in report.summary.collect()}
    assert counts[("products", "imported", "")] == 2 and counts[("users", "imported", "")] == 0
    assert counts[("products", "skip", "blank_article")] == 1
    # The pasted line break survived the file; unknown articles were left out.
    items = tables.read_table(spark, root, "order_items").collect()
    assert [(r.order_item_id, r.product_id, r.product_quantity) for r in items] == [(1, 2, 2)]

    # The same run again is refused, another one builds on it.
    with pytest.raises(tables.RunPublished):
        run_import(spark, good, root, "run2", "salt")
    assert tables.read_table(spark, root, "products").count() == 2
    run_import(spark, good, root, "run3", "salt")
    ids = [r.product_id for r in tables.read_table(spark, root, "products").collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    assert sorted(r.order_id for r in tables.read_table(spark, root, "orders").collect()) == [1, 2]
    assert tables.read_table(spark, root, "suppliers").count() == 1


def stored(spark, root):
    return {n: sorted(map(str, tables.read_table(spark, root, n).collect())) for n in schemas.TABLES}


def test_published_rows_stay_whatever_is_tried(spark, folder, monkeypatch):
    """A published run repeated with a bad file, a refused run, and one that fails half way."""
    root = f"{folder}/shop"
    good = land(spark, f"{folder}/good", [PRODUCTS[0], PRODUCTS[8]], ORDERS[:2])
    bad = land(spark, f"{folder}/bad", PRODUCTS, ORDERS)
    run_import(spark, good, root, "r1", "salt")
    before = stored(spark, root)
    for strict in (True, False):
        with pytest.raises(tables.RunPublished):
            run_import(spark, bad, root, "r1", "salt", strict=strict)
        assert stored(spark, root) == before
    with pytest.raises(ImportRefused):
        run_import(spark, bad, root, "r2", "salt")
    assert stored(spark, root) == before

    def fails(*args, **options):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr("lavka.plans.importing.import_orders", fails)
        with pytest.raises(OSError):
            run_import(spark, good, root, "r3", "salt")
    assert stored(spark, root) == before
    # The run that failed can be repeated under its name.
    run_import(spark, good, root, "r3", "salt")
    assert len(stored(spark, root)["products"]) == 4


NUMBERS = [None, 1, 2, 2, 3, None, 4, 4, 4, 5]


def test_every_row_is_accepted_or_refused(spark, shop):
    """Missing and repeated row numbers: refused, all of them, and nothing else is."""
    wrong = [(n, "no_row_no" if n is None else "repeated_row_no") for n in NUMBERS if n is None or NUMBERS.count(n) > 1]
    products = raw(spark, schemas.RAW_PRODUCTS, *[
        {"row_no": n, "product_name": "x", "article": f"N{i}"} for i, n in enumerate(NUMBERS)])
    done = imports.import_products(products, shop["products"], shop["suppliers"], shop["categories"])
    assert sorted(map(str, ((r.row_no, r.reason) for r in done.rejects.collect()))) == sorted(map(str, wrong))
    assert [(r.row_no, r.product_id) for r in done.products.orderBy("row_no").collect()] == [(1, 6), (3, 7), (5, 8)]
    orders = raw(spark, schemas.RAW_ORDERS, *[
        {"row_no": n, "order_date": "2025-03-01", "order_line": "A1"} for n in NUMBERS])
    done = imports.import_orders(
        orders, addresses(spark), shop["orders"], shop["order_items"], shop["products"], shop["pickup_points"], shop["statuses"])
    assert sorted(map(str, ((r.row_no, r.reason) for r in done.rejects.collect()))) == sorted(map(str, wrong))
    assert done.orders.count() == done.order_items.count() == 3
    people = raw(spark, schemas.RAW_USERS, *[{"row_no": n, "login": f"u{i}"} for i, n in enumerate(NUMBERS)])
    done = imports.import_users(people, spark.createDataFrame([], schemas.USERS), "salt")
    assert done.users.count() + done.rejects.count() == len(NUMBERS)


def test_files_that_each_start_at_one(spark, folder):
    for name in ("b", "a"):
        files.write_landing(raw(spark, schemas.RAW_USERS, *[
            {"row_no": i, "login": f"{name}{i}"} for i in (1, 2)]).coalesce(1), f"{folder}/{name}", fixed.USER_HEADERS)
    read = lambda **o: files.read_users(spark, f"{folder}/[ab]", **o)
    spark_exists, files.exists = files.exists, lambda *a: True
    try:
        one, each = read(), read(per_file=True)
    finally:
        files.exists = spark_exists
    assert sorted(r.row_no for r in one.collect()) == [1, 1, 2, 2]
    assert [r.login for r in each.orderBy("row_no").collect()] == ["a1", "a2", "b1", "b2"]
    done = imports.import_users(each, spark.createDataFrame([], schemas.USERS), "salt")
    assert done.users.count() == 4 and done.rejects.count() == 0


def test_import_of_files_that_each_start_at_one(spark, folder):
    """Two files a table, both counting from 1: refused as one, imported whole by file, also strictly."""
    landing = {n: f"{folder}/landing/{n}" for n in ("users", "products", "orders", "points")}
    people = [{"row_no": i, "login": f"u{i}"} for i in (1, 2)]
    goods = [{"row_no": i, "product_name": "x", "article": f"N{i}"} for i in (1, 2)]
    bought = [{"row_no": i, "order_date": "2025-03-01", "order_line": "N1", "pickup": "4"} for i in (1, 2)]
    for i in (1, 2):
        for name, schema, headers, rows in (
            ("users", schemas.RAW_USERS, fixed.USER_HEADERS, [{**r, "login": f"{r['login']}-{i}"} for r in people]),
            ("products", schemas.RAW_PRODUCTS, fixed.PRODUCT_HEADERS, goods),
            ("orders", schemas.RAW_ORDERS, fixed.ORDER_HEADERS, bought),
            ("points", schemas.RAW_POINTS, None, [{"row_no": n, "address": f"st. {i}-{n}"} for n in (1, 2)]),
        ):
            rows = raw(spark, schema, *rows).coalesce(1)
            files.write_landing(rows, f"{folder}/{name}{i}", headers)
            os.makedirs(landing[name], exist_ok=True)
            for part in glob.glob(f"{folder}/{name}{i}/part-*"):
                shutil.copy(part, f"{landing[name]}/{i}.csv")
    with pytest.raises(ImportRefused):
        run_import(spark, landing, f"{folder}/one", "r", "salt")
    report = run_import(spark, landing, f"{folder}/shop", "r", "salt", per_file=True)
    assert report.rejects.count() == 0
    count = {n: tables.read_table(spark, f"{folder}/shop", n).count() for n in ("users", "products", "orders", "order_items")}
    assert set(count.values()) == {4}
    points = tables.read_table(spark, f"{folder}/shop", "pickup_points").collect()
    assert [p.pp_name for p in points] == ["st. 2-2"]
    numbers = spark.createDataFrame([(0, -3), (0, 7), (5, 1), (5, -1), (5, 2 ** 39)], "p long, n long")
    over = files.number_over_files(F.col("p"), F.col("n"))
    back = numbers.select(files.file_place(over), files.number_in_file(over)).collect()
    assert [tuple(r) for r in back] == [(0, -3), (0, 7), (5, 1), (5, -1), (None, None)]


def test_what_the_import_keeps_and_refuses(spark, shop):
    """Order of an item's checks, descriptions as they are, addresses and product numbers that do not fit."""
    rows = [
        {"row_no": 1, "order_date": "2025-03-01", "order_line": "Z9,0; A1,0; Z8, 1 000"},
        {"row_no": 2, "order_date": "2025-03-01", "pickup": "x" * 256},
        {"row_no": 3, "order_date": "2025-03-01", "product_no": "99999999999"},
        {"row_no": 4, "order_date": "2025-03-01", "pickup": "x" * 255},
    ]
    done = imports.import_orders(
        raw(spark, schemas.RAW_ORDERS, *rows), addresses(spark), shop["orders"], shop["order_items"],
        shop["products"], shop["pickup_points"], shop["statuses"])
    assert reasons(done.rejects) == [
        (1, "bad_quantity", "abort"), (1, "bad_quantity", "abort"), (1, "unknown_article", "skip"),
        (2, "too_long", "abort"), (3, "bad_product_number", "abort")]
    assert [r.row_no for r in done.orders.orderBy("row_no").collect()] == [1, 3, 4]
    cleaned = cleaning.clean_products(raw(
        spark, schemas.RAW_PRODUCTS, {"row_no": 1, "product_name": "x", "article": "A", "description": " a\u00a0"},
        {"row_no": 2, "product_name": "x", "article": "A", "description": " \u00a0 "}))
    assert [r.product_desc for r in cleaned.rows.orderBy("row_no").collect()] == [" a\u00a0", None]


TEXTS = ["A1, 2\nZ9; C3,5", "back\\slash\\n", "\\\\n\\", "a\r\nb", "", 'say "x"; y', " edge ", "\\\n"]


def test_order_files_that_split(spark, folder):
    """Line breaks are escaped, so one large file is read by several tasks."""
    lines = [{"row_no": i, "order_date": "2025-03-01", "order_line": TEXTS[i % len(TEXTS)] + "x" * 100} for i in range(4000)]
    path = f"{folder}/orders"
    rows = raw(spark, schemas.RAW_ORDERS, *lines)
    files.write_landing(rows.coalesce(1), path, fixed.ORDER_HEADERS, escape_lines=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100KB")
    try:
        read = files.read_orders(spark, path, escaped_lines=True)
        assert read.rdd.getNumPartitions() > len(read.inputFiles()) == 1
        assert [r.order_line for r in read.orderBy("row_no").collect()] == [r["order_line"] for r in lines]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_escaped_lines(spark):
    frame = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    for r in frame.select("t", files.escaped_lines(F.col("t")).alias("e"),
                          files.unescaped_lines(files.escaped_lines(F.col("t"))).alias("b")).collect():
        assert r.b == r.t and (r.e is None or not {"\n", "\r"} & set(r.e))


def test_landing_files(spark, folder):
    path = f"{folder}/users.csv"
    with open(path, "w", encoding="utf-8-sig") as out:
        out.write('ФИО;row_no;Логин;Лишнее\n"Анна ""Аня""";1; ann ;x\n;2;bob;y\n')
    rows = files.read_users(spark, path).orderBy("row_no").collect()
    assert [(r.row_no, r.full_name, r.login, r.role) for r in rows] == [
        (1, 'Анна "Аня"', " ann ", None), (2, None, "bob", None)]
    assert files.read_products(spark, f"{folder}/none.csv").count() == 0
    with pytest.raises(ValueError, match="Дата заказа"):
        files.read_orders(spark, path)


def test_delimited_table(spark, folder):
    path = f"{folder}/sample.csv"
    with open(path, "w", encoding="utf-8-sig") as out:
        out.write('id;day;price;note\n1;27.02.2025;4990;"a ""b"" "\n2;;;\n')
    schema = "id int, day date, price decimal(10,2), note string"
    rows = files.read_delimited(spark, path, schema).orderBy("id").collect()
    assert tuple(rows[0]) == (1, datetime.date(2025, 2, 27), Decimal("4990.00"), 'a "b" ')
    assert tuple(rows[1]) == (2, None, None, None)
    with pytest.raises(Exception, match="(?i)header"):
        files.read_delimited(spark, path, "id int, price decimal(10,2), day date, note string").collect()


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def tiny_partitions(spark):
    """Shuffled joins, and partitions that count as skewed at test sizes."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_by_adaptive_execution(rows):
    return "skew=true" in rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot_lines(spark):
    return spark.range(0, 6000, 1, 8).selectExpr(
        "id as row_no", "concat('P', case when id % 3 = 0 then 7 else id % 190 + 1 end, ', 2') as order_text")


def test_one_article_on_a_third_of_the_items(spark, tiny_partitions, hot_lines):
    """A hot article in shuffled joins: its partition is split, every item is kept."""
    products = spark.range(1, 201).selectExpr("id as product_id", "concat('P', id) as product_art")
    resolved = resolve.resolve_items(hot_lines, products)
    rows = resolved.collect()
    assert len(rows) == 6000 and not any(r.problem for r in rows)
    assert sum(r.product_id == 7 for r in rows) >= 2000
    assert split_by_adaptive_execution(resolved)

    arts = hot_lines.selectExpr("row_no", "split_part(order_text, ',', 1) as art")
    missing = arts.join(resolve.article_keys(products.where("product_id > 7")), "art", "left_anti")
    assert len(missing.collect()) == sum(r.product_id <= 7 for r in rows)
    assert split_by_adaptive_execution(missing)


def test_one_name_on_a_third_of_the_rows(spark, tiny_partitions, hot_lines):
    rows = hot_lines.selectExpr("row_no", "split_part(order_text, ',', 1) as supplier")
    table = spark.range(1, 101).selectExpr("id as supp_id", "concat('P', id) as supp_name")
    found = dims.get_or_create(table, "supp_id", "supp_name", rows, "supplier")
    keyed = dims.attach_key(rows, "supplier", found)
    assert [r.supp_id is None for r in keyed.collect()] == [False] * 6000
    assert split_by_adaptive_execution(keyed)
