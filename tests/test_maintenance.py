import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from lavka import schemas
from lavka.functions import roles
from lavka.operators import audit, ordering, products, users
from lavka.session import shared_dir
from lavka.sources import tables
from lavka.streaming import intake, registration

FORM = ("row_no long, product_id long, article string, product_name string, unit string, price string, "
        "supplier string, manufacturer string, category string, discount string, stock_quantity string, "
        "description string, photo string")
ORDER_FORM = ("row_no long, order_id long, product_article string, status_name string, pickup_point_id long, "
              "receiver_code string, user_name string, order_date date, delivery_date date")
DAY = datetime.date(2025, 5, 1)


def form(row_no, product_id=None, **cells):
    names = [c.split()[0] for c in FORM.split(", ")][2:]
    return (row_no, product_id, *[cells.get(n) for n in names])


def reasons(rejects):
    return sorted((r.row_no, r.reason) for r in rejects.collect())


def test_insert_products(spark, shop):
    forms = spark.createDataFrame([
        form(1, article=" N1 ", product_name=" kept ", supplier=" Alfa ", category="boots", discount="15.9", price="1.5"),
        form(2, supplier="Beta", category="Обувь", unit=" "),
        form(3, discount="x"), form(4, price="-1"), form(5, discount="101"), form(6, stock_quantity="y"),
        form(7, product_name="x" * 300),
    ], FORM)
    done = products.insert_products(forms, shop["products"], shop["suppliers"], shop["categories"])
    rows = {r.row_no: r for r in done.rows.collect()}
    assert (rows[1].product_id, rows[1].product_art, rows[1].product_name) == (6, "N1", " kept ")
    # Exact names only, nothing is created; an empty article is stored.
    assert (rows[1].supp_id, rows[1].categ_id, rows[1].product_discount) == (1, None, 15)
    assert (rows[2].product_id, rows[2].product_art, rows[2].supp_id, rows[2].categ_id) == (7, "", None, 2)
    assert rows[2].product_price is None and rows[2].product_unit is None and rows[2].product_stock == 0
    assert reasons(done.rejects) == [
        (3, "bad_discount"), (4, "check_price"), (5, "check_discount"), (6, "bad_stock"), (7, "too_long")]


def test_update_products(spark, shop):
    changes = spark.createDataFrame([
        form(3, 1, article="third", supplier="Alfa"), form(1, 1, article="first"), form(4, 1, discount="x"),
        form(2, 9, article="none"), form(5, 2, article="two"),
    ], FORM).withColumnRenamed("row_no", "change_no")
    done = products.update_products(changes, shop["products"], shop["suppliers"], shop["categories"])
    rows = {r.product_id: r for r in done.table.collect()}
    assert len(rows) == 5
    # The last valid change wins and replaces every column.
    assert (rows[1].product_art, rows[1].supp_id, rows[1].product_name) == ("third", 1, None)
    assert rows[2].product_art == "two" and rows[3].product_art == "C3"
    assert reasons(done.rejects) == [(2, "unknown_product"), (4, "bad_discount")]


def test_delete_products(spark, shop):
    keys = spark.createDataFrame([(1,), (2,), (4,), (4,), (9,)], "product_id long")
    done = products.delete_products(keys, shop["products"], shop["order_items"])
    assert [r.product_id for r in done.deleted.collect()] == [4]
    assert sorted(r.product_id for r in done.blocked.collect()) == [1, 2]


def order_form(row_no, line, order_id=None, status=None, point=None, code=None, user=None):
    return (row_no, order_id, line, status, point, code, user, DAY, DAY)


FORMS = [
    order_form(1, "A1, 2; B2", status=" Новый", point=1, code=" 7 ", user=" Ann "),
    order_form(2, " ; "), order_form(3, None), order_form(4, "A1, Z9"), order_form(5, "A1,1 000"),
    order_form(6, "A1,0"), order_form(7, "A1", point=99), order_form(8, "A1", code="99999999999"),
    order_form(9, "C3", status="новый", code="call", user=" "),
]
REFUSED = [(2, "no_items"), (3, "no_items"), (4, "unknown_article"), (5, "bad_quantity"), (6, "bad_quantity"),
           (7, "unknown_pickup_point"), (8, "bad_pickup_code")]


def order_tables(shop):
    return [shop[n] for n in ("orders", "order_items", "products", "statuses", "pickup_points")]


def test_place_orders(spark, shop):
    done = ordering.place_orders(spark.createDataFrame(FORMS, ORDER_FORM), *order_tables(shop))
    heads = {r.row_no: r for r in done.headers.collect()}
    assert sorted(heads) == [1, 9]
    assert (heads[1].order_id, heads[1].status_id, heads[1].order_pp_code, heads[1].user_name) == (5, 1, 7, "Ann")
    assert (heads[9].order_id, heads[9].status_id, heads[9].order_pp_code, heads[9].user_name) == (6, None, None, None)
    assert sorted(map(tuple, done.items.collect())) == [(15, 5, 1, 2), (16, 5, 2, 1), (17, 6, 3, 1)]
    assert reasons(done.rejects) == REFUSED
    # Every form is accepted or refused, once.
    assert len(heads) + done.rejects.count() == len(FORMS)


def test_replace_orders(spark, shop):
    changes = spark.createDataFrame([
        order_form(1, "A1,5", order_id=1), order_form(2, "C3; A1", order_id=1, user="new"),
        order_form(3, "Z9", order_id=1), order_form(4, "A1", order_id=77), order_form(5, "B2", order_id=3),
    ], ORDER_FORM).withColumnRenamed("row_no", "change_no")
    done = ordering.replace_orders(changes, *order_tables(shop))
    heads = {r.order_id: r for r in done.orders.collect()}
    assert len(heads) == 4
    assert (heads[1].user_name, heads[1].order_date, heads[1].pp_id) == ("new", DAY, None)
    assert heads[2].order_pup_date == datetime.date(2025, 2, 3)
    items = sorted(map(tuple, done.items.collect()))
    assert items == [(12, 2, 5, 2), (13, 2, 3, 1), (14, None, 1, 1), (15, 1, 3, 1), (16, 1, 1, 1), (17, 3, 2, 1)]
    assert reasons(done.rejects) == [(3, "unknown_article"), (4, "unknown_order")]


def test_delete_orders(spark, shop):
    keys = spark.createDataFrame([(1,), (3,), (8,)], "order_id long")
    done = ordering.delete_orders(keys, shop["orders"], shop["order_items"])
    assert [r.order_id for r in done.deleted.collect()] == [3]
    assert [r.order_id for r in done.blocked.collect()] == [1]


def test_audit(spark, shop):
    given = {**{n: shop[n] for n in schemas.TABLES if n in shop}}
    assert audit.audit(given).collect() == []
    given["products"] = shop["products"].withColumns({
        "product_id": F.least("product_id", F.lit(4)), "product_price": F.lit(-1), "product_discount": F.lit(101),
        "categ_id": F.lit(9), "product_name": F.repeat(F.lit("x"), 256)})
    given["order_items"] = shop["order_items"].withColumn("product_quantity", F.lit(0))
    found = {}
    for r in audit.audit(given).collect():
        found[(r.table_name, r.rule)] = found.get((r.table_name, r.rule), 0) + r.violations
    assert found == {
        ("products", "price_negative"): 5, ("products", "discount_range"): 5,
        ("products", "product_name_too_long"): 5, ("products", "product_id_not_unique"): 2,
        ("products", "categ_id_missing"): 5, ("order_items", "quantity_not_positive"): 5,
        ("order_items", "product_id_missing"): 1,
    }


@pytest.mark.parametrize("role, title, admin, manager", [
    (None, "Гость", False, False), ("", "Гость", False, False), ("  ", "  ", False, False),
    (" Admin ", "Администратор", True, True), ("administrator", "Администратор", True, True),
    ("MANAGER", "Менеджер", False, True), ("client", "Клиент", False, False),
    ("Courier", "Courier", False, False),
])
def test_roles(spark, role, title, admin, manager):
    row = spark.createDataFrame([(role,)], "role string").select(
        roles.role_title(F.col("role")), roles.is_admin(F.col("role")), roles.is_manager_or_admin(F.col("role")))
    assert tuple(row.first()) == (title, admin, manager)


def test_entitlements(spark):
    rows = spark.createDataFrame([(1, "manager", " ", "m", "h")], schemas.USERS)
    row = users.entitlements(rows).first().asDict()
    assert row["full_name"] == "—" and row["can_search"] and not row["can_add_order"]
    assert "user_secret" not in row


def test_forms_with_wrong_numbers(spark, shop):
    """A repeated number refuses its own rows, not a good order with another number."""
    forms = spark.createDataFrame([
        order_form(1, "A1"), order_form(1, "Z9"), order_form(2, "A1"), order_form(3, "Z9"),
    ], ORDER_FORM)
    forms = forms.unionByName(forms.where("row_no = 2").withColumn("row_no", F.lit(None).cast("long")))
    done = ordering.place_orders(forms, *order_tables(shop))
    assert [r.row_no for r in done.headers.collect()] == [2] and done.items.count() == 1
    assert sorted(map(str, ((r.row_no, r.reason) for r in done.rejects.collect()))) == sorted(map(str, [
        (1, "repeated_row_no"), (1, "repeated_row_no"), (3, "unknown_article"), (None, "no_row_no")]))


def shop_stream(spark, folder, root, readers, checkpoint="checkpoint"):
    def drain(**landed):
        for name, rows in landed.items():
            rows.write.parquet(f"{folder}/landing/{name}")
        schema = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/landing").schema
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/landing")
        intake.order_intake(source, root, f"{folder}/{checkpoint}", *readers).awaitTermination()
    return drain


def fixed_readers(shop):
    return [lambda spark, n=n: shop[n] for n in ("products", "statuses", "pickup_points")]


def test_stream_of_orders_equals_batch(spark, shop, folder):
    root, static = f"{folder}/shop", [shop[n] for n in ("products", "statuses", "pickup_points")]
    forms = spark.createDataFrame(FORMS, ORDER_FORM)
    batch = ordering.place_orders(
        forms, spark.createDataFrame([], schemas.ORDERS), spark.createDataFrame([], schemas.ORDER_ITEMS), *static)
    drain = shop_stream(spark, folder, root, fixed_readers(shop))
    drain(a=forms.where("row_no <= 5"))
    drain(b=forms.where("row_no > 5"))
    names = schemas.ORDERS.fieldNames()
    assert sorted(map(str, tables.read_table(spark, root, "orders").collect())) == sorted(
        map(str, batch.headers.select(*names).collect()))
    assert sorted(map(tuple, tables.read_table(spark, root, "order_items").collect())) == sorted(
        map(tuple, batch.items.collect()))
    assert reasons(intake.intake_rejects(spark, root)) == REFUSED
    # A published batch that runs again changes nothing.
    runs = [r.run_id for r in tables.published_runs(spark, root).collect()]
    intake.place_batch(forms.where("row_no > 5"), max(runs), root, *fixed_readers(shop))
    assert tables.read_table(spark, root, "order_items").count() == 3
    # A micro-batch leaves no intermediate table behind.
    left = spark.sparkContext._jvm.java.io.File(shared_dir(spark)).list()
    assert not [name for name in left if name.startswith("scratch-")]


def test_two_streams_on_one_shop(spark, shop, folder):
    """Orders, users, orders again from a new checkpoint: every key stays, and none is given twice."""
    root = f"{folder}/shop"
    forms = spark.createDataFrame([order_form(n, "A1") for n in (1, 2)], ORDER_FORM)
    shop_stream(spark, f"{folder}/one", root, fixed_readers(shop))(a=forms)
    first = sorted(map(str, tables.read_table(spark, root, "orders").collect()))
    spark.createDataFrame([(1, "ann", None, "Ann", "x")], schemas.RAW_USERS).write.parquet(f"{folder}/users")
    raw = spark.readStream.schema(schemas.RAW_USERS).parquet(f"{folder}/users")
    registration.registration(raw, root, f"{folder}/checkpoint", "salt").awaitTermination()
    shop_stream(spark, f"{folder}/one", root, fixed_readers(shop), "other")()
    orders = tables.read_table(spark, root, "orders").collect()
    assert sorted(r.order_id for r in orders) == [1, 2, 3, 4]
    assert set(first) <= set(map(str, orders)) and tables.read_table(spark, root, "users").count() == 1
    assert sorted(r.order_item_id for r in tables.read_table(spark, root, "order_items").collect()) == [1, 2, 3, 4]


def test_stream_sees_products_added_between_batches(spark, shop, folder):
    known = {"products": shop["products"]}
    readers = [lambda spark: known["products"], *fixed_readers(shop)[1:]]
    drain = shop_stream(spark, folder, f"{folder}/shop", readers)
    drain(a=spark.createDataFrame([order_form(1, "NEW")], ORDER_FORM))
    known["products"] = shop["products"].unionByName(
        shop["products"].where("product_id = 1").withColumns({"product_id": F.lit(99), "product_art": F.lit("NEW")}))
    drain(b=spark.createDataFrame([order_form(2, "NEW")], ORDER_FORM))
    items = tables.read_table(spark, f"{folder}/shop", "order_items").collect()
    assert [r.product_id for r in items] == [99]


def test_stream_of_users_first_login_wins(spark, folder):
    root = f"{folder}/shop"
    kind = schemas.RAW_USERS
    first = [(1, "ann", None, "Ann", "x"), (2, "ann", None, "Other", "x"), (3, " ", None, None, None)]
    second = [(4, " ann ", None, "Late", "x"), (5, "bob", None, "Bob", "x")]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, kind).write.parquet(f"{folder}/landing/{name}")
        raw = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{folder}/landing")
        registration.registration(raw, root, f"{folder}/checkpoint", "salt").awaitTermination()
    stored = tables.read_table(spark, root, "users").collect()
    assert sorted((r.user_id, r.user_login, r.user_name) for r in stored) == [(1, "ann", "Ann"), (2, "bob", "Bob")]


def test_stream_of_users_adds_up(spark, folder):
    """New users, rows whose login is taken and refused rows are all rows of the stream."""
    root, kind = f"{folder}/shop", schemas.RAW_USERS
    first = [(1, "ann", None, "Ann", "x"), (2, " ", None, "No login", "x"), (3, "ann", None, "Again", "x"),
             (None, "eve", None, None, "x"), (4, "x" * 256, None, None, "x")]
    second = [(5, "ann", None, "Late", "x"), (6, "bob", None, "Bob", "x"), (7, "cy", None, None, "x"), (7, "di", None, None, "x")]
    assert registration.registration_rejects(spark, root).count() == 0
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{folder}/landing/{name}")
        raw = spark.readStream.schema(kind).option("recursiveFileLookup", True).parquet(f"{folder}/landing")
        registration.registration(raw, root, f"{folder}/checkpoint", "salt").awaitTermination()
    rejects = [(r.source, r.row_no, r.reason) for r in registration.registration_rejects(spark, root).collect()]
    assert sorted(rejects, key=str) == sorted([
        ("users", 2, "blank_login"), ("users", None, "no_row_no"), ("users", 4, "too_long"),
        ("users", 7, "repeated_row_no"), ("users", 7, "repeated_row_no")], key=str)
    new, taken = tables.read_table(spark, root, "users").count(), 2
    assert new == 2 and new + taken + len(rejects) == len(first) + len(second)
    # An attempt that was never published shows nothing.
    tables.append_rejects(spark.createDataFrame([("users", 9, "lost", "skip")], schemas.REJECTS), root, tables.new_attempt())
    assert registration.registration_rejects(spark, root).count() == len(rejects)


@pytest.mark.parametrize("stream", ["orders", "users"])
def test_files_that_each_start_at_one_in_any_batches(spark, shop, folder, stream):
    """The same two files in one micro-batch and in two; the file with the later name came first."""
    if stream == "orders":
        rows = {"b": [order_form(1, "A1"), order_form(2, "C3"), order_form(3, "Z9")],
                "a": [order_form(1, "C3"), order_form(2, " "), order_form(4, "A1"), order_form(4, "A1")]}
        kind = spark.createDataFrame(rows["a"], ORDER_FORM).schema
    else:
        rows = {"b": [(1, "ann", None, "First", "x"), (2, "bob", None, "Bob", "x"), (3, " ", None, None, "x")],
                "a": [(1, "ann", None, "Late", "x"), (2, "cy", None, "Cy", "x"), (4, "x", None, None, "x"), (4, "y", None, None, "x")]}
        kind = schemas.RAW_USERS
    for age, name in ((20, "b"), (10, "a")):
        spark.createDataFrame(rows[name], kind).coalesce(1).write.parquet(f"{folder}/landing/{name}")
        for part in glob.glob(f"{folder}/landing/{name}/part-*"):
            os.utime(part, (1_700_000_000 - age, 1_700_000_000 - age))
    found = []
    for files_each in (1, 2):
        root = f"{folder}/shop{files_each}"
        source = spark.readStream.schema(kind).option("recursiveFileLookup", True).option(
            "maxFilesPerTrigger", files_each).parquet(f"{folder}/landing")
        if stream == "orders":
            run = intake.order_intake(source, root, f"{root}-checkpoint", *fixed_readers(shop), per_file=True)
            names, rejects = ("orders", "order_items"), intake.intake_rejects
        else:
            run = registration.registration(source, root, f"{root}-checkpoint", "salt", per_file=True)
            names, rejects = ("users",), registration.registration_rejects
        run.awaitTermination()
        assert tables.published_runs(spark, root).count() == 3 - files_each
        told = sorted((r.row_no, r.reason, r.file.split("/")[-2]) for r in rejects(spark, root).collect())
        found.append([told, *[sorted(map(str, tables.read_table(spark, root, n).collect())) for n in names]])
    assert found[0] == found[1]
    assert [t[0] for t in found[0][0]] == [2, 3, 4, 4] if stream == "orders" else [3, 4, 4]
    assert len(found[0][1]) == 3  # orders, or users
    if stream == "users":
        assert [r.user_name for r in tables.read_table(spark, root, "users").orderBy("user_id").collect()] == ["First", "Bob", "Cy"]
