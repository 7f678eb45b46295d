import random

from pyspark.sql import functions as F

from lavka.operators import orders, packing


def test_order_list(order_shop):
    rows = orders.order_list(*order_shop).collect()
    # A missing date counts as newest; then the newest date, the highest id.
    assert [r.id for r in rows] == [3, 4, 2, 1]
    text = {r.id: r.article for r in rows}
    assert text[1] == " B2  ×3, A1"
    assert text[2] == "C3"  # a missing article vanishes
    assert text[3] == "" and text[4] == ""
    assert {r.part for r in rows} == {0}
    assert [r.status_name for r in rows] == [None, "Новый", "Завершён", "Новый"]


def test_documents(order_shop):
    documents = {r.id: r for r in orders.order_documents(*order_shop).collect()}
    assert [tuple(i) for i in documents[2]["items"]] == [(5, None, 2), (3, "C3", 1)]
    assert documents[3]["items"] == []
    assert documents[1].receiver_code == 901 and documents[1].client_name == "Ann"
    assert orders.order_by_id(*order_shop, 1).collect()[0] == documents[1]
    assert orders.order_by_id(*order_shop, 99).collect() == []


def test_batch_lookup(spark, order_shop):
    keys = spark.createDataFrame([(1,), (1,), (77,)], "order_id long")
    assert [r.id for r in orders.orders_by_id(*order_shop, keys).collect()] == [1]


def test_editable_text(order_shop):
    _, items, products, _, _ = order_shop
    texts = {r.order_id: r.order_text for r in orders.editable_texts(items, products).collect()}
    assert texts == {1: "B2, 3, A1", 2: "C3"}


def test_hot_order_is_whole_and_in_order(spark, shop):
    """One order holds a third of all items: it comes in bounded parts."""
    rng = random.Random(7)
    lines = [(i, 1 if i % 3 == 0 else rng.randrange(2, 400), rng.choice([1, 2, 3]), rng.randrange(1, 5))
             for i in range(3000)]
    rng.shuffle(lines)
    items = spark.createDataFrame(lines, "order_item_id long, order_id long, product_id long, product_quantity int")
    items = items.repartition(6)
    heads = spark.range(1, 401).selectExpr(
        "id as order_id", "date'2025-01-01' as order_date", "cast(null as date) as order_pup_date",
        "1L as pp_id", "'x' as user_name", "1 as order_pp_code", "1L as status_id")
    tables = heads, items, shop["products"], shop["statuses"], shop["pickup_points"]
    size = 64
    found = orders.order_list(*tables, part_rows=size).collect()

    article = {1: "A1", 2: " B2 ", 3: "C3"}
    expected = {}
    for _, order, product, quantity in sorted(lines):
        expected.setdefault(order, []).append(article[product] + (f" ×{quantity}" if quantity > 1 else ""))
    texts = {}
    for row in found:
        texts.setdefault(row.id, []).append(row.article)
    assert {k: ", ".join(v) for k, v in texts.items() if k in expected} == {
        k: ", ".join(v) for k, v in expected.items()}
    parts = [r for r in found if r.id == 1]
    assert sorted(r.part for r in parts) == list(range(-(-1000 // size)))
    assert all(len(r.article.split(", ")) == size for r in parts if r.part < 1000 // size)
    assert all(r.part == 0 for r in found if r.id != 1)

    arrays = orders.order_documents(*tables, part_rows=size).where("id = 1").orderBy("part").collect()
    assert [i.quantity for r in arrays for i in r["items"]] == [q for _, o, _, q in sorted(lines) if o == 1]


def test_parts_do_not_depend_on_the_partitioning(spark, shop):
    """One rule for every order: row n is in part n div the size, whatever the number of tasks."""
    lines = [(i, i % 5, i % 3 + 1, 1 + i % 4) for i in range(600)]
    items = spark.createDataFrame(lines, "order_item_id long, order_id long, product_id long, product_quantity int")
    expected = {}
    for _, order, product, quantity in lines:
        expected.setdefault(order, []).append((product, quantity))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in (2, 5, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            for size in (7, 119, 120, 4096):
                found = {(r.order_id, r.part): [(i.product_id, i.quantity) for i in r["items"]] for r in
                         orders.order_arrays(items.repartition(tasks), shop["products"], part_rows=size).collect()}
                assert found == {(o, p): rows[p * size:(p + 1) * size] for o, rows in expected.items()
                                 for p in range(-(-len(rows) // size))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_beyond_a_task_are_cut_alike(spark):
    """Keys that a task may hold and larger ones, parts smaller than both, null keys, in any order."""
    sizes = {1: 1, 2: 6, 3: 7, 4: 8, 5: 40, 6: 3}
    lines = [(key, n) for key, size in sizes.items() for n in range(size)] + [(None, 1), (None, 2)]
    random.Random(3).shuffle(lines)
    rows = spark.createDataFrame(lines, "k long, n long").where("k is not null").repartition(5)
    packed = F.sort_array(F.collect_list("n")).alias("ns")
    for size in (1, 3, 7, 9):
        found = packing.pack(rows, "k", "n", packed, part_rows=size, task_rows=7).collect()
        assert sorted((r.k, r.part, r.ns) for r in found) == sorted(
            (k, p, list(range(p * size, min(n, (p + 1) * size)))) for k, n in sizes.items() for p in range(-(-n // size)))


def order_shuffles(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(order_id"), plan.count("- Exchange ")


def test_small_parts_of_editable_texts_shuffle_items_once(spark, order_shop):
    """orders of several small parts need no ranges, no second pass over their items and no join."""
    _, items, products, *_ = order_shop
    products = F.broadcast(products)
    found = orders.editable_texts(items, products, part_rows=1)
    assert order_shuffles(found) == (2, 2)  # the items and their keys of several parts
    assert sorted(map(tuple, found.collect())) == [(1, 0, "B2, 3"), (1, 1, "A1"), (2, 0, ""), (2, 1, "C3")]


def test_small_parts_of_the_order_list_shuffle_items_once(order_shop):
    """items meet once by order, whatever the size of a part; no ranges."""
    table, items, products, *others = order_shop
    products = F.broadcast(products)
    assert order_shuffles(orders.order_texts(items, products, part_rows=1)) == (2, 2)
    found = orders.order_list(table, items, products, *others, part_rows=1)
    assert sorted((r.id, r.part, r.article) for r in found.collect()) == [
        (1, 0, " B2  ×3"), (1, 1, "A1"), (2, 0, ""), (2, 1, "C3"), (3, 0, ""), (4, 0, "")]


def test_an_order_whose_items_fit_a_part_stays_whole(order_shop):
    """A product that comes twice gives order 1 more lines than items; what counts is the items."""
    _, items, products, *_ = order_shop
    twice = products.unionByName(products.where("product_id = 2"))
    texts = {(r.order_id, r.part): r.article for r in orders.order_texts(items, twice, part_rows=2).collect()}
    assert texts == {(1, 0): " B2  ×3,  B2  ×3, A1", (2, 0): "C3"}
    texts = {(r.order_id, r.part): r.article for r in orders.order_texts(items, twice, part_rows=1).collect()}
    assert texts == {(1, 0): " B2  ×3", (1, 1): " B2  ×3", (1, 2): "A1", (2, 0): None, (2, 1): "C3"}
