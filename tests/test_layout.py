import re

import pytest

from lavka.operators import audit, ordering, orders
from lavka.sources import laid_out


@pytest.fixture
def laid_out_shop(spark, order_shop):
    table, items, *others = order_shop
    return lambda **options: (
        laid_out.bucketed(table, "order_id", 4), laid_out.lay_out(items, "order_id", 4, **options), *others)


def shuffled_scans(rows):
    """The bucketed scans of a plan that lie below a shuffle of their rows, but for the final sort."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above, found = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+\-|]*", line).group())
        above = [(d, text) for d, text in above if d < depth]
        if "Bucketed: true" in line:
            shuffles = [t for _, t in above if "Exchange hashpartitioning" in t or "Exchange SinglePartition" in t]
            found.append((line.strip()[:60], shuffles))
        above.append((depth, line))
    assert found
    return [f for f in found if f[1]]


def same(one, other):
    return sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


@pytest.mark.parametrize("part_rows", [4096, 1])
def test_same_rows_without_a_shuffle(spark, order_shop, laid_out_shop, part_rows):
    """Orders of over one item are kept apart with part_rows = 1, as is the item without an order."""
    shop = laid_out_shop(part_rows=part_rows)
    assert shop[1].hot.count() == (1 if part_rows > 1 else 5)
    for plain, made in ((orders.order_list, orders.laid_out_list), (orders.order_documents, orders.laid_out_documents)):
        rows = made(*shop, part_rows=part_rows)
        assert same(rows, plain(*order_shop, part_rows=part_rows))
        assert shuffled_scans(rows) == []
    assert same(laid_out.together(shop[1]), order_shop[1])


def test_a_hot_order_is_kept_apart(spark, order_shop):
    table, _, *others = order_shop
    items = spark.range(6000).selectExpr(
        "id as order_item_id", "case when id % 2 = 0 then 1 else 2 + id % 3 end as order_id", "1L as product_id", "2 as product_quantity")
    made = laid_out.lay_out(items, "order_id", 4, part_rows=1500)
    assert made.hot.count() == 3000 and made.usual.count() == 3000
    shop = laid_out.bucketed(table, "order_id", 4), made, *others
    assert same(orders.laid_out_list(*shop, part_rows=1500), orders.order_list(table, items, *others, part_rows=1500))


def test_small_parts_need_no_ranges(laid_out_shop, monkeypatch):
    """only keys beyond a task are looked for before the one shuffle; the others are told apart after it."""
    asked = []
    monkeypatch.setattr(laid_out, "large_keys", lambda rows, key, size: asked.append(size))
    shop = laid_out_shop(part_rows=1)
    assert asked == [4096] and shop[1].usual.count() == 0 and shop[1].hot.count() == 5
    plan = orders.laid_out_list(*shop, part_rows=1)._jdf.queryExecution().executedPlan().toString()
    assert "_range" not in plan


def test_small_parts_of_orders_beyond_a_task(spark, order_shop):
    """Order 1 is too large for a task, the others have several parts or one."""
    table, _, *others = order_shop
    items = spark.range(5200).selectExpr(
        "id as order_item_id", "case when id < 5000 then 1 when id < 5190 then 2 else 4 end as order_id",
        "1L as product_id", "cast(id as int) as product_quantity")
    made = laid_out.lay_out(items, "order_id", 4, part_rows=64)
    assert made.hot.count() == 5190 and made.usual.count() == 10
    shop = laid_out.bucketed(table, "order_id", 4), made, *others
    found = {(r.id, r.part): r.article for r in orders.laid_out_list(*shop, part_rows=64).collect()}
    expected = {(order, p): ", ".join(f"A1 ×{n}" if n > 1 else "A1" for n in list(numbers)[p * 64:(p + 1) * 64])
                for order, numbers in {1: range(5000), 2: range(5000, 5190), 4: range(5190, 5200)}.items()
                for p in range(-(-len(numbers) // 64))}
    assert found == expected | {(3, 0): ""}


def test_replace_and_delete_shuffle_no_stored_table(spark, order_shop, laid_out_shop):
    table, items, *others = laid_out_shop()
    changes = spark.createDataFrame([(1, 1, "A1, 4", None, None, None, None, "2025-01-01", None)],
        "change_no long, order_id long, product_article string, status_name string, pickup_point_id long, receiver_code string, "
        "user_name string, order_date string, delivery_date string").selectExpr(
        "* except (order_date, delivery_date)", "cast(order_date as date) as order_date", "cast(delivery_date as date) as delivery_date")
    made = ordering.replace_orders(changes, table, laid_out.together(items), *others[:1], *others[1:])
    plain = ordering.replace_orders(changes, *order_shop)
    for rows, expected in ((made.orders, plain.orders), (made.items, plain.items)):
        assert same(rows, expected)
        assert shuffled_scans(rows) == []
    for rows, expected in zip(ordering.delete_orders(table, table, items.usual),
                              ordering.delete_orders(order_shop[0], order_shop[0], order_shop[1]), strict=True):
        assert same(rows, expected)
        assert shuffled_scans(rows) == []


def test_audit_reads_each_table_once_and_shuffles_once(spark, shop, folder):
    stored = {}
    for name, table in shop.items():
        table.write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.parquet(f"{folder}/{name}")
    plan = audit.audit(stored)._jdf.queryExecution().executedPlan().toString()
    for name in stored:
        assert len(re.findall(rf"FileScan parquet .*{folder}/{name}[],]", plan)) == 1
    assert plan.count("Exchange ") == 1


def test_audit_of_a_run_against_what_is_stored(spark, shop):
    """New rows alone: keys taken by known rows, references that known or new rows have."""
    def rows(name, *values):
        return spark.createDataFrame(values, shop[name].schema)

    new = {
        "orders": rows("orders", (9, None, None, 1, "Zoe", 1, 1), (2, None, None, 77, "Taken", 1, 1)),
        "order_items": rows("order_items", (50, 9, 2, 3), (51, 1, 99, 1), (52, 8, 1, -1), (None, 9, 1, 1)),
    }
    found = sorted(map(tuple, audit.audit(new, shop).collect()), key=str)
    assert found == sorted([
        ("orders", "order_id_not_unique", "2", 2), ("orders", "pp_id_missing", "77", 1),
        ("order_items", "product_id_missing", "99", 1), ("order_items", "order_id_missing", "8", 1),
        ("order_items", "quantity_not_positive", "52", 1), ("order_items", "order_item_id_not_unique", None, 1)], key=str)
    whole = {n: (shop[n].unionByName(new[n]) if n in new else shop[n]) for n in shop}
    before = set(map(tuple, audit.audit(shop).collect()))
    assert set(found) == set(map(tuple, audit.audit(whole).collect())) - before


def test_digests_find_what_changed(spark, shop):
    """Any column, a null for an empty text, rows added and removed; equal buckets are not joined."""
    from pyspark.sql import functions as F

    from lavka.operators import digests
    from lavka.operators.changes import change_feed
    from lavka.session import cut

    rows = spark.range(1, 3001).selectExpr(
        "id as product_id", "concat('art', id) as product_art", "if(id % 2 = 0, '', null) as product_desc", "id % 7 as stock")
    after = rows.where("product_id not in (5, 77)").withColumn(
        "product_desc", F.when(F.col("product_id") == 9, F.lit("")).when(F.col("product_id") != 10, F.col("product_desc"))).withColumn(
        "stock", F.when(F.col("product_id").isin(300, 301), 9 - F.col("stock")).otherwise(F.col("stock"))).unionByName(
        rows.limit(1).selectExpr("9999L as product_id", "product_art", "product_desc", "stock"))
    snapshots = [cut(rows), cut(after)]
    trees = [cut(digests.digest_tree(s, "product_id")) for s in snapshots]
    assert trees[0].where("level = 0").first().rows == 3000
    found = digests.change_feed_by_digest(*snapshots, "product_id", trees)
    assert same(found, change_feed(*snapshots, "product_id")) and found.count() == 7
    assert 1 <= digests.changed_buckets(*trees).count() <= 7
    assert digests.changed_buckets(trees[0], trees[0]).count() == 0
    assert digests.change_feed_by_digest(snapshots[0], snapshots[0], "product_id", [trees[0]] * 2).count() == 0


def test_refreshed_texts_equal_a_rebuild(spark, order_shop):
    """After an order is added, one changed and one emptied; untouched orders keep their stored texts."""
    _, items, products, *_ = order_shop
    before = orders.order_texts(items, products)
    after = items.where("order_id is null or order_id <> 2").unionByName(spark.createDataFrame(
        [(20, 1, 5, 1), (21, 7, 1, 2)], items.schema))
    touched = spark.createDataFrame([(1,), (2,), (7,), (1,)], "order_id long")
    found = orders.refreshed_texts(before, touched, after, products)
    assert same(found, orders.order_texts(after, products))


def test_import_counts_come_from_the_writing_pass(spark, folder):
    from lavka import schemas
    from lavka.plans import importing
    from lavka.sources import tables

    rows = spark.createDataFrame([(1, "a"), (2, "b")], schemas.SUPPLIERS)
    assert importing._write(folder, "x", suppliers=rows, categories=spark.createDataFrame([], schemas.CATEGORIES)) == {
        "suppliers": 2, "categories": 0}
    assert tables.read_attempt(spark, folder, "suppliers", "x").count() == 2
