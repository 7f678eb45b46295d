"""Order list and order documents."""

from pyspark.sql import functions as F

from lavka.functions.text import format_order_items, listed_item
from lavka.operators.packing import PART_ROWS, pack, pack_laid_out, pack_large
from lavka.operators.sizing import broadcast_if_small, lookup_side


def _with_names(orders, statuses, points):
    return orders.join(statuses, "status_id", "left").join(points, "pp_id", "left")


def _items_of_orders(items):
    """Items that can belong to an order; a missing key would be one hot group."""
    return items.where(F.col("order_id").isNotNull())


def order_item_lines(items, products):
    """Items with the article of their product."""
    return _items_of_orders(items).join(
        products.select("product_id", F.col("product_art").alias("article")), "product_id"
    )


def _listed(items, products):
    return order_item_lines(items, products).select(
        "order_id",
        "order_item_id",
        listed_item(F.col("article"), F.col("product_quantity")).alias("line"),
    )


def _text():
    return F.expr("listagg(line, ', ') within group (order by order_item_id)").alias("article")


def order_texts(items, products, part_rows=PART_ROWS):
    """Per order: its items as one text, in item order; a missing article is skipped."""
    return pack(_listed(items, products), "order_id", "order_item_id", _text(), part_rows, _items_of_orders(items))


def refreshed_texts(texts, touched, items, products, part_rows=PART_ROWS):
    """``texts`` as of before a run, brought up to date: only the orders the run has touched are packed again.

    ``touched`` has the keys of orders that were added, changed or removed, or whose items were;
    ``items`` are those after the run. The items of other orders are neither joined nor sorted.
    """
    keys = lookup_side(touched.select("order_id").distinct(), "order_id")
    again = order_texts(items.join(keys, "order_id", "left_semi"), products, part_rows)
    return texts.join(keys, "order_id", "left_anti").unionByName(again)


def order_list(orders, items, products, statuses, points, part_rows=PART_ROWS):
    """Orders with their item text, newest first.

    Items are packed before they meet the orders, so that join is one to one.
    Items 0 to 4095 of an order are in ``part`` 0, the next in part 1, and so on.
    """
    texts = order_texts(items, products, part_rows)
    return _list_rows(orders.join(texts, "order_id", "left"), statuses, points)


def _list_rows(rows, statuses, points):
    """The columns of the order list, newest order first, of orders with their texts."""
    return _with_names(rows, statuses, points).select(
        F.col("order_id").alias("id"),
        F.coalesce("part", F.lit(0)).alias("part"),
        "order_date",
        F.col("order_pup_date").alias("delivery_date"),
        F.col("pp_name").alias("pickup_point_address"),
        F.coalesce("article", F.lit("")).alias("article"),
        "status_name",
    ).orderBy(
        F.col("order_date").desc_nulls_first(), F.col("id").desc_nulls_first(), F.col("part")
    )


def _entries(items, products):
    """Each item once, as a struct that begins with its key: that is also what the items of an order are sorted by."""
    return order_item_lines(items, products).select("order_id", F.struct(
        "order_item_id", "product_id", "article", F.col("product_quantity").alias("quantity")).alias("entry"))


def _array():
    return F.transform(
        F.sort_array(F.collect_list("entry")),
        lambda e: F.struct(
            e["product_id"].alias("product_id"),
            e["article"].alias("article"),
            e["quantity"].alias("quantity"),
        ),
    ).alias("items")


def order_arrays(items, products, part_rows=PART_ROWS):
    """Per order: its items as an array in item order."""
    return pack(_entries(items, products), "order_id", "entry", _array(), part_rows, _items_of_orders(items))


def order_documents(orders, items, products, statuses, points, part_rows=PART_ROWS):
    """Order headers, each with the array of its items (empty when it has none)."""
    arrays = order_arrays(items, products, part_rows)
    return _document_rows(orders.join(arrays, "order_id", "left"), statuses, points)


def _document_rows(rows, statuses, points):
    """The columns of the order documents, of orders with their arrays."""
    return _with_names(rows, statuses, points).select(
        F.col("order_id").alias("id"),
        F.coalesce("part", F.lit(0)).alias("part"),
        "order_date",
        F.col("order_pup_date").alias("delivery_date"),
        F.col("pp_name").alias("pickup_point_address"),
        F.col("order_pp_code").alias("receiver_code"),
        F.col("user_name").alias("client_name"),
        "status_name",
        F.col("pp_id").alias("pickup_point_id"),
        F.coalesce(
            "items", F.expr("cast(array() as array<struct<product_id:bigint,article:string,quantity:int>>)")
        ).alias("items"),
    )


def _with_packed(orders, items, products, rows, order, packed, part_rows):
    """Laid-out orders with their packed items: neither is shuffled.

    Articles are broadcast if they are few enough; else items are shuffled by product. Orders
    that are too large for a part come from the rows that are kept apart: shuffled once if parts are
    small, sorted in ranges where an order is too large for a task.
    """
    articles = broadcast_if_small(products.select("product_id", "product_art"), 2_000_000)
    usual = pack_laid_out(rows(items.usual, articles), "order_id", packed)
    if items.hot is None:
        return orders.join(usual, "order_id", "left")
    hot = rows(items.hot, articles)
    if part_rows < PART_ROWS:
        large = pack(hot, "order_id", order, packed, part_rows, _items_of_orders(items.hot), cut_all=True)
    else:
        large = pack_large(hot, "order_id", order, packed, part_rows)
    keys = broadcast_if_small(items.hot.select("order_id").distinct())
    return orders.join(keys, "order_id", "left_anti").join(usual, "order_id", "left").unionByName(
        orders.join(keys, "order_id", "left_semi").join(large, "order_id", "left"))


def laid_out_list(orders, items, products, statuses, points, part_rows=PART_ROWS):
    """``order_list`` of tables laid out by order (see sources.laid_out); ``items`` is a LaidOut."""
    return _list_rows(_with_packed(orders, items, products, _listed, "order_item_id", _text(), part_rows), *map(broadcast_if_small, (statuses, points)))


def laid_out_documents(orders, items, products, statuses, points, part_rows=PART_ROWS):
    """``order_documents`` of tables laid out by order."""
    return _document_rows(_with_packed(orders, items, products, _entries, "entry", _array(), part_rows), *map(broadcast_if_small, (statuses, points)))


def order_by_id(orders, items, products, statuses, points, order_id):
    """Point lookup; the filter reaches both scans."""
    only = F.col("order_id") == order_id
    return order_documents(orders.where(only), items.where(only), products, statuses, points)


def orders_by_id(orders, items, products, statuses, points, keys):
    """Batch form of the point lookup: documents of all given orders."""
    wanted = lookup_side(keys.select("order_id").distinct(), "order_id")
    return order_documents(
        orders.join(wanted, "order_id", "left_semi"), items.join(wanted, "order_id", "left_semi"),
        products, statuses, points,
    )


def editable_texts(items, products, part_rows=PART_ROWS):
    """Per order: its items in the form the order form edits and parses."""
    arrays = order_arrays(items, products, part_rows)
    return arrays.select("order_id", "part", format_order_items(F.col("items")).alias("order_text"))
