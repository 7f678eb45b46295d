"""The registered queries: every operator over whole tables."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka import fixed
from lavka.functions.cards import card_columns, highlight, net_price
from lavka.functions.numbers import iso_date
from lavka.functions.roles import is_admin, is_manager_or_admin, role_code, role_title
from lavka.functions.text import explode_order_text, parse_order_text
from lavka.operators import (
    audit, catalog, changes, cleaning, digests, dims, imports, names, ordering, orders, products, resolve,
    trigrams, users,
)
from lavka.plans.importing import run_import
from lavka.plans.views import SALT, source, view, views
from lavka.session import cut, shared_dir
from lavka.sources import files, laid_out, tables
from lavka.streaming import deliveries, first_logins, intake, registration

ORDER_TABLES = ("orders", "order_items", "product_articles", "statuses", "pickup_points")
CATALOG_TABLES = ("products", "categories", "suppliers")

SEARCH_TEXT = " RED w_dget"
SUPPLIER = "Supplier#000000001"


def _iso(rows):
    """Dates as ISO text, so that both engines report the same values."""
    return rows.select([
        iso_date(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name)
        for f in rows.schema
    ])


def _scratch(spark):
    """A new folder for one query run, where every executor can reach it."""
    return f"{shared_dir(spark)}/lavka-{uuid.uuid4().hex}"


# ---- orders -----------------------------------------------------------------

def order_list(spark, sf):
    return _iso(orders.order_list(*views(spark, sf, *ORDER_TABLES)))


def _document_rows(documents):
    return _iso(documents.select(
        *[c for c in documents.columns if c != "items"], F.posexplode_outer("items").alias("pos", "item")
    ).select("*", "item.product_id", "item.article", "item.quantity").drop("item"))


def order_documents(spark, sf):
    return _document_rows(orders.order_documents(*views(spark, sf, *ORDER_TABLES)))


def order_lookup(spark, sf):
    keys = view(spark, sf, "order_changes").select("order_id")
    return _document_rows(orders.orders_by_id(*views(spark, sf, *ORDER_TABLES), keys))


def _laid_out(spark, sf, items="order_items", **options):
    """Orders and items stored by order once; the other order tables as they are."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table, lines, *others = views(spark, sf, "orders", items, *ORDER_TABLES[2:])
    return laid_out.bucketed(table, "order_id", buckets), laid_out.lay_out(lines, "order_id", buckets, **options), *others


def order_list_laid_out(spark, sf):
    return _iso(orders.laid_out_list(*_laid_out(spark, sf)))


def order_list_laid_out_parts(spark, sf):
    """Parts of three items: nearly half of the orders are kept apart from the buckets."""
    return _iso(orders.laid_out_list(*_laid_out(spark, sf, part_rows=3), part_rows=3))


def order_documents_laid_out(spark, sf):
    return _document_rows(orders.laid_out_documents(*_laid_out(spark, sf)))


def _replace_laid_out(spark, sf):
    table, items, *others = _laid_out(spark, sf, "numbered_items")
    articles, statuses, points = others
    changes = view(spark, sf, "faulty_changes")
    return ordering.replace_orders(changes, table, laid_out.together(items), articles, statuses, points)


def orders_replaced_laid_out(spark, sf):
    return _iso(_replace_laid_out(spark, sf).orders)


def order_items_replaced_laid_out(spark, sf):
    return _replace_laid_out(spark, sf).items


def orders_blocked_laid_out(spark, sf):
    table, items, *_ = _laid_out(spark, sf)
    return ordering.delete_orders(table, table, laid_out.together(items)).blocked


def order_texts_refreshed(spark, sf):
    """Item texts brought up to date after a run that empties every seventh order and doubles every eleventh."""
    items, articles = views(spark, sf, "order_items", "product_articles")
    order = F.col("order_id")
    after = items.where(order % 7 != 0).withColumn("product_quantity", F.when(
        order % 11 == 0, 2 * F.col("product_quantity")).otherwise(F.col("product_quantity")))
    touched = items.where((order % 7 == 0) | (order % 11 == 0)).select("order_id")
    return orders.refreshed_texts(cut(orders.order_texts(items, articles)), touched, after, articles)


def order_list_parts(spark, sf):
    return _iso(orders.order_list(*views(spark, sf, *ORDER_TABLES), part_rows=3))


def order_text_parts(spark, sf):
    return orders.editable_texts(*views(spark, sf, "order_items", "product_articles"), part_rows=2)


def order_text_format(spark, sf):
    return orders.editable_texts(*views(spark, sf, "order_items", "product_articles"))


def order_text_parse(spark, sf):
    texts = orders.editable_texts(*views(spark, sf, "order_items", "product_articles"))
    return explode_order_text(texts, "order_text", "order_id", "part")


def order_lines(spark, sf):
    return explode_order_text(view(spark, sf, "order_forms"), "product_article", "row_no")


def order_line_arrays(spark, sf):
    forms = view(spark, sf, "order_forms")
    lines = forms.select("row_no", parse_order_text(F.col("product_article")).alias("items"))
    return lines.select("row_no", F.size("items").alias("items"), F.expr(
        "aggregate(items, 0L, (n, i) -> n + coalesce(i.qty, 0))").alias("pieces"))


# ---- catalogue --------------------------------------------------------------

def _catalog(**options):
    return lambda spark, sf: catalog.list_catalog(*views(spark, sf, *CATALOG_TABLES), **options)


def catalog_search_indexed(spark, sf):
    """The search by an index of trigrams that is stored with the catalogue."""
    rows = cut(catalog.catalog_rows(*views(spark, sf, *CATALOG_TABLES)))
    return catalog.sort_catalog(trigrams.indexed_search(rows, trigrams.trigram_index(rows), SEARCH_TEXT))


def product_lookup(spark, sf):
    keys = source(spark, sf, "orders").select(F.col("o_custkey").alias("product_id"))
    return catalog.products_by_id(*views(spark, sf, *CATALOG_TABLES), keys)


def catalog_cards(spark, sf):
    return card_columns(catalog.catalog_rows(*views(spark, sf, *CATALOG_TABLES)))


def net_prices(spark, sf):
    price, discount = F.col("product_price"), F.col("product_discount")
    return view(spark, sf, "products").select(
        "product_id", price.alias("price"), discount.alias("discount"),
        net_price(price, discount).alias("net_price"),
    )


def highlight_counts(spark, sf):
    kind = highlight(F.col("product_discount"), F.col("product_stock")).alias("highlight")
    return view(spark, sf, "products").groupBy(kind).agg(F.count("*").alias("products"))


def _catalog_snapshots(spark, sf):
    """Half of the forms are products before; then changes, removal of what no order has, the other half."""
    table, forms, edits, items = views(spark, sf, "products", "product_forms", "product_changes", "order_items")
    named = views(spark, sf, "suppliers", "categories")

    def inserted(half, into):
        return products.insert_products(forms.where(F.col("row_no") % 2 == half), into, *named).rows.drop("row_no")

    before = table.unionByName(inserted(1, table))
    after = products.update_products(edits, before, *named).table
    deleted = products.delete_products(before, before, items).deleted
    return before, after.join(deleted, "product_id", "left_anti").unionByName(inserted(0, before))


def catalog_changes(spark, sf):
    return changes.change_feed(*_catalog_snapshots(spark, sf), "product_id")


def catalog_changes_by_digest(spark, sf):
    """The same of snapshots that are stored with their digest trees."""
    snapshots = [cut(s) for s in _catalog_snapshots(spark, sf)]
    trees = [cut(digests.digest_tree(s, "product_id")) for s in snapshots]
    return digests.change_feed_by_digest(*snapshots, "product_id", trees)


# ---- name lists -------------------------------------------------------------

def supplier_names(spark, sf):
    return names.name_list(view(spark, sf, "suppliers"), "supp_id", "supp_name")


def category_names(spark, sf):
    return names.name_list(view(spark, sf, "categories"), "categ_id", "categ_name")


def status_names(spark, sf):
    return names.name_list(view(spark, sf, "statuses"), "status_id", "status_name")


def manufacturer_names(spark, sf):
    return names.manufacturer_names(view(spark, sf, "products"))


def pickup_list(spark, sf):
    return names.pickup_list(view(spark, sf, "pickup_points"))


# ---- cleaning and import ----------------------------------------------------

def clean_users(spark, sf):
    return cleaning.clean_users(view(spark, sf, "raw_users"), SALT, cut).rows


def clean_products(spark, sf):
    return cleaning.clean_products(view(spark, sf, "raw_products"), cut).rows


def clean_orders(spark, sf):
    return _iso(cleaning.clean_orders(view(spark, sf, "raw_orders"), cut).rows)


def clean_rejects(spark, sf):
    raw = views(spark, sf, "raw_users", "raw_products", "raw_orders")
    return (
        cleaning.clean_users(raw[0], SALT, cut).rejects
        .unionByName(cleaning.clean_products(raw[1], cut).rejects)
        .unionByName(cleaning.clean_orders(raw[2], cut).rejects)
    )


def users_new(spark, sf):
    return imports.import_users(*views(spark, sf, "raw_users", "users"), SALT).users


def dim_get_or_create(spark, sf):
    raw, table = views(spark, sf, "raw_products", "suppliers")
    return dims.get_or_create(table, "supp_id", "supp_name", raw, "supplier").keys


def dim_created(spark, sf):
    raw, table = views(spark, sf, "raw_products", "categories")
    return dims.get_or_create(table, "categ_id", "categ_name", raw, "category").created


def pickup_resolve(spark, sf):
    raw, lines = views(spark, sf, "raw_orders", "raw_points")
    return resolve.resolve_pickups(raw, resolve.kept_addresses(lines)).select("row_no", "pickup_address")


def pickup_without_list(spark, sf):
    raw, lines = views(spark, sf, "raw_orders", "raw_points")
    none = resolve.kept_addresses(lines.withColumn("address", F.lit(" ")))
    return resolve.resolve_pickups(raw, none).select("row_no", "pickup_address")


def _import_products(spark, sf):
    return imports.import_products(*views(spark, sf, "raw_products", "products", "suppliers", "categories"))


def products_imported(spark, sf):
    return _import_products(spark, sf).products


def _import_orders(spark, sf):
    raw, lines = views(spark, sf, "raw_orders", "raw_points")
    return imports.import_orders(
        raw, resolve.kept_addresses(lines),
        *views(spark, sf, "orders", "numbered_items", "product_articles", "pickup_points", "statuses"),
    )


def orders_imported(spark, sf):
    return _iso(_import_orders(spark, sf).orders)


def order_items_imported(spark, sf):
    return _import_orders(spark, sf).order_items


def import_rejects(spark, sf):
    return _import_orders(spark, sf).rejects


def import_summary(spark, sf):
    people = imports.import_users(*views(spark, sf, "raw_users", "users"), SALT)
    goods, sales = _import_products(spark, sf), _import_orders(spark, sf)
    rejects = people.rejects.unionByName(goods.rejects).unionByName(sales.rejects)
    return imports.summary(
        rejects, imports.orders_without_items(sales.orders, sales.order_items),
        users=people.users, products=goods.products, orders=sales.orders, order_items=sales.order_items,
        suppliers=goods.suppliers, categories=goods.categories,
        pickup_points=sales.pickup_points, statuses=sales.statuses,
    )


def _landed(spark, sf, folder, *missing):
    """Landing files of the raw views, line breaks escaped; the paths of all four."""
    headers = {
        "users": fixed.USER_HEADERS, "products": fixed.PRODUCT_HEADERS,
        "orders": fixed.ORDER_HEADERS, "points": None,
    }
    landing = {name: f"{folder}/landing/{name}" for name in headers}
    for name, columns in headers.items():
        if name not in missing:
            files.write_landing(view(spark, sf, f"raw_{name}"), landing[name], columns, escape_lines=name == "orders")
    return landing


def import_files(spark, sf):
    """Files to tables: landing files are written, imported into an empty shop, counted."""
    folder = _scratch(spark)
    landing = _landed(spark, sf, folder)
    return run_import(spark, landing, f"{folder}/shop", "first", SALT, strict=False, escaped_lines=True).summary


def import_missing_files(spark, sf):
    """The same without a users and a products file: they count as empty, the import goes on."""
    folder = _scratch(spark)
    landing = _landed(spark, sf, folder, "users", "products")
    return run_import(spark, landing, f"{folder}/shop", "first", SALT, strict=False, escaped_lines=True).summary


def _imported(spark, sf, *names):
    """Shop made of plain files whose cells span lines, the descriptions' too; the other files are missing."""
    folder = _scratch(spark)
    landing = {name: f"{folder}/landing/{name}" for name in ("users", "products", "orders", "points")}
    headers = {"users": fixed.USER_HEADERS, "products": fixed.PRODUCT_HEADERS, "orders": fixed.ORDER_HEADERS}
    for name in names:
        rows = view(spark, sf, f"raw_{name}")
        if name == "products":
            rows = rows.withColumn("description", F.concat("description", F.lit('\n";'), "product_name", F.lit('\n')))
        files.write_landing(rows, landing[name], headers.get(name))
    run_import(spark, landing, f"{folder}/shop", "first", SALT, strict=False, multiline=True)
    return lambda name: tables.read_table(spark, f"{folder}/shop", name)


def import_stored_users(spark, sf):
    """What an import has stored of the users file."""
    return _imported(spark, sf, "users")("users")


def import_stored_products(spark, sf):
    """What an import has stored of the products file, with the names of suppliers and categories."""
    stored = _imported(spark, sf, "products")
    return stored("products").join(stored("suppliers"), "supp_id", "left").join(stored("categories"), "categ_id", "left").drop(
        "supp_id", "categ_id")


def import_stored_orders(spark, sf):
    """What an import has stored of orders, items, pickup points and statuses: a row per item."""
    stored = _imported(spark, sf, "products", "orders", "points")
    rows = stored("orders").join(stored("order_items"), "order_id", "left")
    rows = rows.join(stored("pickup_points"), "pp_id", "left").join(stored("statuses"), "status_id", "left")
    return _iso(rows.drop("pp_id", "status_id"))


def delimited_table(spark, sf):
    """A table written with ; and doubled quotes and day.month.year, read back by its schema."""
    path = f"{_scratch(spark)}/orders"
    note = F.format_string('"%s"; said ""%d"" ', "user_name", "order_pp_code").alias("note")
    files.write_delimited(view(spark, sf, "orders").select("order_id", "order_date", "order_pup_date", note), path)
    return _iso(files.read_delimited(
        spark, path, "order_id bigint, order_date date, order_pup_date date, note string"))


def _resolved(spark, sf):
    forms, table = views(spark, sf, "order_forms", "product_articles")
    return resolve.resolve_items(forms, table, text="product_article")


def items_strict(spark, sf):
    return resolve.strict_orders(_resolved(spark, sf))


def items_lenient(spark, sf):
    return resolve.lenient_items(_resolved(spark, sf)).select("row_no", "pos", "product_id", "qty")


def items_rejects(spark, sf):
    return resolve.item_rejects(_resolved(spark, sf)).select("row_no", "pos", "art", "problem")


# ---- maintenance ------------------------------------------------------------

def _insert_products(spark, sf):
    return products.insert_products(*views(spark, sf, "product_forms", "products", "suppliers", "categories"))


def products_inserted(spark, sf):
    return _insert_products(spark, sf).rows


def products_insert_rejects(spark, sf):
    return _insert_products(spark, sf).rejects


def _update_products(spark, sf):
    return products.update_products(*views(spark, sf, "product_changes", "products", "suppliers", "categories"))


def products_updated(spark, sf):
    return _update_products(spark, sf).table


def products_update_rejects(spark, sf):
    return _update_products(spark, sf).rejects


def _delete_products(spark, sf):
    """Every product and every newly inserted one is to be deleted."""
    present = view(spark, sf, "products").select("product_id").unionByName(
        _insert_products(spark, sf).rows.select("product_id")
    )
    return products.delete_products(present, present, view(spark, sf, "order_items"))


def products_deletable(spark, sf):
    return _delete_products(spark, sf).deleted


def products_blocked(spark, sf):
    return _delete_products(spark, sf).blocked


def _place_orders(spark, sf):
    return ordering.place_orders(*views(
        spark, sf, "faulty_forms", "orders", "numbered_items", "product_articles", "statuses", "pickup_points"
    ))


def orders_inserted(spark, sf):
    return _iso(_place_orders(spark, sf).headers)


def order_items_inserted(spark, sf):
    return _place_orders(spark, sf).items


def orders_insert_rejects(spark, sf):
    return _place_orders(spark, sf).rejects


def _replace_orders(spark, sf):
    return ordering.replace_orders(*views(
        spark, sf, "faulty_changes", "orders", "numbered_items", "product_articles", "statuses", "pickup_points"
    ))


def orders_replaced(spark, sf):
    return _iso(_replace_orders(spark, sf).orders)


def order_items_replaced(spark, sf):
    return _replace_orders(spark, sf).items


def orders_replace_rejects(spark, sf):
    return _replace_orders(spark, sf).rejects


def _delete_orders(spark, sf):
    table, items = views(spark, sf, "orders", "order_items")
    return ordering.delete_orders(table, table, items)


def orders_deletable(spark, sf):
    return _delete_orders(spark, sf).deleted


def orders_blocked(spark, sf):
    return _delete_orders(spark, sf).blocked


def constraint_audit(spark, sf):
    read = lambda name: view(spark, sf, name)
    return audit.audit({
        "products": read("audit_products"), "orders": read("audit_orders"),
        "order_items": read("audit_items"), "suppliers": read("suppliers"),
        "categories": read("categories"), "statuses": read("statuses"),
        "pickup_points": read("pickup_points"), "users": read("audit_users"),
    })


# ---- users ------------------------------------------------------------------

def roles_normalised(spark, sf):
    code = role_code(F.col("role"))
    return view(spark, sf, "raw_users").select(
        "row_no", code.alias("role_code"), role_title(code).alias("role_title"),
        is_admin(code).alias("is_admin"), is_manager_or_admin(code).alias("is_manager_or_admin"),
    )


def role_capabilities(spark, sf):
    return users.entitlements(view(spark, sf, "users"))


def signin_matches(spark, sf):
    return users.signin_matches(*views(spark, sf, "attempts", "users"), SALT)


# ---- streams ----------------------------------------------------------------

def _land(spark, rows, folder):
    """Write rows as files and read them as a stream."""
    rows.write.mode("overwrite").parquet(f"{folder}/landing")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/landing")


def stream_order_intake(spark, sf):
    folder = _scratch(spark)
    forms = _land(spark, view(spark, sf, "faulty_forms"), folder)
    root = f"{folder}/shop"
    readers = [lambda session, name=name: view(session, sf, name) for name in (
        "product_articles", "statuses", "pickup_points")]
    intake.order_intake(forms, root, f"{folder}/checkpoint", *readers).awaitTermination()
    stored = tables.read_table(spark, root, "orders").join(
        tables.read_table(spark, root, "order_items"), "order_id", "left"
    )
    return _iso(stored)


def stream_first_login(spark, sf):
    folder = _scratch(spark)
    raw = _land(spark, view(spark, sf, "raw_users"), folder)
    root = f"{folder}/shop"
    registration.registration(raw, root, f"{folder}/checkpoint", SALT).awaitTermination()
    return tables.read_table(spark, root, "users")


def _drained(queries):
    for query in queries:
        query.awaitTermination()
    return queries


def stream_keyed_logins(spark, sf):
    """Two waves of user rows, the second after a restart from the checkpoint; logins are in the state store."""
    folder = _scratch(spark)
    raw = view(spark, sf, "raw_users")
    root = f"{folder}/shop"
    later = F.coalesce(F.col("row_no") % 1000 >= 500, F.lit(True))
    for wave in (raw.where(~later), raw.where(later)):
        wave.write.mode("append").parquet(f"{folder}/landing")
        stream = spark.readStream.schema(raw.schema).parquet(f"{folder}/landing")
        _drained(first_logins.keyed_registration(stream, root, f"{folder}/checkpoint", SALT))
    return tables.read_table(spark, root, "users")


def stream_deliveries_once(spark, sf):
    """Order forms delivered three times, out of order and over two runs, taken once."""
    folder = _scratch(spark)
    forms = view(spark, sf, "order_forms").withColumn("sent", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_no") % 3600))
    for wave in (forms, forms.unionByName(forms)):
        wave.write.mode("append").parquet(f"{folder}/landing")
        stream = spark.readStream.schema(forms.schema).parquet(f"{folder}/landing")
        taken = deliveries.once(stream, ["row_no"], "sent", "2 hours").drop("sent")
        _drained([taken.writeStream.format("parquet").option("path", f"{folder}/taken").option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()])
    return spark.read.parquet(f"{folder}/taken")


QUERIES = {
    "order_list": order_list,
    "order_documents": order_documents,
    "order_lookup": order_lookup,
    "order_list_parts": order_list_parts,
    "order_texts_refreshed": order_texts_refreshed,
    "order_list_laid_out": order_list_laid_out,
    "order_list_laid_out_parts": order_list_laid_out_parts,
    "order_documents_laid_out": order_documents_laid_out,
    "orders_replaced_laid_out": orders_replaced_laid_out,
    "order_items_replaced_laid_out": order_items_replaced_laid_out,
    "orders_blocked_laid_out": orders_blocked_laid_out,
    "order_text_parts": order_text_parts,
    "order_text_format": order_text_format,
    "order_text_parse": order_text_parse,
    "order_lines": order_lines,
    "order_line_arrays": order_line_arrays,
    "catalog_list": _catalog(),
    "catalog_search": _catalog(text=SEARCH_TEXT),
    "catalog_search_indexed": catalog_search_indexed,
    "catalog_by_supplier": _catalog(supplier=SUPPLIER),
    "catalog_stock_asc": _catalog(order="asc"),
    "catalog_stock_desc": _catalog(order="desc"),
    "catalog_combined": _catalog(text="ring", supplier=SUPPLIER, order="desc"),
    "product_lookup": product_lookup,
    "catalog_cards": catalog_cards,
    "net_prices": net_prices,
    "highlight_counts": highlight_counts,
    "catalog_changes": catalog_changes,
    "catalog_changes_by_digest": catalog_changes_by_digest,
    "supplier_names": supplier_names,
    "category_names": category_names,
    "status_names": status_names,
    "manufacturer_names": manufacturer_names,
    "pickup_list": pickup_list,
    "clean_users": clean_users,
    "clean_products": clean_products,
    "clean_orders": clean_orders,
    "clean_rejects": clean_rejects,
    "users_new": users_new,
    "dim_get_or_create": dim_get_or_create,
    "dim_created": dim_created,
    "pickup_resolve": pickup_resolve,
    "pickup_without_list": pickup_without_list,
    "products_imported": products_imported,
    "orders_imported": orders_imported,
    "order_items_imported": order_items_imported,
    "import_rejects": import_rejects,
    "import_summary": import_summary,
    "import_files": import_files,
    "import_missing_files": import_missing_files,
    "import_stored_users": import_stored_users,
    "import_stored_products": import_stored_products,
    "import_stored_orders": import_stored_orders,
    "delimited_table": delimited_table,
    "items_strict": items_strict,
    "items_lenient": items_lenient,
    "items_rejects": items_rejects,
    "products_inserted": products_inserted,
    "products_insert_rejects": products_insert_rejects,
    "products_updated": products_updated,
    "products_update_rejects": products_update_rejects,
    "products_deletable": products_deletable,
    "products_blocked": products_blocked,
    "orders_inserted": orders_inserted,
    "order_items_inserted": order_items_inserted,
    "orders_insert_rejects": orders_insert_rejects,
    "orders_replaced": orders_replaced,
    "order_items_replaced": order_items_replaced,
    "orders_replace_rejects": orders_replace_rejects,
    "orders_deletable": orders_deletable,
    "orders_blocked": orders_blocked,
    "constraint_audit": constraint_audit,
    "roles_normalised": roles_normalised,
    "role_capabilities": role_capabilities,
    "signin_matches": signin_matches,
    "stream_order_intake": stream_order_intake,
    "stream_first_login": stream_first_login,
    "stream_keyed_logins": stream_keyed_logins,
    "stream_deliveries_once": stream_deliveries_once,
}
