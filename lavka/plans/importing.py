"""The whole import: addresses, users, products, orders; all or nothing."""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lavka import schemas
from lavka.operators.cleaning import ABORT
from lavka.operators.imports import (
    import_orders, import_products, import_users, orders_without_items, summary,
)
from lavka.operators.resolve import address_list
from lavka.sources import files, tables


class ImportRefused(Exception):
    """A strict import met rows that may not be stored; nothing was published."""


class ImportReport(NamedTuple):
    summary: DataFrame
    rejects: DataFrame


def run_import(spark, landing, root, run_id, salt, strict=True, formats="csv", escaped_lines=False,
               per_file=False, multiline=False):
    """Import the landing files into the tables under ``root``.

    ``landing`` maps users, products, orders and points to paths; a missing file
    counts as empty; with ``escaped_lines`` the orders file was written by
    ``write_landing(escape_lines=True)``, else its cells may span lines; with ``multiline`` the cells of
    all files may. With ``per_file`` the paths are
    folders of files whose rows each count from 1, and row numbers in rejects are to be read
    with ``files.file_place`` and ``files.number_in_file``. Every table is written under a new attempt first. With
    ``strict`` a single ``abort`` reject leaves the run unpublished; a run that is
    published already is refused before anything is read. Each stage reads back what
    the stage before it has written, so no lineage grows across stages and a lost
    executor repeats one stage at most.
    """
    if tables.is_published(spark, root, run_id):
        raise tables.RunPublished(run_id)
    attempt = tables.new_attempt()
    state = {
        name: tables.read_table(spark, root, name) for name in schemas.TABLES
        if name not in ("orders", "order_items")
    }
    numbered = {name: tables.last_keys(spark, root, name) for name in ("orders", "order_items")}
    options = {"file_format": formats, "per_file": per_file, **({"multiline": True} if multiline else {})}
    listed = address_list(files.read_points(spark, landing["points"], per_file, multiline))

    users = import_users(files.read_users(spark, landing["users"], **options), state["users"], salt)
    products = import_products(
        files.read_products(spark, landing["products"], **options),
        state["products"], state["suppliers"], state["categories"],
    )
    counts = _write(root, attempt, users=users.users, products=products.products,
                    suppliers=products.suppliers, categories=products.categories)

    written = tables.read_attempt(spark, root, "products", attempt)
    orders = import_orders(
        files.read_orders(spark, landing["orders"], escaped_lines=escaped_lines, **options), listed.addresses,
        numbered["orders"], numbered["order_items"], state["products"].unionByName(written),
        state["pickup_points"], state["statuses"],
    )
    counts |= _write(root, attempt, orders=orders.orders, order_items=orders.order_items,
                     pickup_points=orders.pickup_points, statuses=orders.statuses)

    rejected = reduce(
        DataFrame.unionByName, [listed.rejects, users.rejects, products.rejects, orders.rejects]
    )
    rejected.write.mode("errorifexists").parquet(f"{root}/rejects/{attempt}")
    report = import_report(spark, root, attempt, counts)
    if strict and report.rejects.where(F.col("severity") == ABORT).limit(1).count():
        raise ImportRefused(f"run {run_id} has rows to correct, see {root}/rejects/{attempt}")
    tables.publish(spark, root, run_id, attempt, schemas.TABLES)
    return report


def import_report(spark, root, attempt, counts):
    """Counts and rejects of an attempt; ``counts`` are those of the rows written, by table."""
    rejects = spark.read.schema(schemas.REJECTS).parquet(f"{root}/rejects/{attempt}")
    orders, items = (tables.read_attempt(spark, root, name, attempt) for name in ("orders", "order_items"))
    return ImportReport(summary(rejects, orders_without_items(orders, items), counts), rejects)


def _write(root, attempt, **frames):
    """Writes the rows of each table and returns their counts, taken as they were written."""
    seen = {name: Observation(name) for name in frames}
    for name, rows in frames.items():
        tables.append_rows(rows.observe(seen[name], F.count(F.lit(1)).alias("rows")), root, name, attempt)
    return {name: observation.get["rows"] for name, observation in seen.items()}
