"""Streaming intake of orders: parse, resolve, store, micro-batch by micro-batch."""

import json

from pyspark.sql import functions as F

from lavka.operators.ordering import place_orders
from lavka.session import scratch
from lavka.sources import tables
from lavka.streaming.by_file import numbered_by_file, told_by_file, with_file

PLACED = ("orders", "order_items")
STREAM = "intake"


def batch_run(stream, query_id, batch_id):
    """Run of a micro-batch: no other stream, and no other checkpoint of this one, has it."""
    return f"{stream}-{query_id}-{batch_id:012d}"


def checkpoint_id(spark, checkpoint):
    """The id that Spark keeps in a checkpoint folder for as long as the folder lives."""
    stored = spark.read.text(f"{checkpoint}/metadata").agg(F.concat_ws("", F.collect_list("value"))).first()[0]
    return json.loads(stored)["id"]


def place_batch(forms, run_id, root, products, statuses, points):
    """Store the orders of one micro-batch under a run of its own.

    A batch whose run is published is done. One that failed before that writes
    another attempt: the effect is that of running once. ``products``, ``statuses``
    and ``points`` are functions from the session to the table as it is now.
    """
    spark = forms.sparkSession
    if tables.is_published(spark, root, run_id):
        return
    attempt = tables.new_attempt()
    orders, items = (tables.last_keys(spark, root, name) for name in PLACED)
    with scratch(spark):
        forms, places = numbered_by_file(forms)
        placed = place_orders(forms, orders, items, products(spark), statuses(spark), points(spark))
        tables.append_rows(placed.headers, root, "orders", attempt)
        tables.append_rows(placed.items, root, "order_items", attempt)
        tables.append_rejects(told_by_file(placed.rejects, places), root, attempt)
    tables.publish(spark, root, run_id, attempt, PLACED)


def order_intake(forms, root, checkpoint, products, statuses, points, per_file=False, **trigger):
    """Start the intake of a stream of order forms; returns the running query.

    With ``per_file`` the rows of each file of a file stream count from 1; the result is the
    same however files are dealt to micro-batches. Without it numbers are unique over
    the whole stream, which is checked within a micro-batch only.

    ``products``, ``statuses`` and ``points`` are called by each batch, so that it
    sees rows added since the batch before. The trigger defaults to all that is
    available.
    """
    def store(batch, batch_id):
        run_id = batch_run(STREAM, checkpoint_id(batch.sparkSession, checkpoint), batch_id)
        place_batch(batch, run_id, root, products, statuses, points)

    return (
        (with_file(forms) if per_file else forms).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def intake_rejects(spark, root):
    """Rejects of the published batches, with the file where the stream is read ``per_file``."""
    return tables.read_rejects(spark, root, f"{STREAM}-")
