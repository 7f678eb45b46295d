"""Streaming registration: the first row of a login wins, for ever."""

from pyspark.sql import functions as F

from lavka.operators.cleaning import clean_users
from lavka.operators.sizing import broadcast_if_small
from lavka.operators.users import new_users
from lavka.session import cut, scratch
from lavka.sources import tables
from lavka.streaming.by_file import numbered_by_file, told_by_file, with_file
from lavka.streaming.intake import batch_run, checkpoint_id

STREAM = "registration"


def register_batch(raw, run_id, root, salt):
    """Store the new users of one micro-batch.

    Taken logins are those of the published runs, in the user table; no state store
    grows with them. The stored logins are filtered by the batch's own (broadcast if
    few), so that only hits are shuffled. Within the batch the choice of the first row
    combines before the shuffle. A published batch is done. Refused rows are stored
    beside the batch's users, see ``registration_rejects``.
    """
    spark = raw.sparkSession
    if tables.is_published(spark, root, run_id):
        return
    attempt = tables.new_attempt()
    users = tables.read_table(spark, root, "users")
    last = tables.last_keys(spark, root, "users")
    with scratch(spark):
        raw, places = numbered_by_file(raw)
        cleaned = clean_users(raw, salt, cut)
        rows = cleaned.rows
        logins = broadcast_if_small(rows.select(F.col("user_login").alias("_login")).distinct())
        hits = users.join(logins, F.trim("user_login") == F.col("_login"), "left_semi")
        tables.append_rows(new_users(rows, hits, last), root, "users", attempt)
        tables.append_rejects(told_by_file(cleaned.rejects, places), root, attempt)
    tables.publish(spark, root, run_id, attempt, ["users"])


def registration(raw, root, checkpoint, salt, per_file=False, **trigger):
    """Start registering a stream of user rows; returns the running query. ``per_file`` as in ``order_intake``."""
    def store(batch, batch_id):
        run_id = batch_run(STREAM, checkpoint_id(batch.sparkSession, checkpoint), batch_id)
        register_batch(batch, run_id, root, salt)

    return (
        (with_file(raw) if per_file else raw).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def registration_rejects(spark, root):
    """Rejects of the published batches. A valid row whose login is taken is none: its user is there."""
    return tables.read_rejects(spark, root, f"{STREAM}-")
