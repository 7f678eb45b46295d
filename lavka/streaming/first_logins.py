"""Registration with the logins in a state store: what a micro-batch costs depends on its own rows only.

``registration`` looks taken logins up in the user table, so every micro-batch reads all logins
so far. Here the stream itself is grouped by login, and the state store holds one
row per login: the one that came first. A micro-batch touches the state of its own
logins, spread by login over all state partitions; rows of a hot login are combined before the
shuffle. Nothing reads the user table; the next user number comes from the run records.

The row that stays is the one of the earliest micro-batch, then of the smallest row number. A
login is new in the micro-batch that its first row is of. Row numbers order the rows of one
micro-batch and need not be unique here. Spark repeats a micro-batch with the
same rows, time and state, and a published run is skipped, so every user is stored once.

Refused rows have no login to be grouped by; a second query over the same source, with a
checkpoint of its own, stores them. For many millions of logins set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which keeps state on disk.
"""

from pyspark.sql import functions as F

from lavka.operators.cleaning import clean_users
from lavka.operators.gate import number_missing
from lavka.operators.numbering import last_key, number_rows
from lavka.operators.users import REGISTERED
from lavka.session import cut, scratch
from lavka.sources import tables
from lavka.streaming.intake import batch_run, checkpoint_id

STREAM, REFUSED = "first_logins", "first_logins_refused"


def first_rows(rows):
    """The stream of logins that are new, each in the micro-batch of its first row; use with mode ``update``."""
    columns = [c for c in REGISTERED if c != "user_login"]
    first = F.min(F.struct("_time", "row_no", *columns)).alias("_first")
    grouped = rows.withColumn("_time", F.current_timestamp()).groupBy("user_login").agg(first, F.max("_time").alias("_now"))
    return grouped.where("_first._time = _now").select("user_login", "_first.row_no", *[f"_first.{c}" for c in columns])


def store_users(batch, run_id, root):
    """Store the new users of one micro-batch under a run of its own, numbered by row, then login."""
    spark = batch.sparkSession
    if tables.is_published(spark, root, run_id):
        return
    attempt = tables.new_attempt()
    last = last_key(tables.last_keys(spark, root, "users"), "user_id")
    with scratch(spark):
        # Stored first: numbering reads its input twice, which would run the state store's update twice.
        batch = cut(batch)
        tables.append_rows(number_rows(batch, ["row_no", "user_login"], "user_id", last), root, "users", attempt)
    tables.publish(spark, root, run_id, attempt, ["users"])


def store_rejects(batch, run_id, root):
    spark = batch.sparkSession
    if tables.is_published(spark, root, run_id):
        return
    attempt = tables.new_attempt()
    tables.append_rejects(batch, root, attempt)
    tables.publish(spark, root, run_id, attempt, [])


def keyed_registration(raw, root, checkpoint, salt, **trigger):
    """Start both queries over a stream of user rows; returns them, the one of the users first."""
    cleaned = clean_users(raw, salt, gate=number_missing)

    def start(rows, stream, mode, store):
        folder = f"{checkpoint}/{stream}"

        def run(batch, batch_id):
            store(batch, batch_run(stream, checkpoint_id(batch.sparkSession, folder), batch_id), root)

        return (
            rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", folder)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    return [start(first_rows(cleaned.rows), STREAM, "update", store_users),
            start(cleaned.rejects, REFUSED, "append", store_rejects)]


def keyed_rejects(spark, root):
    """Rejects of the published micro-batches."""
    return tables.read_rejects(spark, root, f"{REFUSED}-")
