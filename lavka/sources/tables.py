"""The retail tables as Parquet folders that grow by runs.

A run writes its rows into a folder of its own attempt; readers see them once the run
is recorded, and the record names the attempt. Nothing is ever overwritten: a run that
is repeated writes another attempt, a failed or refused attempt stays invisible, and a
recorded run stays as it is. The record of a run also holds the largest key it has
written to each table, so that giving out the next keys reads no table at all.

Two writers that start from the same state give out the same keys. So before its record is written, a run
claims the first new key of each of its tables by creating a file of that name, which the file system
lets one of them do (it must create files exclusively, as HDFS and local disks do). The other run is
refused and can be repeated. A run that stops between claim and record keeps its
claims: it is repeated under its own name, or given up by ``release``.
"""

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka import schemas
from lavka.sources.files import exists

RUNS = "runs"
CLAIMS = "claims"
REJECTS = "rejects"
RECORD = "run_id string, attempt string, last map<string,bigint>"


class RunPublished(Exception):
    """The run is recorded already; its rows are not written again."""


class RunConflict(Exception):
    """Another run has given out the same keys; this one must be repeated."""


def new_attempt():
    return uuid.uuid4().hex


def _stored(schema):
    return T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])


def append_rows(rows, root, name, attempt):
    """Write the new rows of a table under an attempt, which is not visible yet."""
    columns = schemas.TABLES[name].fieldNames()
    rows.select(*columns).write.mode("errorifexists").parquet(f"{root}/{name}/attempt={attempt}")


def read_attempt(spark, root, name, attempt):
    """What one attempt has written to a table, published or not."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}/attempt={attempt}")


def is_published(spark, root, run_id):
    return exists(spark, f"{root}/{RUNS}/{run_id}/_SUCCESS")


def _file(spark, path):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def claim(spark, root, name, first_key, run_id):
    """Let one run give out the keys of a table from ``first_key`` on."""
    fs, path = _file(spark, f"{root}/{CLAIMS}/{name}/{first_key}")
    try:
        out = fs.create(path, False)
    except Py4JJavaError:
        if not fs.exists(path):
            raise
        if claimed_by(spark, path.toString()) != run_id:
            raise RunConflict(f"{run_id}: keys of {name} from {first_key} on are taken") from None
        return
    out.write(bytearray(run_id.encode()))
    out.close()


def claimed_by(spark, path):
    fs, path = _file(spark, path)
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def release(spark, root, run_id):
    """Give up what an unpublished run has claimed."""
    if is_published(spark, root, run_id):
        raise RunPublished(run_id)
    fs, folder = _file(spark, f"{root}/{CLAIMS}/*/*")
    for status in fs.globStatus(folder) or []:
        if claimed_by(spark, status.getPath().toString()) == run_id:
            fs.delete(status.getPath(), False)


def publish(spark, root, run_id, attempt, names):
    """Make what the attempt has written to the named tables visible, in one small write.

    The write fails if the run has a record, or if another run has claimed its keys.
    """
    if is_published(spark, root, run_id):
        raise RunPublished(run_id)
    none = spark.createDataFrame([], "name string, first long, key long")
    keys = [
        read_attempt(spark, root, name, attempt).agg(
            F.lit(name).alias("name"), F.min(schemas.PRIMARY_KEYS[name]).cast("long").alias("first"),
            F.max(schemas.PRIMARY_KEYS[name]).cast("long").alias("key"),
        )
        for name in names
    ]
    found = reduce(DataFrame.unionByName, keys, none).collect()  # one row per table
    for name, first, _ in sorted(found):
        if first is not None:
            claim(spark, root, name, first, run_id)
    record = spark.createDataFrame([(run_id, attempt, {name: last for name, _, last in found})], RECORD)
    record.coalesce(1).write.mode("errorifexists").parquet(f"{root}/{RUNS}/{run_id}")


def published_runs(spark, root):
    """The run records."""
    if not exists(spark, f"{root}/{RUNS}"):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(f"{root}/{RUNS}/*")


def last_keys(spark, root, name):
    """The largest key of each published run, under the name of the table's key."""
    key = schemas.PRIMARY_KEYS[name]
    return published_runs(spark, root).select(F.col("last")[name].alias(key))


def read_table(spark, root, name):
    """Rows of all published runs."""
    schema = schemas.TABLES[name]
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(_stored(schema)).parquet(f"{root}/{name}")
    return stored.join(published_runs(spark, root).select("attempt"), "attempt", "left_semi").select(*schema.fieldNames())


def append_rejects(rejects, root, attempt):
    """Write the refused rows of an attempt."""
    rejects.write.mode("errorifexists").parquet(f"{root}/{REJECTS}/{attempt}")


def read_rejects(spark, root, prefix):
    """Rejects of the published runs whose name begins with ``prefix``."""
    if not exists(spark, f"{root}/{REJECTS}"):
        return spark.createDataFrame([], schemas.STREAM_REJECTS)
    attempts = published_runs(spark, root).where(F.startswith("run_id", F.lit(prefix))).select("attempt")
    stored = spark.read.schema(schemas.STREAM_REJECTS).parquet(f"{root}/{REJECTS}/*").withColumn(
        "attempt", F.regexp_extract(F.input_file_name(), f"/{REJECTS}/([0-9a-f]+)/", 1))
    return stored.join(attempts, "attempt", "left_semi").drop("attempt")
