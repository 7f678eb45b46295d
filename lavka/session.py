"""Session settings and the shared folder for files that outlive a stage."""

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above this size; wide cleaning projections
    # run faster split into small methods than fused into one of those.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def local_session(cores="*", partitions=8, memory="8g", folder=None, **extra):
    """Session for tests and the benchmark; on a cluster use the one you are given.

    ``folder`` is where intermediate tables go.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lavka")
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        **({"spark.checkpoint.dir": folder} if folder else {}),
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir.

    Else the one set by SparkContext.setCheckpointDir; the library makes none of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return named.rstrip("/")


_scratch = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark):
    """Intermediate tables made inside go to one folder, which is removed at the end.

    For jobs that run again and again, such as the batches of a stream. What is returned
    from inside must be written by then.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(rows):
    """Write an intermediate result as a table in the shared folder and go on from there.

    For results with several readers: the work above runs once, later readers
    take only the columns they need, and a lost executor takes nothing with it.
    """
    spark = rows.sparkSession
    path = f"{_scratch.get() or shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
