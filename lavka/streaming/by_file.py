"""Row numbers of streams whose files each count their rows from 1.

A row is known by its file and its number in it. Files count in the order a file stream
takes them in, by their time of change, then by name: one micro-batch of several files
gives what one micro-batch for each of them gives.
"""

from pyspark.sql import functions as F

from lavka.operators.sizing import broadcast_if_small
from lavka.sources import files

FILE, CHANGED = "_file", "_changed"


def with_file(stream):
    """The rows of a file stream with the file they are from; other streams have none and fail."""
    return stream.select(
        "*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_modification_time").alias(CHANGED))


def numbered_by_file(batch):
    """``batch`` with row numbers over all its files, and its files with their places; no files without ``with_file``."""
    if FILE not in batch.columns:
        return batch, None
    found = sorted(map(tuple, batch.select(CHANGED, FILE).distinct().collect()))  # one row per file
    places = batch.sparkSession.createDataFrame([(name, i) for i, (_, name) in enumerate(found)], "file string, _place long")
    rows = batch.join(broadcast_if_small(places), F.col(FILE) == F.col("file"))
    number = files.number_over_files(F.col("_place"), F.col("row_no"))
    return rows.withColumn("row_no", number).drop(FILE, CHANGED, "file", "_place"), places


def told_by_file(rejects, places):
    """``rejects`` with the number in the file and the file; a row without a number has no file either."""
    if places is None:
        return rejects
    number = F.col("row_no")
    return rejects.join(broadcast_if_small(places), files.file_place(number) == F.col("_place"), "left").withColumn(
        "row_no", files.number_in_file(number)).drop("_place")
