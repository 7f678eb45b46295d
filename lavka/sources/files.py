"""Landing files: delimited text (or Parquet) with a header and a row number.

The order of rows in a distributed read is not defined, so a landing file
carries it in the column ``row_no``.
"""

import logging

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka import fixed, schemas
from lavka.operators.sizing import broadcast_if_small
from lavka.sources import records

log = logging.getLogger(__name__)

CSV = {"sep": ";", "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def exists(spark, path):
    """Does the path exist on its file system (any that Spark can read)?"""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_delimited(spark, path, schema, multiline=False, date_format="dd.MM.yyyy"):
    """Delimited table with a known layout.

    The header is checked against the schema, so a file with other columns
    fails instead of being misread.
    """
    reader = spark.read.schema(schema).options(**CSV).option("enforceSchema", False)
    return reader.option("multiLine", multiline).option("dateFormat", date_format).csv(path)


# With several files whose rows count from 1 each, a row's number is that of its file, from 0, in
# the upper bits, and its own in the lower.
FILE_BITS = 40
_HALF = 1 << (FILE_BITS - 1)


def number_over_files(place, number):
    """Row number over all files from that of the file and that in the file; NULL beyond 2**39."""
    return F.when(number.between(-_HALF, _HALF - 1), F.shiftleft(place.cast("long"), FILE_BITS) + number)


def file_place(number):
    """The number of the file, from 0, back from ``number_over_files``."""
    return F.shiftright(number + _HALF, FILE_BITS)


def number_in_file(number):
    """The row's number in its file back from ``number_over_files``."""
    return number - F.shiftleft(file_place(number), FILE_BITS)


def write_delimited(rows, path, date_format="dd.MM.yyyy"):
    """Delimited table for ``read_delimited``."""
    options = {**CSV, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).option("dateFormat", date_format).csv(path)


def read_landing(spark, path, headers, required=(), file_format="csv", multiline=False, escaped_lines=False,
                 per_file=False):
    """Landing frame by column name, all cells as text.

    A missing path gives an empty frame and a log line, so that an import
    goes on with the other files; a missing required column is an error. Cells
    with line breaks need ``multiline`` (see ``records``) or files with ``escaped_lines``; both are
    read in parallel. With ``per_file`` the row numbers of each file start anew; files count in the
    order of their names. A row number that is none is NULL, which the cleaning steps refuse.
    """
    schema = schemas.landing(headers)
    if not exists(spark, path):
        log.warning("no file %s: 0 rows", path)
        return spark.createDataFrame([], schema)
    if file_format != "csv":
        frame = _with_file(spark.read.format(file_format).load(path))
    elif multiline:
        frame = records.read_cells(spark, path, CSV)
    else:
        reader = spark.read.options(**CSV)
        found = reader.csv(path).columns  # reads the header line only
        text = ", ".join(f"`{c}` string" for c in found)
        frame = _with_file(reader.schema(text).option("enforceSchema", False).csv(path))
    present = set(frame.columns)
    by_name = {name: header for header, name in headers.items()}
    lost = [by_name[name] for name in required if by_name[name] not in present]
    if lost or "row_no" not in present:
        raise ValueError(f"{path}: missing columns {lost or ['row_no']}")
    frame = _numbered(spark, frame, path, per_file)
    unescape = unescaped_lines if escaped_lines else lambda c: c
    cells = [
        (unescape(F.col(f"`{header}`").cast("string")) if header in present else F.lit(None).cast("string")).alias(name)
        for header, name in headers.items()
    ]
    return frame.select("row_no", *cells)


def _with_file(frame):
    return frame.select(F.col("_metadata.file_path").alias("_file"), "*")


def _numbered(spark, frame, path, per_file):
    """``frame`` with its row numbers as numbers, of one file or of all."""
    frame = frame.withColumn("row_no", F.col("row_no").try_cast("long"))
    if not per_file:
        return frame
    places = spark.createDataFrame(list(zip(file_names(spark, path), range(1 << 23))), "file string, _place long")
    rows = frame.join(broadcast_if_small(places), F.col("_file") == F.col("file"), "left")
    return rows.withColumn("row_no", number_over_files(F.col("_place"), F.col("row_no")))


def file_names(spark, path):
    """The data files under a path, in the order of their names; listed, not read."""
    names = sorted({_plain_name(name) for name in spark.read.format("binaryFile").load(path).inputFiles()})
    if len(names) > 1 << 23:
        raise ValueError(f"{path}: {len(names)} files, row numbers over all files have room for {1 << 23}")
    return names


def _plain_name(name):
    """As in _metadata.file_path, which writes one slash after the scheme of local files."""
    return f"file:/{name[5:].lstrip('/')}" if name.startswith("file:/") else name


def read_users(spark, path, **options):
    return read_landing(spark, path, fixed.USER_HEADERS, **options)


def read_products(spark, path, **options):
    return read_landing(spark, path, fixed.PRODUCT_HEADERS, **options)


def read_orders(spark, path, **options):
    """Order lines are pasted with line breaks, so cells may span lines, unless these are escaped."""
    options.setdefault("multiline", not options.get("escaped_lines"))
    return read_landing(spark, path, fixed.ORDER_HEADERS, fixed.ORDER_REQUIRED, **options)


def read_points(spark, path, per_file=False, multiline=False):
    """Address list without a header: the row number, then the address; options as in ``read_landing``."""
    if not exists(spark, path):
        log.warning("no file %s: 0 rows", path)
        return spark.createDataFrame([], schemas.RAW_POINTS)
    names = schemas.RAW_POINTS.fieldNames()
    if multiline:
        frame = records.read_cells(spark, path, CSV, names)
    else:
        text = ", ".join(f"{n} string" for n in names)
        frame = _with_file(spark.read.schema(text).options(**{**CSV, "header": False}).csv(path))
    return _numbered(spark, frame, path, per_file).select(*names)


def escaped_lines(c):
    """Line breaks as backslash and letter, a backslash doubled: one row stays one line."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescaped_lines(c):
    """Takes back ``escaped_lines``: the parts between doubled backslashes one by one."""
    def plain(part):
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    return F.when(F.contains(c, F.lit("\\")), F.array_join(
        F.transform(F.split(c, "\\\\\\\\"), plain), "\\")).otherwise(c)


def write_landing(rows, path, headers=None, escape_lines=False):
    """Write a landing frame as delimited files, with the file headers."""
    if escape_lines:
        rows = rows.select([
            escaped_lines(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in rows.schema])
    names = {name: header for header, name in (headers or {}).items()}
    renamed = rows.select([F.col(c).alias(names.get(c, c)) for c in rows.columns])
    # Without these two, cells lose their outer blanks and empty text reads back as NULL.
    options = {**CSV, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    renamed.write.mode("overwrite").options(**options).option("header", bool(headers)).csv(path)
