"""Delimited files whose cells span lines, read in parallel.

Whether a line begins a record depends on all quotes before it in the file, so such files are
usually read one file a task. Here a file is split like any text. What a line or a
split does to the state "inside a quoted cell" is a function of that state, and functions
compose:

1. Every split is summed up as the function of its lines, one small row a split.
2. A prefix over the splits of a file gives the state in which each begins.
3. Each split's lines are numbered from there: a line that begins outside a quoted cell begins a record.
4. The lines of a record are joined. What a split has of a record that began in an earlier
   one is joined to that record; only splits that begin inside a cell take part.

A quote opens a cell at its beginning only, as CSV readers see it, a doubled one inside a quoted
cell is one, and any other is an ordinary character. Lines end in a line feed, with or
without a carriage return. One record is held in memory, never a split or a file.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.operators.sizing import lookup_side
from lavka.session import cut

# States at a quote: inside a quoted cell, right after its closing quote or the beginning of a line, in a plain cell.
_INSIDE, _FRESH, _PLAIN = 1, 2, 0


def ends_inside(line, inside, sep=";", quote='"'):
    """Does a line end inside a quoted cell, if it begins inside one (or not)?"""
    parts = F.split(line, quote, -1)

    def at_quote(state, part):
        opens = part.endswith(sep) | ((state == _FRESH) & (part == ""))
        return F.when(state == _INSIDE, _FRESH).when(opens, _INSIDE).otherwise(_PLAIN)

    last = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(_INSIDE if inside else _FRESH), at_quote)
    return F.when(F.contains(line, F.lit(quote)), last == _INSIDE).otherwise(F.lit(inside))


def split_lines(spark, path):
    """The lines of all files: file, split (its first byte), place (grows within a split), line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def state_before(rows, group, order, outside, inside, start, name):
    """Adds ``name``: the state that the functions of the earlier rows of the group make of ``start``.

    ``outside`` and ``inside`` are the columns that say what state a row makes of each. A
    function is constant, or keeps, or swaps the state: so the state is that of the last constant
    row, or the start, swapped as often as rows after it swap.
    """
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    constant, swaps = F.col(outside) == F.col(inside), F.col(outside) & ~F.col(inside)
    rows = rows.withColumn("_swaps", F.coalesce(F.sum(swaps.cast("int")).over(earlier), F.lit(0)))
    known = F.last(F.when(constant, F.struct(F.col(inside).alias("state"), "_swaps")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("_known", known)
    since = F.col("_swaps") - F.coalesce(F.col("_known._swaps"), F.lit(0))
    return rows.withColumn(name, F.coalesce("_known.state", start) != (since % 2 == 1)).drop("_swaps", "_known")


def split_states(lines):
    """One row a split: file, split, lines, begins_inside."""
    function = F.struct(ends_inside(F.col("line"), False).alias("o"), ends_inside(F.col("line"), True).alias("i"))
    changing = F.struct("place", function.alias("f"))
    per_split = lines.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.contains("line", F.lit('"')), changing))).alias("_changing"))
    keeps = F.struct(F.lit(False).alias("o"), F.lit(True).alias("i"))

    def composed(f, row):
        return F.struct(F.when(f["o"], row["f"]["i"]).otherwise(row["f"]["o"]).alias("o"),
                        F.when(f["i"], row["f"]["i"]).otherwise(row["f"]["o"]).alias("i"))

    per_split = per_split.select("file", "split", "lines", F.aggregate("_changing", keeps, composed).alias("_f")).select(
        "file", "split", "lines", "_f.o", "_f.i")
    return state_before(per_split, ["file"], "split", "o", "i", F.lit(False), "begins_inside").drop("o", "i")


def _numbered(lines, splits):
    """Lines with ``record``: the place of the line that begins their record, NULL where that is in an earlier split."""
    states = lookup_side(splits.select(F.col("file").alias("_f"), F.col("split").alias("_s"), "begins_inside"), "_f", "_s")
    rows = lines.join(states, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s"))).drop("_f", "_s")
    rows = rows.withColumns({"_o": ends_inside(F.col("line"), False), "_i": ends_inside(F.col("line"), True)})
    rows = state_before(rows, ["file", "split"], "place", "_o", "_i", F.col("begins_inside"), "_inside")
    so_far = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("record", F.last(F.when(~F.col("_inside"), F.col("place")), ignorenulls=True).over(so_far))


def _joined(order, text):
    """The aggregate that joins texts in order by line feeds."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), "\n")


def read_records(spark, path):
    """The records of all files under ``path``: file, split, record (grows within a split), text.

    A record's text has its line breaks, but not the one at its end.
    """
    lines = split_lines(spark, path)
    splits = cut(split_states(lines))
    records = _numbered(lines, splits).where("record is not null").groupBy("file", "split", "record").agg(
        _joined("place", "line").alias("text"))
    inside = splits.where("begins_inside")
    if not inside.isEmpty():
        records = _completed(records, lines, splits, inside)
    return records.withColumn("text", F.regexp_replace("text", "\r$", ""))


def _completed(records, lines, splits, inside):
    """``records`` with what later splits have of the last record of a split."""
    keys = lookup_side(inside.select(F.col("file").alias("_kf"), F.col("split").alias("_ks")), "_kf", "_ks")
    here = lines.join(keys, (F.col("file") == F.col("_kf")) & (F.col("split") == F.col("_ks"))).drop("_kf", "_ks")
    heads = cut(_numbered(here, splits).where("record is null").groupBy("file", "split").agg(
        _joined("place", "line").alias("head"), F.count(F.lit(1)).alias("_lines")))
    # The record goes on from the last split before in which one begins.
    known = splits.join(heads.select("file", "split", "_lines"), ["file", "split"], "left")
    begins = F.when(F.coalesce("_lines", F.lit(0)) < F.col("lines"), F.col("split"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    target = known.select("file", "split", F.last(begins, ignorenulls=True).over(earlier).alias("_target"))
    rest = heads.join(target, ["file", "split"]).groupBy(F.col("file").alias("_rf"), F.col("_target").alias("_rs")).agg(
        _joined("split", "head").alias("_rest"))
    last = Window.partitionBy("file", "split")
    records = records.withColumn("_last", F.max("record").over(last) == F.col("record"))
    records = records.join(
        lookup_side(rest, "_rf", "_rs"), F.col("_last") & (F.col("file") == F.col("_rf")) & (F.col("split") == F.col("_rs")), "left")
    return records.withColumn("text", F.concat_ws("\n", "text", "_rest")).drop("_last", "_rf", "_rs", "_rest")


def read_cells(spark, path, options, names=None):
    """The records of all files as columns of text, and ``_file``; each file begins with the same header.

    ``names`` names the columns of files without a header. Empty records are left out, as CSV readers do.
    """
    records = read_records(spark, path)
    if names is None:
        # The header line only.
        names = spark.read.options(**options).option("multiLine", False).csv(path).columns
        first = records.groupBy("file").agg(F.min(F.struct("split", "record")).alias("_first")).withColumnRenamed("file", "_hf")
        records = records.join(
            lookup_side(first, "_hf"), F.col("file") == F.col("_hf")).where(F.struct("split", "record") != F.col("_first"))
    schema = ", ".join(f"`{n}` string" for n in names)
    kept = {k: str(v) for k, v in options.items() if k in ("sep", "quote", "escape", "encoding")}
    cells = F.from_csv("text", F.lit(schema), {**kept, "multiLine": "true"})
    return records.where("text <> ''").select(F.col("file").alias("_file"), cells.alias("_cells")).select(
        "_file", *[F.col(f"_cells.`{n}`") for n in names])
