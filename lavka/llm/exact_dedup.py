"""Exact duplicates by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition is a run: its rows reduced to a digest and combined per digest.
The runs are merged in rounds: in each round 2**bits neighbouring runs (all whose
numbers agree but for their lowest bits) are sorted together by digest, best row first,
and neighbours of one digest merged into one row by a window, keeping the best row and
the number of rows. With 2**bits partitions or fewer there is one round. A round's groups
are (merged run, digest), so they are spread over all tasks by digest, a group of
copies has at most 2**bits rows per round however large it is, and each round's
shuffle files are a point from which a lost task can be repeated.

Before rows are merged they are verified: SHA-256, the length in bytes and an
independent 64-bit hash of the text must all agree.

Null text counts as empty. Rows with a null doc_id take part; any known id beats
a null one. Of rows that tie in text and doc_id one stays. An empty table gives an
empty table. Columns other than the id and the text are not looked at.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.llm.tables import free_names, lower_ascii, one_of_alike
from lavka.operators.sizing import lookup_side
from lavka.session import cut

KEY = ["text_sha256", "_bytes", "_check"]


def digest_rows(docs, id_col="doc_id", text_col="text"):
    """One narrow row per document: its id, its place, its run and the digest of its lower-cased text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), lower_ascii(text).alias("_text"),
        F.spark_partition_id().alias("_run"), F.monotonically_increasing_id().alias("_row"),
    ).select(
        "doc_id", "_run", "_row", F.sha2("_text", 256).alias("text_sha256"),
        F.octet_length("_text").alias("_bytes"), F.xxhash64("_text").alias("_check"),
    )


def merge_runs(rows, keep="max", bits=4):
    """One row per text: the best (doc_id, place) and the number of rows, merged in rounds."""
    best, sign = ("_best", 1) if keep == "max" else ("_best", -1)
    runs = rows.select(
        "_run", *KEY, F.lit(1).cast("long").alias("_rows"),
        F.struct((F.col("doc_id") * sign).alias("id"), F.col("_row").alias("row")).alias(best),
    ).groupBy("_run", *KEY).agg(F.sum("_rows").alias("_rows"), F.max(best).alias(best))
    neighbours = Window.partitionBy("_run", *KEY).orderBy(F.col(best).desc())
    all_of_them = neighbours.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = rows.agg(F.max("_run")).first()[0] or 0
    while True:
        runs = runs.withColumn("_run", F.shiftright("_run", bits)).withColumns({
            "_rows": F.sum("_rows").over(all_of_them), "_place": F.row_number().over(neighbours),
        }).where("_place = 1").drop("_place")
        last >>= bits
        if last == 0:
            return runs.select(
                *KEY, F.col("_rows").alias("group_size"), (F.col(f"{best}.id") * sign).alias("keep_id"),
                F.col(f"{best}.row").alias("_keep_row"))


def _groups(docs, keep, id_col, text_col):
    rows = cut(digest_rows(docs, id_col, text_col))
    winners = lookup_side(merge_runs(rows, keep), *KEY)
    return rows.join(winners, KEY).withColumn("kept", F.col("_row") == F.col("_keep_row"))


def exact_groups(docs, keep="max", id_col="doc_id", text_col="text"):
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the largest or the smallest doc_id of equal texts stays.
    Texts are equal when identical after lower-casing A-Z.
    """
    return _groups(docs, keep, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs, keep="max", id_col="doc_id", text_col="text"):
    """``docs`` without copies, all columns as they are: the best row of each text stays.

    Of rows that repeat both id and text the one stays whose columns hash to the smallest
    number; only such rows are shuffled a second time. Columns may have any names.
    """
    stay_id, stay_check, same = free_names(docs, "_stay_id", "_stay_check", "_same")
    stays = cut(
        _groups(docs, keep, id_col, text_col)
        .groupBy(F.col("doc_id").alias(stay_id), F.col("_check").alias(stay_check))
        .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias(same))
        .where("_kept").drop("_kept")
    )
    check = F.xxhash64(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    same_row = F.col(id_col).eqNullSafe(F.col(stay_id)) & (check == F.col(stay_check))
    single = docs.join(lookup_side(stays.where(f"{same} = 1"), stay_id, stay_check), same_row, "left_semi")
    if stays.where(f"{same} > 1").isEmpty():
        return single
    repeated = docs.join(stays.where(f"{same} > 1"), same_row, "left_semi")
    alike = one_of_alike(repeated.withColumn(stay_check, check), [id_col, stay_check])
    return single.unionByName(alike.drop(stay_check))
