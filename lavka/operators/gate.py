"""Row numbers must be there and be unique: a row without one, or with another's, is refused.

Numbers order the rows and tie rejects and items to them. Without this gate a row could
vanish, or a good one be refused in place of a bad one.
"""

from pyspark.sql import functions as F

from lavka.operators.sizing import broadcast_if_small
from lavka.session import cut

NO_NUMBER, REPEATED = "no_row_no", "repeated_row_no"


def numbered_wrongly(rows, row_no="row_no"):
    """``rows`` with ``_number``: the fault of the row number, or NULL.

    One count per number over that column, combined before the shuffle; the few
    numbers that repeat are joined back, most often none.
    """
    number = F.col(row_no)
    repeated = cut(
        rows.where(number.isNotNull()).groupBy(number.alias("_repeated")).count()
        .where("count > 1").select("_repeated")
    )
    missing = F.when(number.isNull(), F.lit(NO_NUMBER))
    if repeated.isEmpty():
        return rows.withColumn("_number", missing)
    return rows.join(broadcast_if_small(repeated), number == F.col("_repeated"), "left").withColumn(
        "_number", missing.when(F.col("_repeated").isNotNull(), F.lit(REPEATED))
    ).drop("_repeated")


def number_missing(rows, row_no="row_no"):
    """``rows`` with ``_number`` where only a missing number is a fault; needs no count, so it runs in a stream."""
    return rows.withColumn("_number", F.when(F.col(row_no).isNull(), F.lit(NO_NUMBER)))
