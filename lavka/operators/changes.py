"""Difference of two snapshots of a keyed table."""

from pyspark.sql import functions as F


def change_feed(before, after, key):
    """Rows added, removed or changed, with the names of the changed columns."""
    columns = [c for c in before.columns if c != key]
    old = before.select(key, F.struct(*columns).alias("old"))
    new = after.select(key, F.struct(*columns).alias("new"))
    differing = F.array_compact(
        F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in columns])
    )
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.size(differing) > 0, "changed")
    )
    return (
        old.join(new, key, "full")
        .select(
            key,
            change.alias("change"),
            F.when(change == "changed", F.array_join(differing, ",")).otherwise("").alias("columns"),
        )
        .where(F.col("change").isNotNull())
    )
