"""Substring search by an index of trigrams, for catalogues too large to scan for every search.

The index has one row per product and distinct run of three lower-cased characters of a searched column, stored in
ranges of the runs, so that a search reads the few row groups of its own. Products that have all runs of the
pattern's plain stretches are candidates; they are verified by the pattern itself. A pattern with no three
plain characters in a row has no runs and scans.
"""

from pyspark.sql import functions as F

from lavka.functions.text import search_pattern
from lavka.operators.catalog import SEARCHED, search
from lavka.operators.sizing import broadcast_if_small
from lavka.session import cut

SIZE = 3


def runs_of(text):
    """Distinct runs of SIZE characters of a lower-cased text; none for a shorter or missing one."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - (SIZE - 1)), lambda i: F.substr(low, i, F.lit(SIZE)))
    return F.when(F.length(low) >= SIZE, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def trigram_index(catalog, key="product_id"):
    """Rows (run, key) of the searched columns, stored in ranges of the runs."""
    runs = F.array_distinct(F.flatten(F.array(*[runs_of(F.col(c)) for c in SEARCHED])))
    rows = catalog.select(F.explode(runs).alias("run"), key)
    tasks = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(tasks, "run", key).sortWithinPartitions("run", key))


def pattern_runs(spark, pattern):
    """The runs that whatever matches a LIKE pattern has, in any case."""
    # Lower-cased by Spark and as a whole, as ILIKE does it.
    low = spark.range(1).select(F.lower(F.lit(pattern))).first()[0]
    stretches, at = [""], 0
    while at < len(low):
        if low[at] in "%_":
            stretches.append("")
        else:
            at += low[at] == "\\"
            stretches[-1] += low[at]
        at += 1
    return sorted({s[i:i + SIZE] for s in stretches for i in range(len(s) - SIZE + 1)})


def candidates(index, runs, key="product_id"):
    """Keys of the rows that have all runs."""
    return index.where(F.col("run").isin(runs)).groupBy(key).agg(F.count(F.lit(1)).alias("_runs")).where(
        F.col("_runs") == len(runs)).select(key)


def indexed_search(catalog, index, text, literal=False, key="product_id"):
    """``catalog.search`` by the index of the same catalogue."""
    runs = pattern_runs(catalog.sparkSession, search_pattern(text, literal)) if text.strip() else []
    if runs:
        catalog = catalog.join(broadcast_if_small(candidates(index, runs, key)), key, "left_semi")
    return search(catalog, text, literal)
