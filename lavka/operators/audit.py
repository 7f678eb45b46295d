"""Table constraints as reports: one row per violation."""

from functools import reduce
from operator import add, or_

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavka import fixed, schemas


def _row_rules(name):
    """Rules a row can break by itself: (rule, condition)."""
    rules = [
        (f"{f.name}_too_long", F.char_length(f.name) > fixed.MAX_TEXT)
        for f in schemas.TABLES[name] if isinstance(f.dataType, T.StringType)
    ]
    if name == "products":
        discount = F.col("product_discount")
        rules.append(("price_negative", F.col("product_price") < 0))
        rules.append(("discount_range", (discount < 0) | (discount > fixed.MAX_DISCOUNT)))
    if name == "order_items":
        rules.append(("quantity_not_positive", F.col("product_quantity") <= 0))
    return rules


def _marks(name, own, references, rules, new):
    """What a row says: its own key, the keys it refers to, the rules it breaks.

    A mark is (table, key, role, rule, place). Rows that break a rule are told apart by their place.
    """
    def mark(table, key, role, rule=None, place=None):
        return F.struct(
            F.lit(table).alias("table"), key.cast("long").alias("key"), F.lit(role).alias("role"),
            F.lit(rule).cast("int").alias("rule"), (F.lit(None) if place is None else place).cast("long").alias("place"))

    key = F.col(schemas.PRIMARY_KEYS[name])
    marks = [mark(own, key, 0 if new else 1)]
    if new:
        marks += [F.when(F.col(c).isNotNull(), mark(table, F.col(c), role)) for c, table, role in references]
    marks = F.array(*marks)
    if not new or not rules:
        return marks
    # Most rows break nothing: they make no marks for it.
    kept = ~reduce(or_, [F.coalesce(broken, F.lit(False)) for _, broken in rules])
    return F.when(kept, marks).otherwise(F.concat(marks, F.array(*[
        F.when(broken, mark(own, key, 0, rule, F.col("_place"))) for rule, broken in rules])))


def audit(tables, known=None):
    """All violations in the given tables (name -> DataFrame): table_name, rule, row_key, violations.

    Keys must be there and be unique, foreign keys must be found (checked when both tables are
    given), values must keep the rules of their columns. Every table is read once: a row says
    what it is, what it refers to and what it breaks, and all of that meets by (table, key) in
    one aggregate, combined before its only shuffle; so a hot key is one row per task.

    ``known`` maps names to rows that have been audited before, such as the tables a new run is added to. Of these
    the keys alone are read; only violations of ``tables`` are reported, counting known rows with the key.
    """
    known = known or {}
    order = list(schemas.TABLES)
    given = set(tables) | set(known)
    # Roles 0 and 1 are a table's own keys, new and known, the others the foreign keys that point to it, from 2 on.
    foreign = [(n, c, t) for n, c, t in schemas.FOREIGN_KEYS if n in tables and t in given]
    roles = [2 + sum(t == other for _, _, other in foreign[:i]) for i, (_, _, t) in enumerate(foreign)]
    last = max(roles, default=1)
    rules = [(name, rule, broken) for name in tables for rule, broken in _row_rules(name)]
    marks = None
    for new, frames in ((True, tables), (False, known)):
        for name, table in frames.items():
            references = [(c, order.index(t), role) for role, (n, c, t) in zip(roles, foreign) if n == name]
            own = [(i, broken) for i, (n, _, broken) in enumerate(rules) if n == name]
            found = table.withColumn("_place", F.monotonically_increasing_id()).select(
                F.explode(_marks(name, order.index(name), references, own, new)).alias("_mark")).where(
                "_mark is not null").select("_mark.*")
            marks = found if marks is None else marks.unionByName(found)

    def rows_of(role):
        return F.count(F.when((F.col("role") == role) & F.col("rule").isNull(), 1)).alias(f"_{role}")

    met = marks.groupBy("table", "key", "rule", "place").agg(*[rows_of(r) for r in range(last + 1)])
    rows, key = F.col("_0") + F.col("_1"), F.col("key")
    # Nearly all keys are in order; reports are made for the others only.
    pointed = reduce(add, [F.col(f"_{r}") for r in range(2, last + 1)], F.lit(0))
    met = met.where(F.col("rule").isNotNull() | key.isNull() | (rows > 1) | ((rows == 0) & (pointed > 0)))

    def violation(name, rule, count):
        return F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), count.cast("long").alias("violations"))

    whole = F.col("rule").isNull()
    reports = [F.when(F.col("rule") == i, violation(name, rule, F.lit(1))) for i, (name, rule, _) in enumerate(rules)]
    reports += [
        F.when(whole & (F.col("table") == order.index(name)) & (F.col("_0") > 0) & (key.isNull() | (rows > 1)),
               violation(name, f"{schemas.PRIMARY_KEYS[name]}_not_unique", rows)) for name in tables]
    reports += [
        F.when(whole & (F.col("table") == order.index(t)) & (F.col(f"_{role}") > 0) & (rows == 0),
               violation(name, f"{column}_missing", F.col(f"_{role}")))
        for role, (name, column, t) in zip(roles, foreign)]
    return met.select(
        F.explode(F.array_compact(F.array(*reports))).alias("_report"), key.cast("string").alias("row_key")
    ).select("_report.table_name", "_report.rule", "row_key", "_report.violations")
