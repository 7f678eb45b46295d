from decimal import Decimal
import datetime

from pyspark.sql import functions as F

from lavka.functions import numbers as N


def read(spark, function, *cells):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "n int, c string")
    return [r[0] for r in rows.orderBy("n").select(function(F.col("c"))).collect()]


def test_whole_cuts_and_never_raises(spark):
    cells = ("12.9", "-3.7", " 7 ", "1e3", "901.0", "", None, "x", "12d", "3000000000", "inf", "NaN", "1,5", "+4", ".5")
    assert read(spark, N.whole, *cells) == [12, -3, 7, 1000, 901, None, None, None, None, None, None, None, None, 4, 0]


def test_money_rounds_half_up(spark):
    assert read(spark, N.money, "12.345", "1e2", "99999999.99", "100000000", "free", None) == [
        Decimal("12.35"), Decimal("100.00"), Decimal("99999999.99"), None, None, None]


def test_dates(spark):
    day = datetime.date
    cells = ("27.02.2025", "1.2.2025", "30.02.2025", "2025-02-27", "2025-02-27 00:00:00", "soon", "", None)
    assert read(spark, N.parse_date, *cells) == [
        day(2025, 2, 27), day(2025, 2, 1), None, day(2025, 2, 27), day(2025, 2, 27), None, None, None]


def test_typed_code_is_strict(spark):
    assert read(spark, N.typed_code, " 901 ", "901.0", "call", "-5", "99999999999", None) == [
        901, None, None, -5, None, None]


def test_iso_date(spark):
    assert read(spark, lambda c: N.iso_date(N.parse_date(c)), "1.2.2025", None) == ["2025-02-01", None]
