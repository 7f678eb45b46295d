from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from lavka.functions import text as X


def parse(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    out = rows.select("n", X.parse_order_text(F.col("line")).alias("items")).orderBy("n").collect()
    return [[(i.art, i.qty) for i in r["items"]] for r in out]


def paired(tokens):
    """Closed form of the pairing rule, on positions from 1."""
    digits = [t.replace(" ", "").isascii() and t.replace(" ", "").isdigit() for t in tokens]
    out = []
    for i, token in enumerate(tokens, 1):
        last = max((j for j in range(1, i) if not digits[j - 1]), default=0)
        if digits[i - 1] and (i - last) % 2 == (1 if last else 0):
            out[-1] = (out[-1][0], int(token) if " " not in token and int(token) < 2**31 else None)
        else:
            out.append((token, 1))
    return out


def test_order_line_cases(spark):
    cases = {
        "A, 2, B\n5;C,,7,8": [("A", 2), ("B", 5), ("C", 7), ("8", 1)],
        "5,3,4": [("5", 3), ("4", 1)],
        "A": [("A", 1)],
        "A,1,2,3,4,B,9": [("A", 1), ("2", 3), ("4", 1), ("B", 9)],
        "1,2,3,4,5": [("1", 2), ("3", 4), ("5", 1)],
        "": [],
        " ;,\n ": [],
        "A,0": [("A", 0)],
        "A,1 000": [("A", None)],
        "A,99999999999": [("A", None)],
        "A\t5": [("A\t5", 1)],
        "A,\xa0 5 \r\n": [("A", 5)],
        "A,5x,5": [("A", 1), ("5x", 5)],
        "A,A,2": [("A", 1), ("A", 2)],
        "A,007": [("A", 7)],
    }
    assert parse(spark, list(cases)) == list(cases.values())
    assert parse(spark, [None]) == [[]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["A", "b 1", "7", "12", "1 000", "0", "x9"]), max_size=12),
                min_size=20, max_size=20))
def test_pairing_matches_closed_form(spark, lists):
    assert parse(spark, [";".join(tokens) for tokens in lists]) == [paired(t) for t in lists]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(
    st.from_regex(r"[A-Za-zА-я][A-Za-z0-9А-я]{0,5}", fullmatch=True), st.integers(1, 10**6)),
    max_size=8), min_size=10, max_size=10))
def test_parse_reads_what_format_writes(spark, orders):
    kind = "n int, items array<struct<article:string,quantity:int>>"
    rows = spark.createDataFrame(list(enumerate(orders)), kind)
    lines = [r.line for r in rows.orderBy("n").select(X.format_order_items(F.col("items")).alias("line")).collect()]
    assert parse(spark, lines) == orders


def test_format_drops_blank_articles_and_reads_zero_as_one(spark):
    row = spark.createDataFrame(
        [([(" A ", 0), ("B", None), (" ", 4), (None, 4), ("C", 2)],)],
        "items array<struct<article:string,quantity:int>>",
    )
    assert row.select(X.format_order_items(F.col("items"))).first()[0] == "A, B, C, 2"


def test_long_line_is_read_whole(spark):
    line = ",".join(f"P{i},{i % 9 + 2}" for i in range(50_000))
    items = parse(spark, [line])[0]
    assert len(items) == 50_000 and items[-1] == ("P49999", 49_999 % 9 + 2)


@pytest.mark.parametrize("text, literal, pattern", [
    (" a ", False, "%a%"),
    ("50%_", False, "%50%_%"),
    ("50%_\\", True, "%50\\%\\_\\\\%"),
    ("a\\b", False, "%ab%"),
    ("a\\\\b", False, "%a\\\\b%"),
    ("a\\%", False, "%a\\%%"),
    ("a\\", False, "%a\\%"),
])
def test_search_pattern(text, literal, pattern):
    assert X.search_pattern(text, literal) == pattern


def test_blank_cells(spark):
    row = spark.createDataFrame([(" \xa0\t", "NaN", None, " x ")], "a string, b string, c string, d string")
    out = row.select(
        X.blank_to_null(F.col("a")), X.first_non_blank(*[F.col(c) for c in "abcd"]),
        X.default_if_blank(F.col("c"), "шт."), X.display_name(F.col("c"), F.col("d")),
        X.display_name(F.col("a")),
    ).first()
    assert tuple(out) == (None, "x", "шт.", "x", "—")
