import random

import pytest

from lavka import fixed, schemas
from lavka.operators import cleaning
from lavka.operators.resolve import address_list
from lavka.plans.importing import ImportRefused, run_import
from lavka.sources import files, records, tables

CELLS = ["a", "", '"', '""', "x;y", "line\nbreak", "\n", '"\n"', '; "', '12" pipe', 'a""b', ' "q" ', "é日", "\n\n\n", "end\n",
         "k" * 30, 'a\n"b";c\n', "e\rf", "\\", '\\"', "c\r\nd"]


def encoded(cell, quoted):
    plain = not quoted and not any(c in cell for c in ";\n\r") and not cell.startswith('"')
    return cell if plain else '"' + cell.replace('"', '""') + '"'


def written(folder, seed, n=250, end="\n", cells=CELLS):
    """Three files with awkward cells, some over hundreds of lines; their rows."""
    rng, rows = random.Random(seed), []
    for f in range(3):
        with open(f"{folder}/{f}.csv", "w", newline="", encoding="utf-8") as out:
            out.write("n;A;B" + end)
            for i in range(n):
                row = [str(f * n + i), *("".join(rng.choice(cells) for _ in range(rng.choice([1, 1, 2, 5]))) for _ in range(2))]
                if rng.random() < 0.02:
                    row[2] = "long\n" * 200
                rows.append(row)
                out.write(";".join(encoded(c, rng.random() < 0.3) for c in row) + end)
    return rows


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {name: spark.conf.get(name) for name in names}

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield use
    for name, value in old.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", ["700", "3000"])
def test_equal_to_reading_whole_files(spark, folder, small_splits, size):
    """Splits shorter than a cell, and splits of some rows; quotes across their edges."""
    written(folder, size)
    whole = spark.read.options(**files.CSV).option("multiLine", True).schema("n string, A string, B string").csv(folder)
    expected = sorted(map(tuple, whole.collect()), key=str)
    small_splits(size)
    assert records.split_states(records.split_lines(spark, folder)).count() > 6
    found = records.read_cells(spark, folder, files.CSV)
    assert found.columns == ["_file", "n", "A", "B"]
    assert sorted(map(tuple, found.drop("_file").collect()), key=str) == expected


def test_carriage_returns_blank_lines_and_empty_files(spark, folder, small_splits):
    rows = written(folder, 3, 60, "\r\n", ["a", "x;y", "li\nne", 'q"q', "", "b\n\n"])
    open(f"{folder}/empty.csv", "w").close()
    with open(f"{folder}/header.csv", "w") as out:
        out.write("n;A;B\n\n\n")
    small_splits("500")
    found = records.read_cells(spark, folder, files.CSV).drop("_file").collect()
    assert sorted([c or "" for c in r] for r in found) == sorted(rows)


def test_ends_inside(spark):
    lines = ['a;b', '"a', '"a"', '"a""', '"a"";"', 'a"b', '"', '""', '"""', 'x;"', '";"', 'x"";"', ' "a', '"a"b"c']
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    found = frame.select(records.ends_inside(frame.line, False), records.ends_inside(frame.line, True)).collect()
    assert [r[0] for r in found] == [False, True, False, True, False, False, True, False, True, True, False, True, False, False]
    assert [r[1] for r in found][:4] == [True, False, False, False]


def sheet(spark, schema, *rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_bad_row_numbers_and_line_breaks_in_every_sheet(spark, folder):
    """Accepted and refused rows add up to the input for all four sheets; no cell stops the read."""
    text = {n: f"{folder}/{n}" for n in ("users", "products", "orders", "points")}
    with open(text["users"], "w") as out:
        out.write("row_no;" + ";".join(fixed.USER_HEADERS) + "\n")
        login = list(fixed.USER_HEADERS.values()).index("login")
        for number, name in (("1", "ann"), ("x2", "bob"), ("3", '"c\nd"'), ("", "eve"), ("3", "fay")):
            cells = [""] * len(fixed.USER_HEADERS)
            cells[login] = name
            out.write(";".join([number, *cells]) + "\n")
    for name, schema, headers, rows in (
        ("products", schemas.RAW_PRODUCTS, fixed.PRODUCT_HEADERS, [
            {"row_no": 1, "product_name": "Boots", "article": "A1", "description": 'warm\n"dry"; light\n'},
            {"row_no": 1, "product_name": "Copy", "article": "A2"}, {"row_no": 2, "product_name": "Hat", "article": "H\n1"}]),
        ("orders", schemas.RAW_ORDERS, fixed.ORDER_HEADERS, [
            {"row_no": 1, "order_date": "2025-03-01", "order_line": "A1, 2\nA1", "client": "Ann\nLee", "pickup": "2"}]),
        ("points", schemas.RAW_POINTS, None, [
            {"row_no": 1, "address": "first"}, {"row_no": 2, "address": "second\nline"}, {"row_no": 4, "address": "fourth"},
            {"row_no": 4, "address": "again"}, {"row_no": None, "address": "lost number"}]),
    ):
        files.write_landing(sheet(spark, schema, *rows), text[name], headers)
    assert files.read_users(spark, text["users"], multiline=True).where("login = 'c\nd'").first().row_no == 3
    assert files.read_users(spark, text["users"]).count() == 6  # a broken cell is two rows, none of them stops the read
    report = run_import(spark, text, f"{folder}/shop", "r", "salt", strict=False, multiline=True)
    rejects = sorted(map(str, (tuple(r[:3]) for r in report.rejects.collect())))
    assert rejects == sorted(map(str, [
        ("users", None, "no_row_no"), ("users", None, "no_row_no"), ("users", 3, "repeated_row_no"), ("users", 3, "repeated_row_no"),
        ("products", 1, "repeated_row_no"), ("products", 1, "repeated_row_no"),
        ("pickup_points", 4, "repeated_row_no"), ("pickup_points", 4, "repeated_row_no"), ("pickup_points", None, "no_row_no"),
        ("order_items", 1, "unknown_article"), ("order_items", 1, "unknown_article")]))
    stored = {n: tables.read_table(spark, f"{folder}/shop", n).collect() for n in ("users", "products", "orders", "pickup_points")}
    assert [r.user_login for r in stored["users"]] == ["ann"] and [r.product_art for r in stored["products"]] == ["H\n1"]
    assert [r.user_name for r in stored["orders"]] == ["Ann\nLee"] and [r.pp_name for r in stored["pickup_points"]] == ["second\nline"]
    with pytest.raises(ImportRefused):
        run_import(spark, {**text, "users": f"{folder}/none", "products": f"{folder}/none", "orders": f"{folder}/none"},
                   f"{folder}/strict", "r", "salt", multiline=True)


def test_address_list_refuses_what_has_no_place(spark):
    lines = [(1, "first"), (2, "second"), (2, "second again"), (3, "third"), (None, "lost number"), (4, " ")]
    listed = address_list(spark.createDataFrame(lines, schemas.RAW_POINTS))
    assert sorted(map(tuple, listed.addresses.collect())) == [(1, "first"), (2, "third")]
    assert sorted((str(r.row_no), r.reason, r.severity) for r in listed.rejects.collect()) == [
        ("2", "repeated_row_no", cleaning.ABORT), ("2", "repeated_row_no", cleaning.ABORT), ("None", "no_row_no", cleaning.ABORT)]


def test_files_in_the_order_of_their_names(spark, folder):
    """Names with blanks and other marks; only the listing is read."""
    for name in ("b b", "a%20c", "ü;", "a"):
        sheet(spark, schemas.RAW_USERS, {"row_no": 1, "login": name}).toPandas().rename(
            columns={v: k for k, v in fixed.USER_HEADERS.items()}).to_csv(f"{folder}/{name}.csv", sep=";", index=False)
    for multiline in (False, True):
        rows = files.read_users(spark, folder, per_file=True, multiline=multiline).collect()
        assert sorted(r.row_no - 1 >> files.FILE_BITS for r in rows) == [0, 1, 2, 3]
        assert [r.login for r in sorted(rows, key=lambda r: r.row_no)] == ["a%20c", "a", "b b", "ü;"]
