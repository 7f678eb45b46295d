import duckdb
import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tables():
    """DuckDB over the smallest test tables."""
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "labels"):
        connection.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and long texts, copies, a repeated row, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 23, "x"), (2, "the CAT sat on the mat.", "en", "a", 23, "y"),
        (3, None, "en", None, None, None), (4, "", None, "b", 0, "x"), (5, " \t\n", "fr", "b", 3, "x"),
        (6, long, "en", "a", len(long), "x"), (7, long, None, None, len(long), "x"),
        (8, "ÉTÉ à la plage", "fr", "b", 14, "x"), (9, "été à la plage", "fr", "b", 14, "x"),
        (10, "one", "de", "c", 3, "x"), (10, "one", "de", "c", 3, "x"), (10, "other", "de", "c", 5, "x"),
        (None, "one", None, None, None, None), (None, None, None, None, None, None),
        (11, "12 34 !?", "en", "c", 8, "x"), (12, "日本語のテキスト", None, "c", 8, "x"),
    ]
    names = ROWS + ", " + ", ".join(f"{c} string" for c in ("size",))
    frame = spark.createDataFrame(rows, names)
    # Names that the operators use for columns of their own results.
    for c in ("kept", "fingerprint", "component_id", "taken", "start", "target", "n_tokens", "lang_pred", "score"):
        frame = frame.selectExpr("*", f"size as {c}")
    return frame


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("1 = 0")
