import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that have the names of intermediate and result columns.
CLASHES = "size hash rank total curve shard leaks kept failures toxic_score lang_pred target times word n key bands".split()


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and the dog sat on the log by the old red barn near town", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "a row without an id", "en", None, 3),
        (4, long, "en", "b", 9),
        (5, long, "en", "b", 9),
        (6, "   \n\t ", None, "b", 4),
        (7, "one", "de", "c", 3),
        (7, "one", "de", "c", 3),
        (8, "x" * 200_000, "de", "c", 3),
        (9, "12345 !!! ###", "de", "", 3),
        (10, "日本語 テキスト ÄÖÜ naïve", "de", "", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
