import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use for themselves, held by the caller's table as well.
CLASHING = ("fp", "row", "chunk", "part", "size", "h", "words", "n_words", "kept", "_llm_row")


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text[, source]) rows, with clashing extra columns."""

    def make(rows, clashing=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            for name in CLASHING:
                df = df.withColumn(name, df["n_chars"])
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    return [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \n\t ", None),
        (None, "one two three four five", "a"),
        (None, None, None),
        (4, "One  TWO three\x0bfour\x85five six\n seven", "b"),
        (5, long_text, "b"),
        (6, long_text, "a"),
        (7, "same words here " * 30, "b"),
        (7, "same words here " * 30, "b"),
        (8, "é à ñ ü ß 字 😀 <|endoftext|> it's 12,5!\n\n\nend ", "c"),
        (-9, "x", "c"),
    ]


@pytest.fixture(scope="session")
def sf_docs():
    """Rows of the given small documents table."""

    def rows(spark, sf_dir="/root/testdata/sf0.001"):
        return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]

    return rows
