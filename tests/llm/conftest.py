import pytest

#: Rows that every operator must survive: nulls, empty and long texts, ties and repeats,
#: and columns whose names clash with those that operators make.
EDGE = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, copies int, kept string, n_words int, rid string, shard string"


@pytest.fixture(scope="session")
def edge(spark):
    long = " ".join(f"word{i} piece." for i in range(30_000))
    rows = [
        (1, "one two three four five six.", "en", "a"),
        (1, "one two three four five six.", "en", "a"),
        (2, None, "en", None),
        (3, "", None, "a"),
        (None, "no id here", "en", "b"),
        (4, long, "en", "a"),
        (5, " \n\t ", "fr", None),
        (6, "One TWO three four five six.", "fr", "a"),
        (7, "ünïcödé 漢字 😀 mot.", None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 9, "x", 2, "y", 3, "z", "w") for r in rows], EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
