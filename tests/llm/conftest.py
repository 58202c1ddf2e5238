import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"t{i % 997}x{i}" for i in range(30000))
ROWS = [
    (1, "one two three four five", "en", "a", 23),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "one two three four five", "en", "a", 23),
    (4, "one two three four five", "en", "a", 23),
    (5, "intro " + PASSAGE + " end", "en", "b", 400),
    (6, "Other start, " + PASSAGE + " and another end", "en", "b", 400),
    (None, "lost " + PASSAGE, "en", "b", 400),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG + " tail", "en", "b", len(LONG) + 5),
    (9, "\n\n \t ", "en", None, 6),
    (10, "a b\nc d\ne f\na b\nc d\ne f\ng", "en", "c", 26),
    (11, "x\na b\nc d\ne f", "en", "c", 13),
    (12, "same " * 40, "en", "c", 200),
    (13, "Ünïcödé wörds ñandú 日本語 テキスト \U0001f600 fin", "en", "c", 40),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
