import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "The common line that many documents share."
BODY = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"long{i % 977} word{i % 331}" for i in range(9000)) + "\n" + LINE

# Nulls in each column, empty and white texts, repeated rows and ids, one very long text, odd characters.
EDGE = [
    (1, f"{LINE}\n{BODY}", "en", "a", 1),
    (2, f"  {LINE.upper()}\t\n{BODY}", "en", None, None),
    (3, None, None, "b", 0),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b\x0c\r ", None, None, 5),
    (6, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", "a", len(LONG)),
    (7, BODY, "fr", "a", 3),
    (7, f"{BODY} {LINE}", "fr", "a", 3),
    (None, f"{LINE}\n{BODY}", "de", "a", 3),
    (None, None, None, None, None),
    (8, "один два три четыре 日本語のテキスト ÀÉÎ \x00 😀", None, "c", 9),
    (9, "a b", "en", "c", 3),
    (10, "A  B", "en", "c", 4),
    (11, "12 + 34 = 46 !!!", None, "c", 4),
    (12, f"{LINE}\n{LINE}\nshort\nshort", "en", "c", 4),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names clash with results of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    clash = ("n_lines", "n_tokens", "ids", "score", "spans", "families", "n_bytes", "d1", "text_1", "lang_pred")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, root):
    return spark.read.parquet(f"{root}/documents.parquet")
