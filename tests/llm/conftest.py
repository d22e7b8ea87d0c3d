import pytest

ODD = "_hot string, _rid string, fp string, name string, value string, size string, level string, score string, n string, target string, words string, kept string, h string, bucket string, pos string, first string, predicted string"


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls in each column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"word{i % 997} and the" for i in range(30_000))
    rows = [
        (1, "Hello there, the quick brown fox.", "en", "a"),
        (1, "Hello there, the quick brown fox.", "en", "a"),
        (1, "Another text under the same id", "en", "b"),
        (2, "HELLO there, the quick brown fox.", None, None),
        (3, None, "en", "a"),
        (4, "", "de", "b"),
        (5, " \t\n\x0b ", "de", None),
        (None, "text without an id", "fr", "c"),
        (6, long, "en", "a"),
        (7, long, "en", "a"),
        (8, "x" * 200_000, "en", "a"),
        (9, "日本語のテキスト 漢字 <|endoftext|> é ü", None, "c"),
        (10, "ÀÉ ß İ ǅ   line", "fr", "c"),
    ]
    names = [c.split()[0] for c in ODD.split(", ")]
    return spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], f"doc_id bigint, text string, lang string, source string, {ODD}")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
