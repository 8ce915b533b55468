import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, value int, share double, count long, item_id long, copy string, n_lines int, words array<string>"
PROSE = "The harbour was quiet that morning and nobody came to the market until the bells had rung twice. Then the rain began."


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows and columns whose names the operators use themselves."""
    extra = ("k", 1, 0.5, 3, 9, "c", 4, ["w"])
    long_ = " ".join(f"word{i % 9771} then{i % 31}" for i in range(60_000)) + "."
    texts = [
        (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", None), (3, None, None, "a"), (4, "", "en", "b"), (5, " \n\n\t ", "en", "b"), (None, PROSE, "en", "a"), (6, long_, "en", "c"),
        (7, "x" * 300_000, None, "c"), (8, "...!!! ???", "en", "b"), (9, "One.", "en", "b"), (9, "One.", "en", "b"), (10, "日本語のテキストです。これは文です。", "ja", "b"), (None, None, None, None),
    ]
    rows = [(i, t, lang, s, None if i == 2 else len(t or ""), *extra) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
