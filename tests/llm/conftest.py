import pytest

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 4


def odd_rows():
    """Null and repeated ids, null and empty texts, repeated rows, a very long text, near copies."""
    rows = [(1, "Hello brave new world of text"), (2, None), (3, ""), (4, "   \n \t "), (None, "no id at all here"), (None, "no id at all here"), (5, "Hello brave new world of text"), (5, "Hello brave new world of text"), (6, "x"), (7, LONG), (8, BASE), (9, BASE + "end"), (10, "éè 你好 \U0001f600"), (None, None)]
    return [(i, t, None if k % 3 else "en", k, k, "a", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, n long, hash long, _gone string, spans int").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, toxic int")
