import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits int, row string, _hit int"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank and very long texts, ties and repeated rows, columns whose names clash with those the operators make."""
    base = "Alpha beta, gamma delta! the quick brown fox's den 12 jumps — éçà über straße. "
    texts = [None, "", " ", "\n\t ", "a", base * 3, base * 3, base * 3 + " ", "x" * 70_000, base * 3000, "日本語 текст ελληνικά", "<|endoftext|> in it", "12 345 !!", base * 2 + "other words here"]
    rows = [(i, t, "en" if i % 3 else None, None, None, 0.5, 1, "r", 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base * 3, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, "another text of the same id", "fr", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter(F.lit(False))
