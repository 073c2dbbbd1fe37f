import pytest

SF = "/root/testdata/sf0.001"
#: Columns that the operators also use as names of their own.
CLASHING = "row string, id string, uid string, kept string, score double, fp string, rows long, norm string, u string, v string, best string"


def sample(spark, texts, ids=None, langs=None, extra=True):
    """Documents with the given texts (and columns of clashing names)."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    data = [(i, t, l, "s", None) for i, t, l in zip(ids, texts, langs)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        clash = CLASHING.split(", ")
        data = [r + tuple(1.5 if "double" in c else 7 if "long" in c else "x" for c in clash) for r in data]
        schema += ", " + CLASHING
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, null and repeated identifiers."""
    long_text = "Word and more words here. " * 8000
    texts = ["Same text.", "same TEXT.", "Same text.", None, "", "   \n", "12 34 !!", "É", "é", "a\u0000b c", long_text, long_text, "\U0001f600 x", "Same text."]
    ids = [5, 3, 5, 8, 9, 10, None, 11, 12, 13, 14, 15, 16, None]
    return sample(spark, texts, ids)


@pytest.fixture(scope="session")
def none(spark):
    return sample(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
