import pytest

#: Texts that are odd in one way each: null, empty, blank, repeats of words and lines, long, of few words, marks, and one that stands twice.
ODD = [None, "", " \n\t ", "a", "one two", "x " * 400, "the line\nthe line\nthe line\n", "Ein ganz gewöhnlicher Satz über nichts. " * 3, "word" * 5000, "a\x00b \x0b c\x85d", "same text here again", "same text here again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, rows that repeat entirely, null sources, and columns named like those of results."""
    rows = [(i, t, "en", None if i % 3 == 0 else "s", 1, 0.5, True, "b", 7, "sp") for i, t in enumerate(ODD)]
    rows += [rows[7], (None, "no id here", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long, score double, kept boolean, body string, th long, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
