import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, a string, component string, kind int, "
          "part int, key string, sig string, content string, epoch int, label int, base string")


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names clash with those used inside."""
    def make(rows, parts=3):
        full = [(*r, *(None, "en", "src0")[len(r) - 1:], *[None] * 11) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two three four five six"),
       (6, "one two three four five six"), (None, "one two three four five six"), (None, None), (7, "ONE two three four five six"),
       (8, "long word " * 20000), (9, "x" * 100000), (10, "é漢字 \U0001f600 ß " * 50), (-11, "one two")]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])
