import pytest

#: Texts that every operator has to bear: NULL, empty, white space, one character, repeats, very long.
ODD = [None, "", " \n\t", "a", "É", "same text twice", "same text twice", "x" * 30000,
       "word " * 20000, "line one is long enough to count\n" * 40, "\n\n", "emoji 😀 here\u0085"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated ids and rows, a NULL id, and columns named like the operators' own."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s", 0), (3, "another text under the same id", None, None, None),
             (None, "no id at all", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS shard", "'k' AS kept", "2 AS piece", "0 AS fp", "'v' AS verdict",
                         "true AS rejected", "5 AS length", "7 AS __n")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
