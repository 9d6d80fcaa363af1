"""Fixtures: texts of made-up words, and a table with every odd row."""

import random

VOCABULARY = ["".join(random.Random(k).choice("aeioubdfglmnprst") for _ in range(2 + k % 7)) for k in range(900)]


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return [rng.choice(VOCABULARY) for _ in range(n)]


LONG = " ".join(prose(99, 30_000))

#: Null, empty and blank texts, a very long one, repeated rows, null ids; extra columns have names that operators add.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", None, 0),
    (3, " \t\n ", None, "s", 3),
    (4, LONG, "fr", "s", len(LONG)),
    (5, "twice the same row of text here", "fr", "s", None),
    (5, "twice the same row of text here", "fr", "s", None),
    (None, "a row without an id has a text as well", "en", "s", 1),
    (7, "one", "en", "s", 3),
    (8, "é\x00 ﬁ 𝒳 ▁ mixed\r\n\r\nlines", "en", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "hits", "ids", "spans", "kept", "label", "id", "rep", "lang_pred", "count", "part")


def odd_documents(spark, rows=ODD):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


def labels(spark, rows=((1, 1, 0), (2, 0, 0), (5, 1, 0), (5, 0, 1), (7, None, None), (None, 1, 0), (3, 0, 0), (8, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
