"""Small tables with the awkward rows that every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"
LONG = ("word " * 30_000).strip()
ODD = [
    (1, None, None, None, None, "clash", 1.0),
    (2, "", "en", "s", 0, None, None),
    (3, "   \n\t ", "en", "s", 4, None, None),
    (4, LONG, "en", "s", len(LONG), None, None),
    (5, "The same text here.", "en", "s", 10, None, None),
    (5, "The same text here.", "en", "s", 10, None, None),
    (6, "The same text here.", "en", "s", 10, None, None),
    (None, "A row without an id.", "en", "s", 10, None, None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
