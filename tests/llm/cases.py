"""Small documents that every operator must survive: nulls, empty and long texts, ties, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, token string, a int, part string"
LONG = " ".join(f"wörd{i % 977}" for i in range(30_000))


def edge_documents(spark):
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (5, "another text with the same id"), (6, LONG), (7, LONG + " tail"), (8, "emoji 🙂🙂 and é́ text"),
        (None, "no id here"), (9, "x" * 5000), (10, 'token = "abcdef0123456789abcdef0123456789"'), (11, "a\nb\nc\n\n\nd"),
    ]
    return spark.createDataFrame([(i, t, None, "s", None, 7, "id", "t", 1, "p") for i, t in rows], SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
