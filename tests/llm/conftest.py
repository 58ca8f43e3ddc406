import pytest

LONG = "Word one two. " * 30_000


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns that clash with results."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s", 30, 7),
        (2, None, None, None, None, None),
        (3, "", "en", "s", 0, 1),
        (4, "   \n\t ", "en", "s", 6, 1),
        (5, LONG, "en", "s", len(LONG), 1),
        (6, LONG, "en", "s", len(LONG), 1),
        (7, "alpha beta gamma delta epsilon", "en", "s", 30, 7),
        (7, "alpha beta gamma delta epsilon", "en", "s", 30, 7),
        (None, "alpha beta gamma delta epsilon", "en", "s", 30, 7),
        (8, "x" * 200_000, "en", "s", None, 1),
        (9, "naïve 😀   Ünïcode\r\n12 +1 (509) 555-6973", "fr", None, 5, 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long"
    frame = spark.createDataFrame(rows, schema)
    for name in ("ids", "fp", "row", "recipe", "whole", "keep_id", "component_id", "found", "start", "value", "label", "probability", "quality"):
        frame = frame.withColumn(name, frame.score)
    return frame


@pytest.fixture
def no_docs(edge_docs):
    return edge_docs.limit(0)
