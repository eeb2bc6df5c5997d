import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem Ipsum dolor, sit amet. " * 6000

ROWS = [
    (1, "One two three four five. All rights reserved.", "en", "a", 10),
    (2, "One two three four five. All rights reserved.", "en", "a", 10),
    (2, "One two three four five. All rights reserved.", "en", "a", 10),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "no id here", "en", None, None),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, "Übergrößen naïve 💡 x\x00y", "de", "c", 1),
    (8, "word", None, "c", 4),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns of clashing names."""
    from pyspark.sql import functions as F

    from strandline.llm.common import shipped

    d = shipped(spark).createDataFrame(ROWS, DOCS)
    clash = ["fp", "score", "key", "train", "plan", "group", "position", "fingerprint", "row", "y", "rank", "component_id", "slot"]
    return d.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(spark, edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (6, 0, 0), (None, 1, 1), (8, None, None), (99, 0, 1), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
