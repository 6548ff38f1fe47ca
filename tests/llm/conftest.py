import pytest


@pytest.fixture
def docs(spark):
    """Builds documents with an extra column whose names clash with outputs and helper columns."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "extra", 5, 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, score int, start int")

    return make
