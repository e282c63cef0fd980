import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts or from whole rows; ids count from 1."""

    def make(*rows, kind=KIND):
        full = [r if isinstance(r, tuple) else (i, r, "en", "a", len(r or "")) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, kind)

    return make
