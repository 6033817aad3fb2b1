import pytest
from awkward import AWKWARD

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside, as extra columns of their input.
EXTRA = ["kept", "digest", "n", "rank", "copy", "fp", "root", "key", "k1", "k2", "text_hash", "rate", "_0", "found"]


@pytest.fixture(scope="session")
def documents(spark):
    """A frame from (doc_id, text[, lang[, source]]) with extra columns of clashing names."""

    def make(rows):
        full = [(*r, *(("en", "s")[len(r) - 2:] if len(r) < 4 else ()), 1) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENT)
        for i, name in enumerate(EXTRA):
            frame = frame.selectExpr("*", f"{i} AS `{name}`")
        return frame

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    return documents(AWKWARD).repartition(3)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents([])
