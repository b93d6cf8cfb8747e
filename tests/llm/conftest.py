import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents-like rows from (doc_id, text) pairs, with a clashing extra column."""
    def make(pairs, extra="shard long, kept string"):
        rows = [(i, t, "en", "s", None if t is None else len(t), 9, "x") for i, t in pairs]
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make
