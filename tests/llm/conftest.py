import pytest

from tracewipe.session import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sp(spark):
    return prepare(spark)


@pytest.fixture
def documents(sp):
    def make(rows):
        return sp.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)

    return make
