"""Every query with an oracle against DuckDB, on the smallest tables."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from tracewipe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, Number) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    want = duck.sql(catalog.ORACLES[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_the_removed_package_is_forgiven(monkeypatch):
    import __spark_entry__ as entry

    for missing, forgiven in (("tracewipe.llm", True), ("tracewipe.llm.common", False), ("zstandard", False)):

        def gone(name, missing=missing):
            raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

        monkeypatch.setattr(entry, "import_module", gone)
        if forgiven:
            assert entry._optional("tracewipe.llm.catalog", "tracewipe.llm") is None
        else:
            with pytest.raises(ModuleNotFoundError):
                entry._optional("tracewipe.llm.catalog", "tracewipe.llm")
