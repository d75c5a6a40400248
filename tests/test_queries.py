"""Every query of the library against its SQL, and the entry file."""

import pytest
from compare import differences

from leafmill import queries

LIBRARY = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", LIBRARY)
def test_query(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLES:
        assert differences(df, queries.ORACLES[name], duck) == ""
    else:
        assert df.count() > 0


def test_flagship(spark, sf_dir):
    rows = queries.flagship(spark, sf_dir).collect()
    assert 0 < len(rows) <= 8 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_entry_file_without_training_operators(monkeypatch):
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "leafmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = e.queries()
    assert set(queries.QUERIES) <= set(names) and not any(n.startswith("op1_") for n in names)
    assert set(e.oracle_sql()) <= set(names)
