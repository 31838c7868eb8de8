from pathlib import Path

import duckdb
import pytest

from factmill.llm import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got, want = registry.queries()[name](spark, str(DATA)), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda found: sorted((tuple(r) for r in found), key=str)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_every_query_is_registered():
    import corpus_pipeline

    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(corpus_pipeline.STAGES) == 5
