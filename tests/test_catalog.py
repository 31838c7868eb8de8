import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from factmill.plans import catalog

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_sql(spark, database, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), database.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_entry_without_the_training_data_operators():
    """The rest loads where the subpackage and the pipeline are missing."""
    hide = "import sys; sys.modules.update({'corpus_pipeline': None, 'factmill.llm': None}); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", hide], cwd=REPO, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(catalog.queries()))] * 2


def test_plans_reach_the_scan(spark, tmp_path):
    """Filters and columns are pushed to Parquet, and memberships are semi- and anti-joins."""
    from factmill.functions.predicates import Ge, Prefix
    from factmill.operators.execute import execute, semi_join

    spark.range(100).selectExpr("id", "id % 7 as fk", "cast(id as string) as s", "id as unused").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    member = semi_join(t, Ge("id", 3), "fk")
    plan = lambda df: df._jdf.queryExecution().toString()
    text = plan(execute(t, Ge("id", 50) & Prefix("s", "6") & member).select("id"))
    assert "GreaterThanOrEqual(id,50)" in text and "StringStartsWith(s,6)" in text and "LeftSemi" in text and "unused" not in text.split("Physical Plan")[1]
    assert "LeftAnti" in plan(execute(t, ~member))
