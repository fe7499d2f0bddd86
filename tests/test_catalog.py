"""Every registered query against its check SQL on the smallest test tables."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from tools.verify import compare  # noqa: E402
from workload import catalog  # noqa: E402
from workload.views import TABLES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    engine = duckdb.connect()
    for table in TABLES:
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return engine


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, connection, name):
    status, _, _, detail = compare(spark, connection, name, DATA)
    assert status == "ok", detail


def test_every_query_has_check_sql():
    assert set(catalog.QUERIES) == set(catalog.CHECK_SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert (row.row_count, row.quality_score) == (1552, 85)
