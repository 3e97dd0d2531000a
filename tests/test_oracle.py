"""Every report against SQL run by another engine on the same tables."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from oracle_check import connect, differences

import __spark_entry__ as driver
from tillroll.plans import ORACLE_SQL, REPORTS

FOLDER = str(TESTDATA / "sf0.01")
needs_data = pytest.mark.skipif(not TESTDATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_report_has_sql():
    assert set(REPORTS) == set(ORACLE_SQL) and len(REPORTS) == 47
    assert set(REPORTS) <= set(driver.queries()) and set(ORACLE_SQL) <= set(driver.oracle_sql())


@needs_data
@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_matches_sql(spark, con, name):
    found = driver.queries()[name](spark, FOLDER).toArrow()
    expected = con.sql(driver.oracle_sql()[name]).to_arrow_table()
    assert differences(found, expected) == []


@needs_data
def test_smoke_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["month", "total_revenue", "previous_month", "revenue_change"]
    assert result.count() > 0


@needs_data
def test_known_sizes(spark):
    profile = driver.queries()["quality_profile"](spark, FOLDER).first()
    assert tuple(profile) == (60000, 2053, 2650, 306, 14919)
    shares = driver.queries()["invoice_bucket_share"](spark, FOLDER).collect()
    assert {tuple(r) for r in shares} == {
        ("Small", 1802, 16.56), ("Medium", 7876, 72.39), ("Large", 1202, 11.05)
    }
    first = driver.queries()["quartile_share"](spark, FOLDER).filter("rev_quartiles = 1").first()
    assert (first.quartile_revenue, first.pct_of_total) == (2223219.61, 37.44)
