"""Named reports over the retail table, and SQL to check them against."""

from tillroll.plans.oracle import ORACLE_SQL
from tillroll.plans.reports import REPORTS, publish, run_report

__all__ = ["ORACLE_SQL", "REPORTS", "publish", "run_report"]
