"""End-to-end analyses composed from the operators."""

from idlecost.plans.customer import CustomerAnalysis
from idlecost.plans.daily import DailyRuns
from idlecost.plans.region import RegionAnalysis
from idlecost.plans.report import write_reports

__all__ = ["CustomerAnalysis", "DailyRuns", "RegionAnalysis", "write_reports"]
