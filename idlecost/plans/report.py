"""Run an analysis end to end and write its reports (the sink).

The sessions are written first, which is the run's only pass over the statement log;
both cost tables come from the written sessions, and all totals from the written cost
tables.  The first day of the sessions bounds the workloads scan from below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idlecost.plans.customer import CustomerAnalysis
from idlecost.plans.region import RegionAnalysis


def write_reports(analysis: CustomerAnalysis | RegionAnalysis, out_dir: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> dict[str, str]:
    """Write every report below ``out_dir`` and return their paths by name."""
    written: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        path = written[name] = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode(mode).format(fmt).save(path)
        return df.sparkSession.read.format(fmt).schema(df.schema).load(path)

    sessions = put("sessions", analysis.sessions)
    first_day = sessions.agg(F.min("date")).first()[0]
    always_on = put("always_on_costs", analysis.always_on_costs_of(sessions, first_day))
    on_demand = put("on_demand_costs", analysis.on_demand_costs_of(sessions, first_day))
    for name, df in analysis.totals(sessions, always_on, on_demand).items():
        put(name, df)
    return written
