"""idlecost: cost of SQL warehouses, always-on versus on-demand, as Spark jobs.

From a log of finished statements, a cluster-to-endpoint map, cluster lifecycle
events, daily workload usage and billing, the operators rebuild each statement's
time interval, merge statements into busy sessions under an idle time-out, cut
intervals at midnight, price the same work on always-on clusters (billing units
plus machines) and on on-demand clusters (billing units only), and compare the two
per endpoint, customer and day.

Every operator is a function ``DataFrame(s) + parameters -> DataFrame`` built from
Spark's own joins, aggregations and windows: no Python UDFs, nothing collected.
"""

from idlecost.config import TcoParams

__all__ = ["TcoParams"]
