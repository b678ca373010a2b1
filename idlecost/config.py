"""Run parameters (the notebook widgets of the original analysis, as one frozen object)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


def _date(value: dt.date | str) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class TcoParams:
    """Parameters of one analysis run.

    Dates are inclusive; the billing range is that of the statements unless it is
    given.  The customer entry needs ``customer_name``, ``lifecycle_metric`` and
    ``create_actions`` (what the lifecycle log calls the creation of a cluster), the
    region entry needs ``sales_region``.  Money is in dollars, discounts in whole
    percent, ``auto_stop_s`` in seconds.  ``session_scope`` is ``"cluster"`` (an idle
    cluster stops on its own) or ``"global"`` (one busy period over all
    clusters of the run, the original notebooks' behaviour).
    """

    start_date: dt.date
    end_date: dt.date
    customer_name: str | None = None
    cost_per_dbu_always_on: float = 0.22
    vm_discount_pct: int = 10
    on_demand_discount_pct: int = 20
    auto_stop_s: int = 1800
    default_on_demand_price: float = 0.70
    # region entry (top accounts of a sales region)
    sales_region: str | None = None
    top_accounts: int = 10
    billing_start_date: dt.date | None = None
    billing_end_date: dt.date | None = None
    sku_substring: str = "sql"
    # statement log
    only_finished: bool = True
    # cluster lifecycle log: the metric of its rows and the actions that create a cluster
    lifecycle_metric: str | None = None
    create_actions: tuple[str, ...] = ()
    # sessions
    session_scope: str = "cluster"
    # Time-outs below it take the scan over range partitions of session cells, others the
    # scan over a scope's cells (range / time-out rows).  Results do not depend on it.
    session_bucket_s: int = 60

    def __post_init__(self) -> None:
        object.__setattr__(self, "start_date", _date(self.start_date))
        object.__setattr__(self, "end_date", _date(self.end_date))
        object.__setattr__(self, "billing_start_date", _date(self.billing_start_date or self.start_date))
        object.__setattr__(self, "billing_end_date", _date(self.billing_end_date or self.end_date))
        if self.start_date > self.end_date:
            raise ValueError("start_date is after end_date")
        if self.auto_stop_s < 0:
            raise ValueError("auto_stop_s must be >= 0")
        if self.session_scope not in ("cluster", "global"):
            raise ValueError("session_scope must be 'cluster' or 'global'")
        if self.session_bucket_s <= 0:
            raise ValueError("session_bucket_s must be > 0")
        if self.top_accounts < 1:
            raise ValueError("top_accounts must be >= 1")
        for name in ("vm_discount_pct", "on_demand_discount_pct"):
            if not 0 <= getattr(self, name) <= 100:
                raise ValueError(f"{name} must be within 0..100")

    def require(self, *names: str) -> None:
        """Raise unless each of these parameters is given."""
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise ValueError(f"this analysis needs {', '.join(missing)}")

    def with_(self, **changes) -> "TcoParams":
        return replace(self, **changes)
