"""Independent DuckDB statements of every registered query, for the correctness gate.

They run on the driver's tables (``events``, ``customer``, ``orders``, ``nation``,
``region`` views), rebuild the logical inputs of FIXTURES.md with DuckDB's own
functions, and state each operator in plain SQL.  Where the Spark side uses a
scalable formulation the SQL uses the textbook one instead (sessions: one
running window per cluster, not the bucketed two-level scan), so the two check
each other.  Arithmetic is written in the same order as on the Spark side, so
doubles agree to the last bit; totals are exact (summed in millionths).
"""

from __future__ import annotations

import re

from idlecost.config import TcoParams
from idlecost.sources import fixtures as fx
from idlecost.sources import price_book as pb

DAY = 86_400_000_000
SEC = 1_000_000

# Parameters of the registered queries (FIXTURES.md).
CUSTOMER_PARAMS, REGION_PARAMS = fx.CUSTOMER_PARAMS, fx.REGION_PARAMS
GLOBAL_SESSION_AUTO_STOP_S = fx.GLOBAL_SESSION_AUTO_STOP_S

# The user an event counts for, and its warehouse (integer division keeps the map functional).
USER = f"CASE WHEN event_id % {fx.HOT_EVERY} = 0 THEN 0 ELSE user_id END"
CLUSTER = f"({USER}) // {fx.USERS_PER_CLUSTER}"
ENDPOINT = f"({USER}) // {fx.USERS_PER_ENDPOINT}"
WORKSPACE = f"({USER}) // {fx.USERS_PER_WORKSPACE}"


def _d(value) -> str:
    return f"DATE '{value.isoformat()}'"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _f(x: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if x is None else f"CAST('{x!r}' AS DOUBLE)"


def _in(values) -> str:
    return ", ".join(_s(v) for v in values)


def _case(index: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {_s(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def _floor_s(col: str) -> str:
    return f"({col} - {col} % {SEC})"


def _sum_exact(col: str) -> str:
    return f"CAST(sum(CAST(round(({col}) * 1000000) AS BIGINT)) AS DOUBLE) / 1000000"


def _slices(src: str, cols: str) -> str:
    """Half-open midnight cuts of [start_us, end_us)."""
    return f"""
    SELECT {cols}, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS DATE) AS date,
           greatest(start_us, d * {DAY}) AS start_us, least(end_us, (d + 1) * {DAY}) AS end_us
    FROM (SELECT {cols}, start_us, end_us,
                 unnest(generate_series(start_us // {DAY}, greatest(start_us, end_us - 1) // {DAY})) AS d
          FROM {src}) AS cut"""


def _sessions(src: str, gap_s: int, scope: str, group_cols: str) -> str:
    part = "PARTITION BY cluster_id" if scope == "cluster" else ""
    gap = gap_s * SEC
    return f"""
    SELECT {group_cols}, CAST(DATE '1970-01-01' + CAST(start_us // {DAY} AS INTEGER) AS DATE) AS date,
           start_us, end_us, {_floor_s('end_us')} + {gap} AS end_autostop_us, statements
    FROM (
      SELECT {group_cols}, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS statements
      FROM (
        SELECT *, sum(CASE WHEN prev_end IS NULL OR start_us - {gap} > prev_end THEN 1 ELSE 0 END)
                  OVER ({part} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
        FROM (
          SELECT *, max(end_us) OVER ({part} ORDER BY start_us, end_us
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
          FROM {src}) AS w1) AS w2
      GROUP BY {group_cols}, sid) AS g"""


def _vm_rates(src: str, book: str, discount_pct: int) -> str:
    f = 100 - discount_pct
    regions = _in(pb.book_regions(book))

    def rate(opt: str) -> str:
        return (f"COALESCE(d.{opt}, f.dd_{opt}) * {f} / 100 + "
                f"(CASE WHEN d.{opt} IS NOT NULL THEN COALESCE(w.{opt}, f.dw_{opt}) ELSE f.dw_{opt} END)"
                f" * {f} / 100 * COALESCE(x.max_workers, 1)")

    return f"""
    SELECT x.*, {rate('od')} AS vm_rate_on_demand, {rate('sp')} AS vm_rate_spot
    FROM (SELECT *, CASE WHEN region IN ({regions}) THEN region ELSE {_s(pb.FALLBACK_REGION)} END AS region_eff
          FROM {src}) AS x
    LEFT JOIN vm_book_{book} d ON d.region = x.region_eff AND d.node_type = x.driver_node_type
    LEFT JOIN vm_book_{book} w ON w.region = x.region_eff AND w.node_type = x.worker_node_type
    LEFT JOIN vm_defaults_{book} f ON f.region = x.region_eff"""


def _dated_vm_costs(src: str, discount_pct: int) -> str:
    """Machine dollars by price rows with dates: each price is the latest one of its thing on or before the day."""
    f = 100 - discount_pct
    driver, worker = (f"CASE WHEN contains(x.region_eff, '-') THEN {_s(pb.DEFAULT_PAIR_DASHED[i])} ELSE {_s(pb.DEFAULT_PAIR_OTHER[i])} END"
                      for i in (0, 1))

    def price(node: str, option: str) -> str:
        return (f"(SELECT arg_max(p.usd, p.valid_from) FROM vm_price_rows p WHERE p.region = x.region_eff AND p.node_type = {node} "
                f"AND p.option = '{option}' AND p.valid_from <= x.date)")

    cols = ", ".join(f"{price(node, option)} AS {name}_{tag}" for name, node in (
        ("d", "x.driver_node_type"), ("w", "x.worker_node_type"), ("dd", driver), ("dw", worker))
        for option, tag in (("ondemand", "od"), ("spot", "sp")))

    def rate(o: str) -> str:
        return (f"COALESCE(d_{o}, dd_{o}) * {f} / 100 + (CASE WHEN d_{o} IS NOT NULL THEN COALESCE(w_{o}, dw_{o}) ELSE dw_{o} END)"
                f" * {f} / 100 * COALESCE(max_workers, 1)")

    return f"""
    SELECT *, vm_on_demand_usd + vm_spot_usd + dbu_usd AS total_usd FROM (
      SELECT *, CASE WHEN COALESCE(is_spot, false) THEN CAST(0.0 AS DOUBLE) ELSE {rate('od')} END * node_hours AS vm_on_demand_usd,
             CASE WHEN COALESCE(is_spot, false) THEN {rate('sp')} ELSE CAST(0.0 AS DOUBLE) END * node_hours AS vm_spot_usd
      FROM (SELECT x.*, {cols} FROM (
        SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM vm_price_rows k WHERE k.region = s.region AND k.valid_from <= s.date)
                    THEN s.region ELSE {_s(pb.FALLBACK_REGION)} END AS region_eff FROM {src} s) AS x) AS y) AS z"""


def _price_row_ctes() -> dict[str, str]:
    def day(value) -> str:
        return _d(value) if value else "DATE '0001-01-01'"

    vm = ", ".join(f"({_s(r)}, {_s(o)}, {_s(n)}, {_f(usd)}, {day(since)})" for r, o, n, usd, since in fx.vm_price_rows())
    dbu = ", ".join(f"({_s(r)}, {_f(usd)}, {day(since)})" for r, usd, since in fx.dbu_price_rows())
    return {"vm_price_rows": f"SELECT * FROM (VALUES {vm}) AS t(region, option, node_type, usd, valid_from)",
            "dbu_price_rows": f"SELECT * FROM (VALUES {dbu}) AS t(region, usd, valid_from)"}


def _totals(tag: str, sets: dict[str, str], vm: str, split: bool) -> str:
    """Both sides' totals with the database's own grouping sets."""
    keys = list(dict.fromkeys(k.strip() for s in sets.values() for k in s.split(",") if k.strip()))
    both = "CAST(NULL AS DOUBLE)"
    ao = f"SELECT {', '.join(keys)}, 1 AS a, 0 AS o, total_usd, dbu_usd, {'vm_on_demand_usd' if split else both} AS od, " \
         f"{'vm_spot_usd' if split else both} AS sp, {vm} AS vm, {both} AS n_dbus, {both} AS n_usd FROM ao_costs_{tag}"
    od = f"SELECT {', '.join(keys)}, 0, 1, {', '.join([both] * 5)}, dbus, on_demand_usd FROM od_costs_{tag}"
    level = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"GROUPING({k}) = {int(k not in [x.strip() for x in s.split(',')])}" for k in keys) + f" THEN '{n}'"
        for n, s in sets.items()) + " END"
    shown = [f"CAST({k} AS VARCHAR) AS {k}" if k in ("endpoint_id", "cluster_id", "date") else k for k in keys]
    sums = {"always_on_usd": "total_usd", "dbu_usd": "dbu_usd", "vm_on_demand_usd": "od", "vm_spot_usd": "sp", "vm_usd": "vm",
            "on_demand_dbus": "n_dbus", "on_demand_usd": "n_usd"}
    return (f"SELECT {level} AS level, {', '.join(shown)}, CAST(sum(a) AS BIGINT) AS always_on_rows, CAST(sum(o) AS BIGINT) AS on_demand_rows, "
            + ", ".join(f"{_sum_exact(c)} AS {n}" for n, c in sums.items())
            + f" FROM ({ao} UNION ALL {od}) AS u GROUP BY GROUPING SETS ({', '.join(f'({s})' for s in sets.values())})")


def _book_ctes() -> dict[str, str]:
    out = {}
    dbu = ", ".join(f"({_s(r)}, {_f(p)})" for r, p in pb.ON_DEMAND_DBU_USD)
    out["dbu_book"] = f"SELECT * FROM (VALUES {dbu}) AS t(region, usd)"
    for book in pb.BOOKS:
        rows = ", ".join(f"({_s(r)}, {_s(n)}, {_f(od)}, {_f(sp)})" for r, n, od, sp in pb.vm_price_wide_rows(book))
        out[f"vm_book_{book}"] = f"SELECT * FROM (VALUES {rows}) AS t(region, node_type, od, sp)"
        rows = ", ".join(f"({_s(r)}, {_f(a)}, {_f(b)}, {_f(c)}, {_f(d)})"
                         for r, a, b, c, d in pb.region_default_rows(book))
        out[f"vm_defaults_{book}"] = f"SELECT * FROM (VALUES {rows}) AS t(region, dd_od, dd_sp, dw_od, dw_sp)"
    return out


def _ctes() -> dict[str, str]:
    m, r = CUSTOMER_PARAMS, REGION_PARAMS
    c: dict[str, str] = {}
    azure = "user_id % 13 BETWEEN 6 AND 10"
    regions = _case("user_id % 13", fx.FIXTURE_REGIONS)
    # -- logical inputs (FIXTURES.md) ---------------------------------------
    c["statements"] = f"""
    SELECT event_id AS statement_id, {CLUSTER} AS cluster_id, {WORKSPACE} AS workspace_id,
           CAST(ts AS DATE) AS date, ts AS ended_at, value AS duration_s,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END AS fetch_s,
           CASE WHEN event_type = 'error' THEN 'error' ELSE 'finish' END AS status
    FROM events"""
    c["endpoints"] = f"""
    SELECT DISTINCT {CLUSTER} AS cluster_id, {ENDPOINT} AS endpoint_id, {WORKSPACE} AS workspace_id FROM events"""
    c["cluster_events"] = f"""
    SELECT user_id, CAST(DATE '2024-01-01' + CAST(user_id % 31 AS INTEGER) AS DATE) AS date,
           {_s(fx.LIFECYCLE_METRIC)} AS metric,
           CASE WHEN user_id % 5 = 4 THEN 'resize' WHEN user_id % 2 = 0 THEN {_s(fx.CREATE_ACTIONS[0])}
                ELSE {_s(fx.CREATE_ACTIONS[1])} END AS action,
           CAST(user_id // {fx.USERS_PER_CLUSTER} AS VARCHAR) AS tag_cluster_id,
           CASE WHEN user_id // {fx.USERS_PER_CLUSTER} % 12 = 7 THEN 'true' WHEN user_id % 3 = 0 THEN NULL
                ELSE 'false' END AS is_serverless
    FROM (SELECT DISTINCT user_id FROM events) AS u"""
    c["workspaces"] = """
    SELECT c_custkey AS workspace_id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS customer_name
    FROM customer"""
    c["billing"] = f"""
    SELECT CAST(o.o_orderdate AS DATE) AS date, lower(a.c_name) AS account_name, rg.r_name AS sales_region,
           CASE WHEN o.o_orderpriority IN ({_in(fx.SQL_PRIORITIES)}) THEN 'PREMIUM_SQL_COMPUTE'
                ELSE 'JOBS_COMPUTE' END AS sku,
           o.o_totalprice AS dbus
    FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
    JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region rg ON n.n_regionkey = rg.r_regionkey
    JOIN customer a ON a.c_custkey = o.o_custkey // {fx.CUSTOMERS_PER_ACCOUNT}"""
    c["workloads"] = f"""
    SELECT CAST(ts AS DATE) AS date, {CLUSTER} AS cluster_id, value / 5 AS node_hours,
           1 + event_id % 16 AS pricing_units,
           CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 5 END AS workers,
           user_id % 3 = 0 AS is_spot, {regions} AS region,
           CASE WHEN {azure} THEN {_case('event_id % 3', fx.AZURE_DRIVERS)}
                ELSE {_case('event_id % 3', fx.AWS_DRIVERS)} END AS driver_node_type,
           CASE WHEN {azure} THEN {_s(fx.AZURE_WORKER)} ELSE {_s(fx.AWS_WORKER)} END AS worker_node_type
    FROM events"""
    c.update(_book_ctes())
    c["wl"] = f"SELECT * FROM workloads WHERE date <= {_d(m.end_date)}"

    # -- C1 statement intervals ---------------------------------------------
    def intervals(p: TcoParams) -> str:
        status = " AND status = 'finish'" if p.only_finished else ""
        fetch = "COALESCE(CAST(fetch_s AS DOUBLE), 0.0)"
        return f"""
        SELECT statement_id, cluster_id, workspace_id, date,
               (epoch_us(ended_at) - epoch_us(ended_at) % 1000)
                 - CAST(round(duration_s * 1000000) AS BIGINT) - CAST(round({fetch} * 1000000) AS BIGINT) AS start_us,
               epoch_us(ended_at) AS end_us, CAST(duration_s AS DOUBLE) AS duration_s, {fetch} AS fetch_s
        FROM statements WHERE date BETWEEN {_d(p.start_date)} AND {_d(p.end_date)}{status}"""

    c["intervals_m"] = intervals(m)
    c["intervals_r"] = intervals(r)

    # -- every warehouse (sessions over the whole log) -----------------------
    c["all_att"] = """
    SELECT i.statement_id, i.cluster_id, i.workspace_id, e.endpoint_id, i.start_us, i.end_us
    FROM intervals_m i JOIN (SELECT DISTINCT cluster_id, endpoint_id FROM endpoints) e ON i.cluster_id = e.cluster_id"""
    wkeys = "cluster_id, endpoint_id, workspace_id"
    c["sessions_all"] = _sessions("all_att", m.auto_stop_s, "cluster", wkeys)
    c["sessions_all_global"] = _sessions("all_att", GLOBAL_SESSION_AUTO_STOP_S, "global", wkeys)
    c["sessions_all_instant"] = _sessions("all_att", 0, "cluster", wkeys)
    c["sessions_all_ivl"] = f"SELECT {wkeys}, start_us, end_autostop_us AS end_us FROM sessions_all"
    c["session_slices"] = _slices("sessions_all_ivl", wkeys)

    # -- C2, C3, C6 single customer -----------------------------------------
    c["kept_clusters"] = f"""
    SELECT DISTINCT CAST(tag_cluster_id AS BIGINT) AS cluster_id FROM cluster_events
    WHERE date BETWEEN {_d(m.start_date)} AND {_d(m.end_date)} AND metric = {_s(m.lifecycle_metric)}
      AND action IN ({_in(m.create_actions)}) AND COALESCE(is_serverless, 'false') = 'false'"""
    c["cust_clusters"] = f"""
    SELECT w.workspace_id, e.cluster_id, e.endpoint_id
    FROM (SELECT workspace_id FROM workspaces WHERE lower(customer_name) = lower({_s(m.customer_name)})) w
    JOIN endpoints e ON e.workspace_id = w.workspace_id"""
    c["att_m"] = """
    SELECT i.statement_id, i.cluster_id, i.workspace_id, k.endpoint_id, i.start_us, i.end_us, i.duration_s, i.fetch_s
    FROM intervals_m i
    JOIN (SELECT DISTINCT cluster_id, endpoint_id FROM cust_clusters
          WHERE cluster_id IN (SELECT cluster_id FROM kept_clusters)) k ON i.cluster_id = k.cluster_id"""

    # -- C4, C5, C6 region ----------------------------------------------------
    c["top_r"] = f"""
    SELECT account_name, CAST(m AS DOUBLE) / 1000000 AS total_dbus FROM (
      SELECT account_name, sum(CAST(round(dbus * 1000000) AS BIGINT)) AS m FROM billing
      WHERE date BETWEEN {_d(r.billing_start_date)} AND {_d(r.billing_end_date)}
        AND contains(sales_region, {_s(r.sales_region)}) AND contains(lower(sku), {_s(r.sku_substring.lower())})
      GROUP BY account_name ORDER BY m DESC, account_name ASC LIMIT {r.top_accounts}) AS t"""
    c["acct_ws"] = """
    SELECT w.workspace_id, w.customer_name FROM workspaces w JOIN top_r t ON lower(w.customer_name) = lower(t.account_name)"""
    c["att_r"] = """
    SELECT i.statement_id, i.cluster_id, i.workspace_id, e.endpoint_id, a.customer_name,
           i.start_us, i.end_us, i.duration_s, i.fetch_s
    FROM intervals_r i JOIN endpoints e ON i.cluster_id = e.cluster_id AND i.workspace_id = e.workspace_id
    JOIN acct_ws a ON a.workspace_id = i.workspace_id"""

    # -- C7, C9, C10-C12 always-on --------------------------------------------
    for tag, keys in (("m", wkeys), ("r", wkeys + ", customer_name")):
        c[f"spans_{tag}"] = f"""
        SELECT {keys}, min(start_us) AS start_us, max(end_us) AS end_us FROM att_{tag} GROUP BY {keys}"""
        c[f"span_slices_{tag}"] = _slices(f"spans_{tag}", keys)
    nodes = "driver_node_type, worker_node_type, region"
    sk = ", ".join(f"s.{k.strip()}" for k in wkeys.split(","))
    wn = ", ".join(f"w.{k.strip()}" for k in nodes.split(","))
    run_end = f"{_floor_s('s.start_us')} + CAST(round(w.node_hours * 3600 * 1000000) AS BIGINT)"
    c["ao_group_m"] = f"""
    SELECT s.date, {sk}, {wn},
           max(s.start_us) AS start_us, max({run_end}) AS end_us,
           max(w.pricing_units) AS max_pricing_units, max(w.workers) AS max_workers, bool_or(w.is_spot) AS is_spot
    FROM span_slices_m s JOIN wl w ON s.date = w.date AND s.cluster_id = w.cluster_id
    GROUP BY s.date, {sk}, {wn}"""
    c["ao_daily_m"] = f"""
    SELECT *, ({_floor_s('end_us')} - {_floor_s('start_us')}) // {SEC} / 3600 AS node_hours
    FROM ({_slices('ao_group_m', wkeys + ', ' + nodes + ', max_pricing_units, max_workers, is_spot')}) AS rs"""
    c["ao_daily_r"] = f"""
    SELECT s.date, {sk}, s.customer_name, {wn},
           max(s.start_us) AS start_us, max(s.end_us) AS end_us, max({run_end}) AS run_end_us,
           max(w.node_hours) AS node_hours, max(w.pricing_units) AS max_pricing_units, max(w.workers) AS max_workers
    FROM span_slices_r s JOIN wl w ON s.date = w.date AND s.cluster_id = w.cluster_id
    GROUP BY s.date, {sk}, s.customer_name, {wn}"""
    for tag in ("m", "r"):
        c[f"ao_dbu_{tag}"] = f"""
        SELECT *, dbus * {_f(m.cost_per_dbu_always_on)} AS dbu_usd
        FROM (SELECT *, (max_pricing_units + max_workers * 2) * node_hours AS dbus FROM ao_daily_{tag}) AS x"""
    c["ao_rates_m"] = _vm_rates("ao_dbu_m", "customer", m.vm_discount_pct)
    c["ao_costs_m"] = """
    SELECT *, vm_on_demand_usd + vm_spot_usd + dbu_usd AS total_usd FROM (
      SELECT *, CASE WHEN COALESCE(is_spot, false) THEN CAST(0.0 AS DOUBLE) ELSE vm_rate_on_demand END * node_hours
                  AS vm_on_demand_usd,
                CASE WHEN COALESCE(is_spot, false) THEN vm_rate_spot ELSE CAST(0.0 AS DOUBLE) END * node_hours
                  AS vm_spot_usd
      FROM ao_rates_m) AS x"""
    c["ao_rates_r"] = _vm_rates("ao_dbu_r", "region", r.vm_discount_pct)
    c["ao_costs_r"] = """
    SELECT *, vm_usd + dbu_usd AS total_usd FROM (SELECT *, vm_rate_on_demand * node_hours AS vm_usd FROM ao_rates_r) x"""

    # -- C8, C13, C14 on-demand -----------------------------------------------
    c["sessions_m"] = _sessions("att_m", m.auto_stop_s, m.session_scope, wkeys)
    c["sessions_r"] = _sessions("att_r", r.auto_stop_s, r.session_scope, wkeys + ", customer_name")
    c["sessions_mg"] = _sessions("att_m", GLOBAL_SESSION_AUTO_STOP_S, "global", wkeys)
    c["sessions_rg"] = _sessions("att_r", GLOBAL_SESSION_AUTO_STOP_S, "global", wkeys + ", customer_name")
    for tag, keys in (("m", wkeys), ("r", wkeys + ", customer_name"), ("mg", wkeys), ("rg", wkeys + ", customer_name")):
        sk2 = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
        secs = f"({_floor_s('end_autostop_us')} - {_floor_s('start_us')}) // {SEC}"
        c[f"od_usage_{tag}"] = f"""
        SELECT *, (max_pricing_units + max_workers * 2) / 3600 * ({secs}) AS dbus FROM (
          SELECT s.date, {sk2}, w.region, s.start_us, max(s.end_autostop_us) AS end_autostop_us,
                 max(w.pricing_units) AS max_pricing_units, max(w.workers) AS max_workers
          FROM sessions_{tag} s JOIN wl w ON s.date = w.date AND s.cluster_id = w.cluster_id
          GROUP BY s.date, {sk2}, w.region, s.start_us) AS g"""
        f = 100 - m.on_demand_discount_pct
        c[f"od_costs_{tag}"] = f"""
        SELECT *, dbus * usd_per_dbu AS on_demand_usd FROM (
          SELECT u.*, COALESCE(p.usd, {_f(m.default_on_demand_price)}) * {f} / 100 AS usd_per_dbu
          FROM od_usage_{tag} u LEFT JOIN dbu_book p ON p.region = u.region) AS x"""

    # -- prices with dates ------------------------------------------------------
    c.update(_price_row_ctes())
    c["ao_costs_dated"] = _dated_vm_costs("ao_dbu_m", m.vm_discount_pct)
    c["od_costs_dated"] = f"""
    SELECT *, dbus * usd_per_dbu AS on_demand_usd FROM (
      SELECT u.*, COALESCE((SELECT arg_max(p.usd, p.valid_from) FROM dbu_price_rows p WHERE p.region = u.region AND p.valid_from <= u.date),
                           {_f(m.default_on_demand_price)}) * {100 - m.on_demand_discount_pct} / 100 AS usd_per_dbu
      FROM od_usage_m u) AS x"""

    # -- C15-C19 reports ------------------------------------------------------
    c["ao_by_cust"] = f"""
    SELECT customer_name, {_sum_exact('total_usd')} AS always_on_usd, {_sum_exact('dbu_usd')} AS dbu_usd,
           {_sum_exact('vm_usd')} AS vm_usd FROM ao_costs_r GROUP BY customer_name"""
    c["od_by_cust"] = f"""
    SELECT customer_name, {_sum_exact('on_demand_usd')} AS on_demand_usd FROM od_costs_r GROUP BY customer_name"""
    c["od_by_cust_global"] = f"""
    SELECT customer_name, {_sum_exact('on_demand_usd')} AS on_demand_usd FROM od_costs_rg GROUP BY customer_name"""
    return c


_DATE_CAST = "CAST(date AS VARCHAR) AS date"


def _comparison(on_demand: str) -> str:
    return f"""
            SELECT o.customer_name, o.on_demand_usd, a.always_on_usd, a.dbu_usd, a.vm_usd,
                   o.on_demand_usd - a.dbu_usd AS team_variation_usd,
                   o.on_demand_usd - a.always_on_usd AS variation_usd,
                   CASE WHEN a.always_on_usd <> 0 THEN (o.on_demand_usd - a.always_on_usd) / a.always_on_usd * 100
                   END AS variation_pct
            FROM {on_demand} o JOIN ao_by_cust a ON o.customer_name = a.customer_name"""


def _queries() -> dict[str, str]:
    se = _sum_exact
    slice_cols = "cluster_id, endpoint_id, workspace_id"
    q = {
        "statement_intervals": f"""SELECT statement_id, cluster_id, workspace_id, {_DATE_CAST}, start_us, end_us,
                                   duration_s, fetch_s FROM intervals_m""",
        "non_serverless_clusters": "SELECT cluster_id FROM kept_clusters",
        "customer_workspaces": "SELECT workspace_id, cluster_id, endpoint_id FROM cust_clusters",
        "top_accounts": "SELECT account_name, total_dbus FROM top_r",
        "account_workspaces": "SELECT workspace_id, customer_name FROM acct_ws",
        "attributed_statements": "SELECT * FROM att_m",
        "attributed_statements_region": "SELECT * FROM att_r",
        "active_span": "SELECT * FROM spans_m",
        "idle_sessions": f"SELECT {slice_cols}, {_DATE_CAST}, start_us, end_us, end_autostop_us, statements FROM sessions_all",
        "idle_sessions_global": f"""SELECT {slice_cols}, {_DATE_CAST}, start_us, end_us, end_autostop_us, statements
                                    FROM sessions_all_global""",
        "idle_sessions_instant": f"""SELECT {slice_cols}, {_DATE_CAST}, start_us, end_us, end_autostop_us, statements
                                     FROM sessions_all_instant""",
        "day_slices": f"SELECT {slice_cols}, {_DATE_CAST}, start_us, end_us FROM session_slices",
        "always_on_daily": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, driver_node_type,
                               worker_node_type, region, start_us, end_us, max_pricing_units, max_workers, is_spot,
                               node_hours FROM ao_daily_m""",
        "always_on_daily_region": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, customer_name,
                                      driver_node_type, worker_node_type, region, start_us, end_us, run_end_us,
                                      node_hours, max_pricing_units, max_workers FROM ao_daily_r""",
        "dbu_cost_always_on": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, driver_node_type,
                                  worker_node_type, region, start_us, end_us, node_hours, max_pricing_units,
                                  max_workers, dbus, dbu_usd FROM ao_dbu_m""",
        "vm_cost": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, driver_node_type, worker_node_type,
                       region, is_spot, node_hours, dbus, dbu_usd, vm_on_demand_usd, vm_spot_usd, total_usd
                       FROM ao_costs_m""",
        "vm_cost_region": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, customer_name,
                              driver_node_type, worker_node_type, region, node_hours, dbus, dbu_usd, vm_usd, total_usd
                              FROM ao_costs_r""",
        "on_demand_usage": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, region, start_us,
                               end_autostop_us, max_pricing_units, max_workers, dbus FROM od_usage_m""",
        "dbu_cost_on_demand": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, region, start_us,
                                  end_autostop_us, dbus, usd_per_dbu, on_demand_usd FROM od_costs_m""",
        "always_on_by_endpoint": f"""SELECT endpoint_id, {se('total_usd')} AS always_on_usd, {se('dbu_usd')} AS dbu_usd,
                                     {se('vm_on_demand_usd')} AS vm_on_demand_usd, {se('vm_spot_usd')} AS vm_spot_usd
                                     FROM ao_costs_m GROUP BY endpoint_id""",
        "on_demand_by_endpoint": f"""SELECT endpoint_id, {se('on_demand_usd')} AS on_demand_usd
                                     FROM od_costs_m GROUP BY endpoint_id""",
        "always_on_by_customer": "SELECT * FROM ao_by_cust",
        "on_demand_by_customer": "SELECT * FROM od_by_cust",
        "grand_totals": f"""SELECT {se('a')} AS always_on_usd, {se('d')} AS dbu_usd, {se('o')} AS vm_on_demand_usd,
                                   {se('s')} AS vm_spot_usd, {se('n')} AS on_demand_usd
                            FROM (SELECT total_usd AS a, dbu_usd AS d, vm_on_demand_usd AS o, vm_spot_usd AS s,
                                         CAST(NULL AS DOUBLE) AS n FROM ao_costs_m
                                  UNION ALL
                                  SELECT NULL, NULL, NULL, NULL, on_demand_usd FROM od_costs_m) AS u""",
        "cost_comparison": _comparison("od_by_cust"),
        "attributed_statements_bucketed": "SELECT * FROM att_m",
        "attributed_statements_region_bucketed": "SELECT * FROM att_r",
        "sessions_day_by_day": f"""SELECT {slice_cols}, {_DATE_CAST}, start_us, end_us, end_autostop_us, statements
                                   FROM sessions_m""",
        "cost_totals": _totals("m", {"all": "", "endpoint": "endpoint_id", "cluster_day": "date, cluster_id"},
                               "vm_on_demand_usd + vm_spot_usd", True),
        "cost_totals_region": _totals("r", {"all": "", "endpoint": "endpoint_id", "customer": "customer_name",
                                            "cluster_day": "date, cluster_id"}, "vm_usd", False),
        "vm_cost_price_periods": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, driver_node_type,
                                     worker_node_type, region, is_spot, node_hours, vm_on_demand_usd, vm_spot_usd, total_usd
                                     FROM ao_costs_dated""",
        "dbu_cost_price_periods": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, region, start_us,
                                      end_autostop_us, dbus, usd_per_dbu, on_demand_usd FROM od_costs_dated""",
        "cost_comparison_global": _comparison("od_by_cust_global"),
        "on_demand_usage_global": f"""SELECT {_DATE_CAST}, cluster_id, endpoint_id, workspace_id, region, start_us,
                                      end_autostop_us, max_pricing_units, max_workers, dbus FROM od_usage_mg""",
        "cost_comparison_daily": f"""
            SELECT {_DATE_CAST}, cluster_id, always_on_usd, always_on_dbu_usd, always_on_vm_usd, on_demand_dbus,
                   on_demand_usd, on_demand_usd - always_on_usd AS variation_usd
            FROM (SELECT date, cluster_id, {se('total_usd')} AS always_on_usd, {se('dbu_usd')} AS always_on_dbu_usd,
                         {se('vm_on_demand_usd + vm_spot_usd')} AS always_on_vm_usd
                  FROM ao_costs_m GROUP BY date, cluster_id) a
            JOIN (SELECT date AS d2, cluster_id AS c2, {se('dbus')} AS on_demand_dbus, {se('on_demand_usd')} AS on_demand_usd
                  FROM od_costs_m GROUP BY date, cluster_id) o ON a.date = o.d2 AND a.cluster_id = o.c2""",
    }
    for key, src, end in (("timeline_segments", "sessions_m", "end_autostop_us"),
                          ("timeline_segments_statements", "att_m", "end_us"),
                          ("timeline_segments_always_on", "ao_costs_m", "end_us")):
        q[key] = f"""
            SELECT {_DATE_CAST}, endpoint_id, cluster_id, start_offset_us, end_offset_us,
                   strftime(make_timestamp(start_offset_us), '%Y-%m-%dT%H:%M:%S') AS start_display,
                   strftime(make_timestamp(end_offset_us), '%Y-%m-%dT%H:%M:%S') AS end_display
            FROM (SELECT date, endpoint_id, cluster_id,
                         start_us - (date - DATE '1970-01-01') * {DAY} AS start_offset_us,
                         end_us - (date - DATE '1970-01-01') * {DAY} AS end_offset_us
                  FROM ({_slices(f"(SELECT endpoint_id, cluster_id, start_us, {end} AS end_us FROM {src}) AS src",
                                 "endpoint_id, cluster_id")}) AS sl) AS t"""
    return q


def _with_ctes(body: str, ctes: dict[str, str]) -> str:
    """Prefix ``body`` with the CTEs it needs (transitively), in definition order."""
    names = list(ctes)
    needed: set[str] = set()
    stack = [body]
    while stack:
        text = stack.pop()
        for name in names:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                stack.append(ctes[name])
    parts = [f"{n} AS ({ctes[n]}\n)" for n in names if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _check_view(body: str) -> str:
    """Nullable worker counts as double, as in the Spark check views."""
    if "max_workers" not in body:
        return body
    return f"SELECT * REPLACE (CAST(max_workers AS DOUBLE) AS max_workers) FROM ({body}) AS q"


def oracle_sql() -> dict[str, str]:
    ctes = _ctes()
    return {k: _with_ctes(_check_view(v), ctes) for k, v in _queries().items()}
