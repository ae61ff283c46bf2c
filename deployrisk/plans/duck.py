"""The same derived tables in plain SQL, for checking results against another engine."""

from __future__ import annotations

TENANT = "CASE WHEN {0} = 0 THEN 'demo' ELSE 't' || lpad(CAST({0} AS VARCHAR), 2, '0') END"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "heads": ((), f"""
        SELECT {TENANT.format('c_nationkey')} AS tenant_id,
               'b' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS build_id,
               CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 24) * 3600 AS timestamp,
               CAST(o_orderkey % 24 AS INTEGER) AS hour_of_day,
               CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS is_hotfix,
               lower(c_mktsegment) AS job_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Hotfix/issue-' || o_orderkey
                    WHEN '2-HIGH' THEN 'fix/URGENT-' || o_orderkey
                    WHEN '3-MEDIUM' THEN 'feature/page-' || o_orderkey
                    WHEN '5-LOW' THEN 'release/2.' || (o_orderkey % 7) || '-patch' ELSE '' END AS branch_name,
               ' c' || o_custkey || ' ' AS triggered_by,
               'c' || o_custkey AS actor,
               CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS label,
               o_orderkey AS order_key, o_totalprice AS total_price,
               CAST(o_orderdate AS DATE) AS order_date
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "order_lines": ((), """
        SELECT l_orderkey, CAST(sum(l_quantity) AS INTEGER) AS diff_size,
               CAST(count(*) AS INTEGER) AS files_changed,
               round(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS recent_failure_rate,
               round(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 4) AS test_pass_rate,
               max(CAST(l_shipdate AS DATE)) AS last_ship,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_price
        FROM lineitem GROUP BY l_orderkey"""),
    "builds": (("heads", "order_lines"), """
        SELECT tenant_id, build_id, timestamp, diff_size, files_changed, hour_of_day, day_of_week,
               recent_failure_rate, test_pass_rate, is_hotfix, CAST(NULL AS INTEGER) AS deployer_exp,
               CASE WHEN last_ship IS NOT NULL THEN greatest(0, date_diff('day', order_date, last_ship)) / 32.0::DOUBLE END AS days_since_deploy,
               round(line_price / total_price - 1, 4) AS build_time_delta,
               job_name, branch_name, triggered_by, actor, label
        FROM heads LEFT JOIN order_lines ON order_key = l_orderkey"""),
    "tenants": ((), f"""
        SELECT {TENANT.format('n_nationkey')} AS tenant_id,
               '  Ops@' || n_name || '.example ' AS email,
               CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 30 + n_nationkey % 5 * 5 END AS threshold_yellow,
               CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 60 + n_nationkey % 3 * 10 END AS threshold_red,
               CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'https://hooks.example/' || n_nationkey END AS slack_webhook,
               sha256('key-' || n_nationkey) AS api_key_hash,
               CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'github' END AS ci_platform,
               CASE WHEN n_nationkey % 6 = 1 THEN 'tenant' ELSE 'base' END AS model_phase
        FROM nation"""),
    "ci_runs": ((), """
        SELECT 'job' || user_id AS job,
               CASE user_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'jenkins' ELSE 'bitbucket' END AS platform,
               event_id AS run_id, event_type,
               CASE WHEN event_type IN ('error', 'signup') THEN false
                    WHEN event_type = 'purchase' THEN NULL ELSE true END AS succeeded,
               CASE WHEN event_type = 'purchase' THEN NULL ELSE value END AS duration_secs,
               epoch_us(ts) / 1e6 AS finished_at
        FROM events"""),
    "probes": ((), """
        SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS deploy_id, event_id AS probe_id, ts,
               CASE WHEN hour(ts) < 8 THEN 'baseline' ELSE 'watch' END AS phase,
               CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 302
                    WHEN event_type = 'purchase' AND value > 150 THEN NULL ELSE 200 END AS status,
               value AS latency_ms
        FROM events"""),
    "label_events": ((), """
        SELECT 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS build_id, event_id AS seq,
               CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS event_ts,
               CASE event_type WHEN 'error' THEN ' Sentinel_Degraded ' WHEN 'view' THEN 'success'
                    WHEN 'click' THEN 'failure' WHEN 'signup' THEN '' ELSE 'pager-duty' END AS raw_source,
               CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS label,
               CASE event_type WHEN 'error' THEN 'sentinel_degraded' WHEN 'view' THEN 'ci_success'
                    WHEN 'click' THEN 'ci_failure' WHEN 'signup' THEN 'manual' ELSE 'pager-duty' END AS label_source,
               CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'view' THEN 0.6::DOUBLE
                    WHEN 'click' THEN 0.7::DOUBLE WHEN 'signup' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS sample_weight,
               event_type = 'error' AS observed
        FROM events"""),
    "access_log": ((), """
        SELECT ts, 'api-' || user_id AS api_key, '10.0.0.' || (user_id % 250) || ', 172.16.0.1' AS forwarded_for,
               event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
               value / 100 AS seconds, event_id
        FROM events"""),
    "commits": (("heads",), """
        SELECT build_id AS commit_id, tenant_id AS project, label = 1 AS buggy,
               coalesce(is_hotfix, 0) = 1 AS fix, year(order_date) AS year, timestamp AS author_date,
               CAST(order_key % 700 AS INTEGER) AS la, CAST(order_key % 90 AS INTEGER) AS ld,
               CAST(order_key % 12 + 1 AS INTEGER) AS nf, CAST(order_key % 300 AS INTEGER) AS aexp,
               (order_key % 160) / 8.0::DOUBLE AS age
        FROM heads"""),
    # builds with every unknown filled by the fixed medians, and the rule's probability
    "filled": (("builds",), """
        SELECT tenant_id, build_id, timestamp, job_name, branch_name, actor, label,
               coalesce(diff_size, 105) AS diff_size, coalesce(files_changed, 4) AS files_changed,
               hour_of_day, day_of_week,
               coalesce(recent_failure_rate, 0.261::DOUBLE) AS recent_failure_rate,
               coalesce(test_pass_rate, 0.819::DOUBLE) AS test_pass_rate,
               coalesce(is_hotfix, 0) AS is_hotfix, coalesce(deployer_exp, 27) AS deployer_exp,
               coalesce(days_since_deploy, 2.7::DOUBLE) AS days_since_deploy,
               coalesce(build_time_delta, 0.011::DOUBLE) AS build_time_delta
        FROM builds"""),
    "scored": (("filled",), """
        SELECT *, CAST(round_even(p * 100, 0) AS INTEGER) AS score FROM (
        SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE,
            CASE WHEN recent_failure_rate > 0.20::DOUBLE THEN 0.27::DOUBLE WHEN recent_failure_rate > 0.10::DOUBLE THEN 0.15::DOUBLE ELSE 0 END
          + CASE WHEN is_hotfix = 1 THEN 0.22::DOUBLE ELSE 0 END
          + CASE WHEN test_pass_rate < 0.60::DOUBLE THEN 0.20::DOUBLE WHEN test_pass_rate < 0.75::DOUBLE THEN 0.10::DOUBLE ELSE 0 END
          + CASE WHEN diff_size > 400 THEN 0.18::DOUBLE WHEN diff_size > 150 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN hour_of_day BETWEEN 16 AND 19 THEN 0.12::DOUBLE ELSE 0 END
          + CASE WHEN hour_of_day >= 22 OR hour_of_day <= 5 THEN 0.10::DOUBLE ELSE 0 END
          + CASE WHEN day_of_week = 4 THEN 0.10::DOUBLE WHEN day_of_week >= 5 THEN 0.07::DOUBLE ELSE 0 END
          + CASE WHEN days_since_deploy > 14 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN days_since_deploy > 30 THEN 0.05::DOUBLE ELSE 0 END
          + CASE WHEN deployer_exp <= 5 THEN 0.05::DOUBLE ELSE 0 END
          + CASE WHEN files_changed > 20 THEN 0.03::DOUBLE ELSE 0 END
          + CASE WHEN day_of_week = 4 AND diff_size > 200 THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN is_hotfix = 1 AND hour_of_day >= 16 THEN 0.06::DOUBLE ELSE 0 END
          + CASE WHEN recent_failure_rate > 0.15::DOUBLE AND test_pass_rate < 0.80::DOUBLE THEN 0.06::DOUBLE ELSE 0 END
          + CASE WHEN diff_size > 300 AND test_pass_rate < 0.85::DOUBLE THEN 0.06::DOUBLE ELSE 0 END)) AS p
        FROM filled)"""),
    "predictions": (("scored",), """
        SELECT tenant_id, build_id, timestamp, p, label AS y FROM scored WHERE label IN (0, 1)"""),
}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views, and all they depend on, as a WITH clause."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dependency in VIEWS[name][0]:
            add(dependency)
        if name not in needed:
            needed.append(name)

    for view in views:
        add(view)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in needed)
    body = body.strip()
    if not ctes:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"
