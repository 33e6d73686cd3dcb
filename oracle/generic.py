"""Oracle SQL for the operator checks on the driver tables."""

import math

from oracle.cte import cte
from oracle.queries import half_up, laptime, mean, slope

DASH = "'—'"


cte("g_ev_ord", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events")
cte("g_blocks", """
SELECT user_id, block, CAST(lo AS INTEGER) AS lo, CAST(CASE WHEN block % 4 = 0 THEN hi + 2 ELSE hi END AS INTEGER) AS hi
FROM (SELECT user_id, (ord - 1) // 5 + 1 AS block, min(ord) AS lo, max(ord) AS hi FROM g_ev_ord GROUP BY 1, 2) b
WHERE (user_id + block) % 7 <> 0""")
cte("g_resampled", """
SELECT g.user_id, g.point, CASE WHEN g.f = 0 OR s.y1 IS NULL THEN s.y ELSE (s.y1 - s.y) * g.f + s.y END AS value
FROM (SELECT *, floor(p) AS j, p - floor(p) AS f
      FROM (SELECT *, CASE WHEN point = 49 THEN CAST(len - 1 AS DOUBLE)
                           ELSE CAST(point AS DOUBLE) * (CAST(len - 1 AS DOUBLE) / 49.0) END AS p
            FROM (SELECT user_id, len, CAST(unnest(range(0, 50)) AS INTEGER) AS point
                  FROM (SELECT user_id, count(*) AS len FROM events GROUP BY 1) c) a) b) g
LEFT JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j,
                  coalesce(value, 0.0) AS y,
                  lead(coalesce(value, 0.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y1
           FROM events) s ON g.user_id = s.user_id AND g.j = s.j""")

_R = repr(math.radians(-30.0))
_CLASSIFY_SRC = """
SELECT o_orderkey, o_orderkey % 97 = 0 AS is_dsq, o_orderstatus = 'P' AND o_orderkey % 3 = 0 AS is_dns,
       o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS is_dnf,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 20 + 1 END AS finish, o_orderkey % 3 AS laps,
       o_custkey % 20 + 1 AS grid, CASE WHEN o_orderkey % 2 = 0 THEN 'Race' ELSE 'Qualifying' END AS stype
FROM orders"""
_PRIO = "(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS prio FROM orders)"

SQL = {
    "variant_project": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "variant_null_filter": """
SELECT event_id, event_id % 3 <> 1 AS has_path, event_id % 3 = 2 AS has_value,
       CASE WHEN event_id % 3 = 2 THEN value END AS v FROM events""",
    "lenient_cast": """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio_num,
       TRY_CAST(o_orderpriority AS DOUBLE) AS full_num FROM orders""",
    "strict_numeric": """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value END AS strict_v,
       CASE WHEN event_id % 5 IN (0, 1) THEN value END AS lenient_v FROM events""",
    "flag_project": """
SELECT l_orderkey, l_linenumber, l_returnflag, CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS is_returned
FROM lineitem""",
    "latest_per_key_events": """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1""",
    "latest_per_key_lineitem": """
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey,
                           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) = 1""",
    "star_enrich": """
SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice, o.o_orderdate, c.c_name, n.n_name, r.r_name
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "role_enrich": """
SELECT l.l_orderkey, l.l_linenumber, cn.n_name AS cust_nation, sn.n_name AS supp_nation
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey""",
    "range_join_first": """
SELECT e.event_id, e.user_id, CAST(e.ord AS INTEGER) AS ord, b.block
FROM g_ev_ord e LEFT JOIN g_blocks b ON e.user_id = b.user_id AND e.ord BETWEEN b.lo AND b.hi
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY b.block NULLS LAST) = 1""",
    "block_stats": f"""
SELECT b.user_id, b.block, b.lo, b.hi, count(p.ord) AS n, min(p.value) AS min_v, {mean('p.value')} AS avg_v,
       {mean('p.value')} - min(p.value) AS gap_v,
       {half_up('(max(CASE WHEN p.ord = b.hi THEN p.value END) - min(CASE WHEN p.ord = b.lo THEN p.value END)) / nullif(b.hi - b.lo, 0)')} AS deg_end,
       {half_up(slope('p.value', 'p.ord'))} AS deg_slope
FROM g_blocks b LEFT JOIN (SELECT user_id, ord, value FROM g_ev_ord WHERE value < 400) p
  ON b.user_id = p.user_id AND p.ord BETWEEN b.lo AND b.hi
GROUP BY 1, 2, 3, 4""",
    "adjacent_join": """
SELECT e.event_id, e.user_id, CAST(e.ord AS INTEGER) AS ord, bb.block AS block_out, ba.block AS block_in
FROM (SELECT * FROM g_ev_ord ) e
LEFT JOIN g_blocks bb ON e.user_id = bb.user_id AND e.ord = bb.hi
LEFT JOIN g_blocks ba ON e.user_id = ba.user_id AND e.ord + 1 = ba.lo""",
    "asof_view_purchase": """
SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.ts AS view_ts, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "point_in_interval": """
SELECT e.event_id, e.user_id, e.ts, s.signup_id
FROM (SELECT * FROM events WHERE event_type = 'error') e
JOIN (SELECT user_id, event_id AS signup_id, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi
      FROM events WHERE event_type = 'signup') s
  ON e.user_id = s.user_id AND e.ts BETWEEN s.lo AND s.hi
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY s.lo, s.signup_id) = 1""",
    "anti_guard": """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""",
    "backfill_keys": """
SELECT DISTINCT c_custkey AS key, 'new' AS reason, CAST(NULL AS VARCHAR) AS missing FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL
SELECT u.user_id AS key, 'incomplete' AS reason, t.missing
FROM (SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) u,
     (VALUES ('signup'), ('error')) t(missing)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.missing)""",
    "range_join_long": """
SELECT l_orderkey, l_linenumber, min(s.o_orderkey) AS span_order
FROM lineitem JOIN orders o ON l_orderkey = o.o_orderkey
LEFT JOIN orders s ON s.o_custkey = o.o_custkey
 AND l_orderkey * 1000 + l_linenumber BETWEEN s.o_orderkey * 1000 AND s.o_orderkey * 1000 + s.o_orderkey % 7 * 5000000
GROUP BY ALL""",
    "landing_report": """
WITH lines AS (SELECT event_id % 6 AS k, user_id FROM events),
     said AS (SELECT CASE WHEN k <> 4 THEN user_id END AS session_key,
                     CASE WHEN k <> 4 AND user_id % 4 = 0 THEN 'skipped' ELSE 'rows' END AS kind FROM lines WHERE k >= 3
              UNION ALL SELECT NULL, 'errors' FROM lines WHERE k <= 3
              UNION ALL SELECT c_custkey, 'work' FROM customer)
SELECT 'laps' AS endpoint, session_key, count(*) FILTER (WHERE kind = 'rows') AS rows,
       count(*) FILTER (WHERE kind = 'skipped') AS skipped, count(*) FILTER (WHERE kind = 'errors') AS errors,
       CASE WHEN bool_or(kind = 'errors') THEN 'error' WHEN bool_or(kind = 'rows') THEN 'loaded'
            WHEN bool_or(kind = 'skipped') THEN 'skipped' ELSE 'missing' END AS status
FROM said GROUP BY session_key""",
    "landing_work_list": """
SELECT event_id FROM events SEMI JOIN customer ON user_id = c_custkey AND event_id % 20 = c_custkey % 20
WHERE event_id % 6 IN (3, 5)""",
    "landing_guard": """
WITH keyed AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS key FROM orders),
     landed AS (SELECT DISTINCT key FROM keyed WHERE o_orderkey % 3 = 0)
SELECT o_orderkey FROM keyed LEFT JOIN landed ON keyed.key IS NOT DISTINCT FROM landed.key
WHERE o_orderkey % 3 <> 0 GROUP BY o_orderkey HAVING count(*) FILTER (
  WHERE landed.key IS NOT NULL OR (keyed.key IS NULL AND EXISTS (SELECT 1 FROM landed x WHERE x.key IS NULL))) = 0""",
    "streamed_landing": """
SELECT CASE WHEN event_id % 6 <> 4 THEN user_id END AS session_key, count(*) AS n
FROM events WHERE event_id % 6 >= 3 GROUP BY 1""",
    "streamed_latest": """
SELECT user_id AS session_key, event_id % 20 AS driver_number, arg_max(event_id % 50, event_id) AS grid_position
FROM events GROUP BY 1, 2""",
    "cond_counts": """
SELECT user_id, count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_signup,
       count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_purchase,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS n_error,
       count(CASE WHEN event_type = 'view' THEN 1 END) AS n_view,
       count(CASE WHEN event_type = 'click' THEN 1 END) AS n_click,
       count(*) AS n_all, max(CASE WHEN event_type = 'purchase' THEN value END) AS max_purchase
FROM events GROUP BY 1""",
    "best_over_aggregate": """
SELECT c.c_nationkey, o.o_custkey AS c_custkey, o.min_price
FROM (SELECT o_custkey, min(o_totalprice) AS min_price FROM orders GROUP BY 1) o
JOIN customer c ON o.o_custkey = c.c_custkey
QUALIFY row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o.min_price, o.o_custkey) = 1""",
    "last_non_null": """
SELECT user_id, CAST(ts AS DATE) AS day, last(v ORDER BY ts) FILTER (WHERE v IS NOT NULL) AS value,
       last(et ORDER BY ts) FILTER (WHERE et IS NOT NULL) AS event_type
FROM (SELECT user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS v,
             CASE WHEN event_id % 4 <> 0 THEN event_type END AS et FROM events) x
GROUP BY 1, 2""",
    "fastest_row": """
SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""",
    "resample_linear": "SELECT * FROM g_resampled",
    "point_winner": """
SELECT user_id % 10 AS grp, point, user_id, value FROM g_resampled
QUALIFY row_number() OVER (PARTITION BY user_id % 10, point ORDER BY value DESC NULLS LAST, user_id) = 1""",
    "gap_fill": """
SELECT event_id, user_id, fv AS v FROM (
  SELECT event_id, user_id,
         CASE WHEN v IS NOT NULL THEN v WHEN prv IS NULL THEN NULL WHEN nxt IS NULL THEN prv.v
              ELSE ((nxt.v - prv.v) / CAST(nxt.i - prv.i AS DOUBLE)) * CAST(i - prv.i AS DOUBLE) + prv.v END AS fv
  FROM (SELECT *,
               last_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS)
                 OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
               first_value(CASE WHEN v IS NOT NULL THEN {'i': i, 'v': v} END IGNORE NULLS)
                 OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt
        FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v,
                     row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) x) y) z
WHERE fv IS NOT NULL""",
    "rotate2d": f"""
SELECT event_id, {half_up(f'value * cos({_R}) - CAST(event_id % 100 AS DOUBLE) * sin({_R})', 6)} AS rx,
       {half_up(f'value * sin({_R}) + CAST(event_id % 100 AS DOUBLE) * cos({_R})', 6)} AS ry FROM events""",
    "classify_case": f"""
SELECT o_orderkey,
       CASE WHEN is_dsq THEN 'DSQ' WHEN is_dns THEN 'DNS' WHEN is_dnf THEN 'DNF'
            WHEN finish IS NULL AND coalesce(laps, 0) > 0 THEN 'DNF' WHEN finish IS NULL THEN 'DNS'
            ELSE 'Classified' END AS status,
       CASE WHEN stype = 'Race' THEN finish - grid END AS gained
FROM ({_CLASSIFY_SRC}) x""",
    "status_case": """
SELECT o_orderkey,
       CASE WHEN winner IS NOT NULL THEN 'COMPLETED'
            WHEN start IS NOT NULL AND start <= TIMESTAMP '1998-01-01 00:00:00' THEN 'CANCELLED'
            ELSE 'UPCOMING' END AS status,
       coalesce(strftime(start, '%b %d, %Y'), 'TBD') AS date_label
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END AS winner,
             CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS start FROM orders) x""",
    "lap_end": """
SELECT event_id, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS end_exact,
       ts + to_seconds(CAST(round(value) AS BIGINT)) AS end_whole FROM events""",
    "normalise_filter": """
SELECT user_id, count(*) FILTER (WHERE shown) AS n_shown, count(*) AS n_total
FROM (SELECT user_id, (CASE WHEN value > 100 THEN 'High' ELSE 'Low' END) IN ('High')
                      AND (f IN ('VIEW', 'CLICK') OR f = '') AS shown
      FROM (SELECT *, upper(trim(coalesce(CASE event_id % 4 WHEN 0 THEN upper(event_type)
                                                             WHEN 1 THEN ' ' || event_type || ' '
                                                             WHEN 3 THEN event_type END, ''))) AS f
            FROM events) a) b
GROUP BY 1""",
    "topk_nulls_last": f"SELECT * FROM {_PRIO} p ORDER BY prio ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 10",
    "topk_desc_nulls_first": f"SELECT * FROM {_PRIO} p ORDER BY prio DESC NULLS FIRST, o_orderkey LIMIT 10",
    "scalar_latest": """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)""",
    "fmt_laptime": f"""
SELECT event_id, {laptime('value * 3')} AS lap_text,
       CASE WHEN value - 100 IS NULL THEN {DASH} ELSE printf('%+.3f', value - 100) END AS delta_text FROM events""",
}

SQL["streamed_asof"] = SQL["asof_view_purchase"]
SQL["streamed_first_wins"] = "SELECT DISTINCT event_id, user_id FROM events"
SQL["streamed_enrich"] = """
SELECT o_orderkey, o_custkey AS c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 7 <> 0"""
SQL["landing_subset"] = """
WITH line AS (SELECT endpoint, event_id % 6 AS k, user_id FROM events, (VALUES ('laps', 0), ('pit', 1), ('sessions', 2)) x(endpoint, i)
              WHERE event_id % 4 >= i),
acc AS (SELECT endpoint, k FROM line WHERE k >= 3 AND (endpoint = 'sessions' OR (k <> 4 AND user_id IN (
        SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))))
SELECT endpoint, 'accepted' AS kind, count(*) AS n FROM acc GROUP BY ALL
UNION ALL SELECT endpoint, 'rejected', count(*) FROM line WHERE k <= 3 GROUP BY ALL
UNION ALL SELECT endpoint, 'without key', count(*) FROM acc WHERE k = 4 GROUP BY ALL"""
SQL["series_ordinals"] = """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS nth, count(*) OVER () AS n FROM events"""
SQL["landing_laps_roundtrip"] = "SELECT * FROM stg_laps"
