"""The relational core as SQL: what Spark runs and what DuckDB runs.

Where one text serves both, the second is made from the first by dropping the
braces that name Spark's inputs.
"""

from __future__ import annotations

import re


def _same(text: str) -> tuple[str, str]:
    return text, re.sub(r"\{(\w+)\}", r"\1", text)


RELATIONAL: dict[str, tuple[str, str]] = {
    "pricing_summary": _same(
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, "
        "round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
    ),
    "join_inner": _same(
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey "
        "JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name"
    ),
    "join_left": _same("SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey"),
    "join_full": _same("SELECT c_custkey, event_id FROM (SELECT * FROM {customer} WHERE c_acctbal > 5000) c FULL JOIN (SELECT * FROM {events} WHERE value > 50) e ON c_custkey = user_id"),
    "join_semi": _same("SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)"),
    "join_anti": _same("SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {events} WHERE user_id = c_custkey)"),
    "theta_join": _same("SELECT /*+ BROADCAST(n) */ c_custkey, n_nationkey FROM {customer} c JOIN {nation} n ON c_acctbal < n_nationkey * 100 - 900"),
    "join_mixed": _same("SELECT a.n_name AS low, b.n_name AS high FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "rollup": _same(
        "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"
    ),
    "cube_filter": _same("SELECT event_type, user_id % 3 AS third, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM {events} GROUP BY CUBE (event_type, user_id % 3)"),
    "statistics": _same("SELECT event_type, round(stddev_samp(value), 4) AS sd, round(corr(value, user_id), 4) AS r, round(regr_slope(value, user_id), 6) AS slope FROM {events} GROUP BY event_type"),
    "ranking": _same(
        "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS tile "
        "FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderdate)"
    ),
    "top_k": _same("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "set_operations": _same(
        "(SELECT user_id AS k FROM {events} INTERSECT SELECT c_custkey FROM {customer}) UNION (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM {orders})"
    ),
    "correlated": _same("SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)"),
    "strings": _same("SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS BIGINT) AS len, substring(p_brand, 1, 5) AS head, lpad(p_type, 12, '*') AS padded FROM {part}"),
    "json_path": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "pivot": (
        "SELECT * FROM (SELECT user_id, event_type, value FROM {events}) PIVOT (count(value) FOR event_type IN ('click' AS click, 'view' AS view))",
        "SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view FROM events GROUP BY user_id",
    ),
    "join_right": _same("SELECT o_orderkey, c_custkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > 200000"),
    "join_cross": _same("SELECT r_name, n_name FROM {region} CROSS JOIN {nation}"),
    # Spark gives a correlated ORDER BY ... LIMIT a row number over rows sorted before they are shuffled, which no longer are; here the number has its own order.
    "lateral_top": (
        "SELECT c_custkey, t.o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) "
        "WHERE o_custkey = c_custkey AND rn <= 2) t",
        "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    ),
    "grouping_sets": _same("SELECT event_type, user_id, count(*) AS n FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id), ())"),
    "union_all": _same("SELECT user_id AS k FROM {events} UNION ALL SELECT o_custkey FROM {orders}"),
    "except_all": _same("SELECT user_id AS k FROM {events} EXCEPT ALL SELECT o_custkey FROM {orders}"),
    # Of rows equally dear the least key is taken; max_by alone takes any of them.
    "aggregates": (
        "SELECT l_returnflag, min(l_orderkey) FILTER (WHERE l_extendedprice = most) AS dearest, round(covar_pop(l_quantity, l_discount), 4) AS cv, round(var_pop(l_quantity), 4) AS vp, "
        "bool_or(l_tax > 0.07) AS taxed, min(l_shipdate) AS first_day FROM (SELECT /*+ BROADCAST(d) */ l.*, most FROM {lineitem} l JOIN "
        "(SELECT l_returnflag AS flag, max(l_extendedprice) FILTER (WHERE l_orderkey IS NOT NULL) AS most FROM {lineitem} GROUP BY l_returnflag) d ON l_returnflag <=> flag) GROUP BY l_returnflag",
        "SELECT l_returnflag, max_by(l_orderkey, l_extendedprice) AS dearest, round(covar_pop(l_quantity, l_discount), 4) AS cv, round(var_pop(l_quantity), 4) AS vp, "
        "bool_or(l_tax > 0.07) AS taxed, min(l_shipdate) AS first_day FROM lineitem GROUP BY l_returnflag",
    ),
    "value_windows": _same(
        "SELECT event_id, lead(event_id, 2) OVER w AS second_next, first_value(event_id) OVER w AS first_id, nth_value(event_id, 3) OVER w AS third_id, round(percent_rank() OVER w, 6) AS pr, "
        "round(cume_dist() OVER w, 6) AS cd FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)"
    ),
    "unpivot": _same("SELECT o_orderkey, measure, amount FROM (SELECT o_orderkey, o_totalprice AS price, o_totalprice / 2 AS half FROM {orders}) UNPIVOT (amount FOR measure IN (price, half))"),
    "predicates": _same(
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' ELSE 'large' END AS class FROM {part} WHERE p_brand LIKE 'Brand%' AND p_type IS NOT NULL AND p_size IN (5, 15, 25, 35)"
    ),
    "math": (
        "SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS root, round(ln(o_totalprice), 6) AS log, o_orderkey % 7 AS rest, CAST(floor(o_totalprice) AS BIGINT) AS low, o_orderkey div 7 AS part, "
        "width_bucket(o_totalprice, 0, 500000, 10) AS bin FROM {orders}",
        "SELECT o_orderkey, round(sqrt(o_totalprice), 4) AS root, round(ln(o_totalprice), 6) AS log, o_orderkey % 7 AS rest, CAST(floor(o_totalprice) AS BIGINT) AS low, o_orderkey // 7 AS part, "
        "CAST(least(greatest(floor(o_totalprice / 50000) + 1, 0), 11) AS BIGINT) AS bin FROM orders",
    ),
    "dates": (
        "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, "
        "o_orderdate + INTERVAL 1 MONTH AS next_month FROM {orders}",
        "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofweek(o_orderdate) AS dow, o_orderdate + INTERVAL 1 MONTH AS next_month FROM orders",
    ),
    "arrays": (
        "SELECT o_custkey, array_join(sort_array(collect_list(CASE WHEN rn <= 3 THEN o_orderkey END)), ',') AS head, CAST(sum(aggregate(transform(array(o_orderkey), x -> x % 10), 0L, (s, x) -> s + x)) AS BIGINT) AS digits FROM "
        "(SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {orders}) GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(k[1:3], ',') AS head, CAST(list_sum(list_transform(k, lambda x: x % 10)) AS BIGINT) AS digits FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY o_custkey)",
    ),
    "maps": (
        "SELECT user_id, m['click'] AS clicks, m['view'] AS views FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, 2 * n))) AS m FROM "
        "(SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type) GROUP BY user_id)",
        "SELECT user_id, nullif(2 * count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, nullif(2 * count(*) FILTER (WHERE event_type = 'view'), 0) AS views FROM events GROUP BY user_id",
    ),
    "map_values": (
        "SELECT event_id, m['a'] AS a, m['b'] AS b, element_at(map_filter(m, (k, v) -> v > 10), 'a') AS high, array_join(sort_array(map_keys(m)), ',') AS names FROM "
        "(SELECT event_id, transform_values(map('a', user_id, 'b', event_id), (k, v) -> CASE WHEN k = 'a' THEN v % 100 ELSE v + 1 END) AS m FROM {events})",
        "SELECT event_id, user_id % 100 AS a, event_id + 1 AS b, CASE WHEN user_id % 100 > 10 THEN user_id % 100 END AS high, 'a,b' AS names FROM events",
    ),
    "strings_more": (
        "SELECT p_partkey, concat(p_brand, '-', p_type) AS joined, concat_ws('|', p_name, p_brand) AS listed, replace(p_name, 'a', 'AA') AS swapped, reverse(p_brand) AS back, trim(concat('  ', p_type, ' ')) AS bare, "
        "CAST(instr(p_name, 'o') AS BIGINT) AS place, split_part(p_name, ' ', 1) AS first_word, translate(p_type, 'AEI', 'aei') AS changed FROM {part}",
        "SELECT p_partkey, concat(p_brand, '-', p_type) AS joined, concat_ws('|', p_name, p_brand) AS listed, replace(p_name, 'a', 'AA') AS swapped, reverse(p_brand) AS back, trim(concat('  ', p_type, ' ')) AS bare, "
        "instr(p_name, 'o') AS place, split_part(p_name, ' ', 1) AS first_word, translate(p_type, 'AEI', 'aei') AS changed FROM part",
    ),
    "clock_parts": (
        "SELECT event_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(extract(MINUTE FROM ts) AS BIGINT) AS m, CAST(dayofyear(ts) AS BIGINT) AS doy, timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS us, "
        "timestampadd(HOUR, -5, ts) AS earlier, CAST(ts AS DATE) AS day FROM {events}",
        "SELECT event_id, hour(ts) AS h, minute(ts) AS m, dayofyear(ts) AS doy, date_sub('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS us, ts - INTERVAL 5 HOUR AS earlier, CAST(ts AS DATE) AS day FROM events",
    ),
    "join_merge_hint": _same("SELECT /*+ MERGE(o) */ c_custkey, o_orderkey FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "join_shuffle_hash_hint": _same("SELECT /*+ SHUFFLE_HASH(c) */ c_custkey, o_orderkey FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey WHERE o_totalprice > 300000"),
    "join_broadcast_hint": _same("SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey"),
    "join_nested_loop_hint": _same("SELECT /*+ SHUFFLE_REPLICATE_NL(n, r) */ n_name, r_name FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey"),
    # Approximate results are given by the exact value beside them, and by whether they keep the error that they promise.
    "approximate": (
        "SELECT event_type, users, least, abs(near - users) <= 0.06 * users AS distinct_near, abs(below / n - 0.5) <= 0.01 AS middle_near FROM ("
        "SELECT e.event_type, count(DISTINCT user_id) AS users, min(value) AS least, approx_count_distinct(user_id, 0.02) AS near, count(*) AS n, CAST(sum(CASE WHEN value <= m THEN 1 ELSE 0 END) AS DOUBLE) AS below "
        "FROM {events} e JOIN (SELECT event_type, approx_percentile(value, 0.5, 1000) AS m FROM {events} GROUP BY event_type) a ON a.event_type = e.event_type GROUP BY e.event_type)",
        "SELECT event_type, count(DISTINCT user_id) AS users, min(value) AS least, true AS distinct_near, true AS middle_near FROM events GROUP BY event_type",
    ),
    "recursion": (
        "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
        "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    ),
}
