"""The query catalogue: logical queries over the star model with DuckDB twins on the raw tables.

Doubles are rounded to 4 places and integers widened in both engines, so that results compare by value.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.plans.engine import Engine
from veridex.plans.model import SemanticModel, resolve_model


@lru_cache
def star_model() -> SemanticModel:
    return resolve_model(Path(__file__).with_name("star.yaml"))


def star(spark: SparkSession, sf_dir: str) -> Engine:
    """The star model over the Parquet tables of a directory."""
    return Engine(spark, star_model(), lambda source: spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def plain_types(df: DataFrame) -> DataFrame:
    """Doubles rounded to 4 places, integers and decimals without a fraction as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal") and not kind.endswith(",0)"):
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint") or kind.startswith("decimal"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def logical(sql: str):
    return lambda spark, sf_dir: plain_types(star(spark, sf_dir).sql(sql))


#: name -> (logical SQL, DuckDB SQL)
SQL: dict[str, tuple[str, str]] = {
    # projections
    "proj_dimension": ("SELECT DISTINCT return_flag, line_status FROM sales", "select distinct l_returnflag as return_flag, l_linestatus as line_status from lineitem"),
    "proj_alias": ("SELECT order_key AS id, priority AS p FROM orders", "select o_orderkey as id, o_orderpriority as p from orders"),
    "proj_plain": ("SELECT part_key, size, retail_price FROM parts", "select p_partkey as part_key, cast(p_size as bigint) as size, round(p_retailprice, 4) as retail_price from part"),
    "proj_computed": ("SELECT order_key, line_no, net FROM sales", "select l_orderkey as order_key, cast(l_linenumber as bigint) as line_no, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem"),
    "proj_computed_label": ("SELECT order_label FROM orders", "select o_orderkey || ' - ' || o_orderpriority as order_label from orders"),
    "proj_star": ("SELECT * FROM nations", "select cast(n_nationkey as bigint) as nation_key, cast(n_regionkey as bigint) as region_key, n_name as nation_name from nation"),
    "proj_case": ("SELECT part_key, CASE WHEN size > 25 THEN 'large' ELSE 'small' END AS class FROM parts", "select p_partkey as part_key, case when p_size > 25 then 'large' else 'small' end as class from part"),
    "proj_coalesce": ("SELECT cust_key, COALESCE(NULLIF(segment, 'BUILDING'), 'none') AS seg FROM customers", "select c_custkey as cust_key, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as seg from customer"),
    "proj_concat": ("SELECT brand || '/' || part_type AS kind, UPPER(part_name) AS title FROM parts", "select p_brand || '/' || p_type as kind, upper(p_name) as title from part"),
    "proj_arith": ("SELECT order_key, line_no, gross * (1 + tax) - quantity AS unit_gross FROM sales", "select l_orderkey as order_key, cast(l_linenumber as bigint) as line_no, round(l_extendedprice * (1 + l_tax) - l_quantity, 4) as unit_gross from lineitem"),
    "proj_cast": ("SELECT part_key, CAST(retail_price AS INTEGER) AS whole, CAST(size AS STRING) AS size_text FROM parts", "select p_partkey as part_key, cast(trunc(p_retailprice) as bigint) as whole, cast(p_size as varchar) as size_text from part"),
    "proj_literal": ("SELECT 1 AS one, 'x' AS letter, region_name FROM regions", "select cast(1 as bigint) as one, 'x' as letter, r_name as region_name from region"),
    "proj_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM activity", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events"),
    # filters
    "filter_and": ("SELECT order_key, line_no FROM sales WHERE quantity > 45 AND (return_flag = 'R' OR NOT line_status = 'O')", "select l_orderkey as order_key, cast(l_linenumber as bigint) as line_no from lineitem where l_quantity > 45 and (l_returnflag = 'R' or not l_linestatus = 'O')"),
    "filter_in": ("SELECT cust_key FROM customers WHERE segment IN ('BUILDING', 'MACHINERY')", "select c_custkey as cust_key from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "filter_between": ("SELECT part_key FROM parts WHERE size BETWEEN 10 AND 20", "select p_partkey as part_key from part where p_size between 10 and 20"),
    "filter_like": ("SELECT part_key, part_name FROM parts WHERE part_name LIKE '%ring%'", "select p_partkey as part_key, p_name as part_name from part where p_name like '%ring%'"),
    "filter_isnull": ("SELECT o.order_key FROM orders o LEFT JOIN sales s ON o.order_key = s.order_key WHERE s.line_no IS NULL", "select o_orderkey as order_key from orders left join lineitem on o_orderkey = l_orderkey where l_linenumber is null"),
    "filter_time": ("SELECT order_key FROM orders WHERE order_date >= TIMESTAMP_NTZ '1996-01-01' AND order_year < 1998", "select o_orderkey as order_key from orders where o_orderdate >= timestamp '1996-01-01' and year(o_orderdate) < 1998"),
    "distinct_dim": ("SELECT DISTINCT priority FROM orders", "select distinct o_orderpriority as priority from orders"),
    # joins
    "join_inner": ("SELECT o.order_key, c.segment FROM orders o JOIN customers c ON o.cust_key = c.cust_key", "select o_orderkey as order_key, c_mktsegment as segment from orders join customer on o_custkey = c_custkey"),
    "join_left": ("SELECT p.part_key, COUNT(s.line_no) AS n FROM parts p LEFT JOIN sales s ON p.part_key = s.part_key AND s.quantity > 49 GROUP BY p.part_key", "select p_partkey as part_key, count(l_linenumber) as n from part left join lineitem on p_partkey = l_partkey and l_quantity > 49 group by p_partkey"),
    "join_right": ("SELECT c.cust_key, o.order_key FROM orders o RIGHT JOIN customers c ON o.cust_key = c.cust_key AND o.total_price > 300000", "select c_custkey as cust_key, o_orderkey as order_key from orders right join customer on o_custkey = c_custkey and o_totalprice > 300000"),
    "join_full": ("SELECT a.k AS part_key, b.k AS big_key FROM (SELECT part_key AS k FROM parts WHERE size < 30) a FULL JOIN (SELECT part_key AS k FROM parts WHERE size > 20) b ON a.k = b.k", "select a.k as part_key, b.k as big_key from (select p_partkey as k from part where p_size < 30) a full join (select p_partkey as k from part where p_size > 20) b on a.k = b.k"),
    "join_cross_small": ("SELECT r.region_name, n.nation_name FROM regions r CROSS JOIN nations n", "select r_name as region_name, n_name as nation_name from region cross join nation"),
    "join_comma": ("SELECT n.nation_name, r.region_name FROM nations n, regions r WHERE n.region_key = r.region_key", "select n_name as nation_name, r_name as region_name from nation, region where n_regionkey = r_regionkey"),
    "join_theta": ("SELECT b.band, COUNT(*) AS n FROM sales s JOIN (VALUES ('low', 0, 10), ('mid', 10, 30), ('high', 30, 100)) AS b(band, lo, hi) ON s.quantity >= b.lo AND s.quantity < b.hi GROUP BY b.band", "select b.band, count(*) as n from lineitem join (values ('low', 0, 10), ('mid', 10, 30), ('high', 30, 100)) as b(band, lo, hi) on l_quantity >= b.lo and l_quantity < b.hi group by b.band"),
    "join_self": ("SELECT a.nation_name AS x, b.nation_name AS y FROM nations a JOIN nations b ON a.region_key = b.region_key AND a.nation_key < b.nation_key", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"),
    "join_using": ("SELECT cust_key, segment, order_key FROM orders JOIN customers USING (cust_key)", "select o_custkey as cust_key, c_mktsegment as segment, o_orderkey as order_key from orders join customer on o_custkey = c_custkey"),
    "join_three_way": ("SELECT p.brand, c.segment, net_revenue FROM sales s JOIN orders o ON s.order_key = o.order_key JOIN customers c ON o.cust_key = c.cust_key JOIN parts p ON s.part_key = p.part_key GROUP BY p.brand, c.segment", "select p_brand as brand, c_mktsegment as segment, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey group by all"),
    "join_derived": ("SELECT c.segment, SUM(t.n) AS orders_n FROM customers c JOIN (SELECT cust_key, COUNT(*) AS n FROM orders GROUP BY cust_key) t ON c.cust_key = t.cust_key GROUP BY c.segment", "select c_mktsegment as segment, cast(sum(n) as bigint) as orders_n from customer join (select o_custkey, count(*) as n from orders group by o_custkey) t on c_custkey = o_custkey group by all"),
    "join_cte": ("WITH big AS (SELECT order_key, total_price FROM orders WHERE total_price > 250000) SELECT s.return_flag, COUNT(*) AS n FROM sales s JOIN big b ON s.order_key = b.order_key GROUP BY s.return_flag", "with big as (select o_orderkey from orders where o_totalprice > 250000) select l_returnflag as return_flag, count(*) as n from lineitem join big on l_orderkey = o_orderkey group by all"),
    "semi_in": ("SELECT cust_key FROM customers WHERE cust_key IN (SELECT cust_key FROM orders WHERE total_price > 300000)", "select c_custkey as cust_key from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)"),
    "semi_exists": ("SELECT o.order_key FROM orders o WHERE EXISTS (SELECT 1 FROM sales s WHERE s.order_key = o.order_key AND s.quantity = 50)", "select o_orderkey as order_key from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50)"),
    "anti_not_exists": ("SELECT o.order_key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.order_key = o.order_key)", "select o_orderkey as order_key from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"),
    "anti_not_in": ("SELECT cust_key FROM customers WHERE cust_key NOT IN (SELECT cust_key FROM orders WHERE total_price > 250000)", "select c_custkey as cust_key from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)"),
    # metrics
    "metric_total": ("SELECT net_revenue, units FROM sales", "select round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue, round(sum(l_quantity), 4) as units from lineitem"),
    "metric_by_dim": ("SELECT return_flag, net_revenue FROM sales GROUP BY return_flag", "select l_returnflag as return_flag, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem group by all"),
    "metric_alias": ("SELECT s.return_flag AS flag, s.net_revenue AS revenue FROM sales s GROUP BY s.return_flag", "select l_returnflag as flag, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem group by all"),
    "metric_two_dims": ("SELECT return_flag, line_status, gross_revenue, line_count FROM sales GROUP BY return_flag, line_status", "select l_returnflag as return_flag, l_linestatus as line_status, round(sum(l_extendedprice), 4) as gross_revenue, count(*) as line_count from lineitem group by all"),
    "metric_having": ("SELECT part_key, net_revenue FROM sales s GROUP BY part_key HAVING net_revenue > 1500000", "select l_partkey as part_key, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem group by all having sum(l_extendedprice * (1 - l_discount)) > 1500000"),
    "metric_having_qualified": ("SELECT s.supp_key FROM sales s GROUP BY s.supp_key HAVING s.line_count > 600", "select l_suppkey as supp_key from lineitem group by all having count(*) > 600"),
    "metric_order": ("SELECT part_key FROM sales GROUP BY part_key ORDER BY net_revenue DESC, part_key LIMIT 7", "select l_partkey as part_key from lineitem group by all order by sum(l_extendedprice * (1 - l_discount)) desc, l_partkey limit 7"),
    "metric_expr": ("SELECT return_flag, ROUND(net_revenue / gross_revenue * 100, 2) AS kept_percent FROM sales GROUP BY return_flag", "select l_returnflag as return_flag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) * 100, 2) as kept_percent from lineitem group by all"),
    "metric_cross_dataset": ("SELECT s.return_flag, revenue_per_customer FROM sales s JOIN orders o ON s.order_key = o.order_key GROUP BY s.return_flag", "select l_returnflag as return_flag, round(sum(l_extendedprice * (1 - l_discount)) / nullif(count(distinct o_custkey), 0), 4) as revenue_per_customer from lineitem join orders on l_orderkey = o_orderkey group by all"),
    "metric_conditional": ("SELECT ship_year, return_rate FROM sales GROUP BY ship_year", "select year(l_shipdate) as ship_year, round(100.0 * sum(case when l_returnflag = 'R' then 1 else 0 end)::double / nullif(count(*), 0), 4) as return_rate from lineitem group by all"),
    "metric_distinct": ("SELECT event_type, active_users, event_count FROM activity GROUP BY event_type", "select event_type, count(distinct user_id) as active_users, count(*) as event_count from events group by all"),
    "metric_time": ("SELECT order_month, order_count, avg_order_value FROM orders GROUP BY order_month", "select strftime(o_orderdate, '%Y-%m') as order_month, count(distinct o_orderkey) as order_count, round(avg(o_totalprice), 4) as avg_order_value from orders group by all"),
    "metric_physical_column": ("SELECT line_status, avg_discount FROM sales GROUP BY line_status", "select l_linestatus as line_status, round(avg(l_discount), 4) as avg_discount from lineitem group by all"),
    "metric_distinct_grouping": ("SELECT DISTINCT segment AS s, total FROM (SELECT DISTINCT c.segment, order_count AS total FROM customers c JOIN orders o ON c.cust_key = o.cust_key) t", "select c_mktsegment as s, count(distinct o_orderkey) as total from customer join orders on c_custkey = o_custkey group by all"),
    "metric_fan_out": ("SELECT s.return_flag, total_part_size FROM sales s JOIN parts p ON s.part_key = p.part_key GROUP BY s.return_flag", "select l_returnflag as return_flag, cast(sum(p_size) as bigint) as total_part_size from lineitem join part on l_partkey = p_partkey group by all"),
    "raw_sum": ("SELECT status, SUM(total_price) AS total, MIN(total_price) AS low, MAX(total_price) AS high, AVG(total_price) AS mean FROM orders GROUP BY status", "select o_orderstatus as status, round(sum(o_totalprice), 4) as total, round(min(o_totalprice), 4) as low, round(max(o_totalprice), 4) as high, round(avg(o_totalprice), 4) as mean from orders group by all"),
    "raw_count_star": ("SELECT COUNT(*) AS n, COUNT(1) AS m FROM sales", "select count(*) as n, count(1) as m from lineitem"),
    "raw_count_distinct": ("SELECT priority, COUNT(DISTINCT cust_key) AS customers_n FROM orders GROUP BY priority", "select o_orderpriority as priority, count(distinct o_custkey) as customers_n from orders group by all"),
    "agg_mixed": ("SELECT return_flag, net_revenue, SUM(gross) AS g, COUNT(*) AS n FROM sales GROUP BY return_flag", "select l_returnflag as return_flag, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue, round(sum(l_extendedprice), 4) as g, count(*) as n from lineitem group by all"),
    "group_expr": ("SELECT year(ship_date) AS y, line_count FROM sales GROUP BY year(ship_date)", "select year(l_shipdate) as y, count(*) as line_count from lineitem group by all"),
    "group_ordinal": ("SELECT status, order_count FROM orders GROUP BY 1", "select o_orderstatus as status, count(*) as order_count from orders group by all"),
    "rollup": ("SELECT return_flag, line_status, line_count FROM sales GROUP BY ROLLUP (return_flag, line_status)", "select l_returnflag as return_flag, l_linestatus as line_status, count(*) as line_count from lineitem group by rollup (l_returnflag, l_linestatus)"),
    "cube": ("SELECT return_flag, line_status, units FROM sales GROUP BY CUBE (return_flag, line_status)", "select l_returnflag as return_flag, l_linestatus as line_status, round(sum(l_quantity), 4) as units from lineitem group by cube (l_returnflag, l_linestatus)"),
    "grouping_sets": ("SELECT status, priority, order_count FROM orders GROUP BY GROUPING SETS ((status), (priority), ())", "select o_orderstatus as status, o_orderpriority as priority, count(*) as order_count from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())"),
    # windows
    "win_row_number": ("SELECT order_key, ROW_NUMBER() OVER (PARTITION BY status ORDER BY total_price DESC, order_key) AS rn FROM orders", "select o_orderkey as order_key, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rn from orders"),
    "win_rank_metric": ("SELECT brand, RANK() OVER (ORDER BY net_revenue DESC) AS place FROM sales s JOIN parts p ON s.part_key = p.part_key GROUP BY brand", "select p_brand as brand, rank() over (order by sum(l_extendedprice * (1 - l_discount)) desc) as place from lineitem join part on l_partkey = p_partkey group by all"),
    "win_lag": ("SELECT order_key, LAG(order_key) OVER (PARTITION BY cust_key ORDER BY order_date, order_key) AS previous, LEAD(order_key) OVER (PARTITION BY cust_key ORDER BY order_date, order_key) AS following FROM orders", "select o_orderkey as order_key, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as following from orders"),
    "win_running_sum": ("SELECT event_id, SUM(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM activity", "select event_id, cast(sum(event_id) over (partition by user_id order by ts, event_id range between unbounded preceding and current row) as bigint) as running from events"),
    "win_frame_rows": ("SELECT part_key, AVG(size) OVER (PARTITION BY brand ORDER BY part_key ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS smooth FROM parts", "select p_partkey as part_key, round(avg(p_size) over (partition by p_brand order by p_partkey rows between 2 preceding and 1 following), 4) as smooth from part"),
    "win_ntile": ("SELECT cust_key, NTILE(4) OVER (ORDER BY balance, cust_key) AS quarter, DENSE_RANK() OVER (PARTITION BY segment ORDER BY nation_key) AS d FROM customers", "select c_custkey as cust_key, ntile(4) over (order by c_acctbal, c_custkey) as quarter, dense_rank() over (partition by c_mktsegment order by c_nationkey) as d from customer"),
    "win_percent_rank": ("SELECT part_key, PERCENT_RANK() OVER (PARTITION BY brand ORDER BY size) AS p, CUME_DIST() OVER (PARTITION BY brand ORDER BY size) AS c FROM parts", "select p_partkey as part_key, round(percent_rank() over (partition by p_brand order by p_size), 4) as p, round(cume_dist() over (partition by p_brand order by p_size), 4) as c from part"),
    "win_first_value": ("SELECT order_key, FIRST_VALUE(order_key) OVER w AS a, LAST_VALUE(order_key) OVER w AS b, NTH_VALUE(order_key, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY cust_key ORDER BY order_date, order_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "select o_orderkey as order_key, first_value(o_orderkey) over w as a, last_value(o_orderkey) over w as b, nth_value(o_orderkey, 2) over w as c from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)"),
    "win_in_cte": ("WITH r AS (SELECT cust_key, order_key, ROW_NUMBER() OVER (PARTITION BY cust_key ORDER BY total_price DESC, order_key) AS rn FROM orders) SELECT cust_key, order_key FROM r WHERE rn <= 2", "with r as (select o_custkey as cust_key, o_orderkey as order_key, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) select cust_key, order_key from r where rn <= 2"),
    # order and limit
    "order_alias": ("SELECT order_key AS k FROM orders ORDER BY k DESC LIMIT 10", "select o_orderkey as k from orders order by k desc limit 10"),
    "order_expr": ("SELECT part_key FROM parts ORDER BY size * 2 - 1 DESC, part_key LIMIT 10", "select p_partkey as part_key from part order by p_size * 2 - 1 desc, p_partkey limit 10"),
    "topk_metric": ("SELECT supp_key, net_revenue FROM sales GROUP BY supp_key ORDER BY net_revenue DESC, supp_key LIMIT 5", "select l_suppkey as supp_key, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem group by all order by 2 desc, 1 limit 5"),
    "limit_offset": ("SELECT order_key FROM orders ORDER BY order_key LIMIT 20 OFFSET 30", "select o_orderkey as order_key from orders order by o_orderkey limit 20 offset 30"),
    # set operations
    "union_all": ("SELECT nation_name AS name FROM nations UNION ALL SELECT region_name FROM regions UNION ALL SELECT nation_name FROM nations", "select n_name as name from nation union all select r_name from region union all select n_name from nation"),
    "union_distinct": ("SELECT nation_key FROM customers UNION SELECT nation_key FROM suppliers", "select cast(c_nationkey as bigint) as nation_key from customer union select s_nationkey from supplier"),
    "union_metric": ("SELECT 'line' AS what, net_revenue AS amount FROM sales UNION ALL SELECT 'event', event_value FROM activity", "select 'line' as what, round(sum(l_extendedprice * (1 - l_discount)), 4) as amount from lineitem union all select 'event', round(sum(value), 4) from events"),
    "intersect": ("SELECT nation_key FROM customers WHERE balance > 9000 INTERSECT SELECT nation_key FROM suppliers", "select cast(c_nationkey as bigint) as nation_key from customer where c_acctbal > 9000 intersect select s_nationkey from supplier"),
    "except": ("SELECT cust_key FROM customers EXCEPT SELECT cust_key FROM orders WHERE total_price > 150000", "select c_custkey as cust_key from customer except select o_custkey from orders where o_totalprice > 150000"),
    "setop_chain3": ("(SELECT part_key FROM parts WHERE size < 10 UNION SELECT part_key FROM parts WHERE size > 40) EXCEPT SELECT part_key FROM sales WHERE quantity > 49", "(select p_partkey as part_key from part where p_size < 10 union select p_partkey from part where p_size > 40) except select l_partkey from lineitem where l_quantity > 49"),
    # subqueries
    "sub_scalar_where": ("SELECT order_key FROM orders WHERE total_price > (SELECT AVG(total_price) * 1.5 FROM orders)", "select o_orderkey as order_key from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)"),
    "sub_scalar_select": ("SELECT region_name, (SELECT COUNT(*) FROM nations) AS n FROM regions", "select r_name as region_name, (select count(*) from nation) as n from region"),
    "sub_scalar_metric": ("SELECT return_flag, line_count, (SELECT line_count FROM sales) AS every FROM sales GROUP BY return_flag", "select l_returnflag as return_flag, count(*) as line_count, (select count(*) from lineitem) as every from lineitem group by all"),
    "sub_correlated": ("SELECT c.cust_key, (SELECT MAX(o.total_price) FROM orders o WHERE o.cust_key = c.cust_key) AS best FROM customers c", "select c_custkey as cust_key, round((select max(o_totalprice) from orders where o_custkey = c_custkey), 4) as best from customer"),
    "sub_nested3": ("SELECT cust_key FROM customers WHERE cust_key IN (SELECT cust_key FROM orders WHERE order_key IN (SELECT order_key FROM sales WHERE part_key IN (SELECT part_key FROM parts WHERE size = 50)))", "select c_custkey as cust_key from customer where c_custkey in (select o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_size = 50)))"),
    "cte_chain": ("WITH a AS (SELECT order_key, total_price FROM orders WHERE status = 'O'), b AS (SELECT order_key FROM a WHERE total_price > 200000) SELECT COUNT(*) AS n FROM b", "select count(*) as n from orders where o_orderstatus = 'O' and o_totalprice > 200000"),
    "cte_metric_filter": ("WITH m AS (SELECT part_key, net_revenue FROM sales GROUP BY part_key) SELECT part_key, net_revenue FROM m WHERE net_revenue > 1500000", "select l_partkey as part_key, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem group by all having sum(l_extendedprice * (1 - l_discount)) > 1500000"),
    "cte_self_join": ("WITH m AS (SELECT ship_year, line_count FROM sales GROUP BY ship_year) SELECT a.ship_year, a.line_count - b.line_count AS growth FROM m a JOIN m b ON a.ship_year = b.ship_year + 1", "with m as (select year(l_shipdate) as y, count(*) as n from lineitem group by all) select a.y as ship_year, a.n - b.n as growth from m a join m b on a.y = b.y + 1"),
    "cte_recursive": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t", "select cast(range as bigint) as n from range(1, 11)"),
}


def _auto_join(spark, sf_dir):
    df = star(spark, sf_dir).query(["net_revenue"], ["region_name"], via=["customers"])
    return plain_types(df)


def _auto_join_filter(spark, sf_dir):
    df = star(spark, sf_dir).query(["net_revenue", "order_count"], ["orders.priority", "brand"], where="parts.size > 40", having="order_count > 3")
    return plain_types(df)


QUERIES = {name: logical(sql) for name, (sql, _) in SQL.items()} | {"auto_join_query": _auto_join, "auto_join_filter": _auto_join_filter}
ORACLE = {name: sql for name, (_, sql) in SQL.items()} | {
    "auto_join_query": "select r_name as region_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all",
    "auto_join_filter": "select o_orderpriority as priority, p_brand as brand, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue, count(distinct o_orderkey) as order_count from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where p_size > 40 group by all having count(distinct o_orderkey) > 3",
}
