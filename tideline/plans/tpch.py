"""Exact decision-support queries over the star schema, as SQL that Catalyst plans.

The tables are a reduced TPC-H: where a query needs an absent column or table, a stand-in of the
same shape is used (``ps`` is a part-supplier table made from lineitem; "late" is a shipment over
60 days after the order). Money is exact: decimals that fit a long per row, a double at the end.
Predicates stand on scan columns, so they are pushed down; joins are left to the optimizer.
"""

from __future__ import annotations

from tideline.sources.chunks import PS

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"
REVENUE = f"{PRICE} * (1 - CAST(l_discount AS DECIMAL(4,2)))"
#: Windows that an exact query shares with its progressive form.
Q4_WHEN = "o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'"
Q5_WHEN = "o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01'"
Q7_WHEN = "l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'"
Q14_WHEN = "l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'"


def money(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS DOUBLE) AS {name}"


EXACT: dict[str, str] = {
    "tpch_q1": f"""
        SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, {money(PRICE, "sum_base_price")},
               {money(REVENUE, "sum_disc_price")},
               {money(f"CAST({REVENUE} AS DECIMAL(18,4)) * (1 + CAST(l_tax AS DECIMAL(4,2)))", "sum_charge")},
               round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*), 6) AS avg_qty,
               round(CAST(sum({PRICE}) AS DOUBLE) / count(*), 6) AS avg_price, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
        GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""
        WITH {PS}, offer AS (
          SELECT s_acctbal, s_name, n_name, p_partkey, ps_cost
          FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
          JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          WHERE r_name = 'EUROPE' AND p_size <= 25 AND p_type LIKE '%ARD'),
        best AS (SELECT p_partkey AS k, min(ps_cost) AS low FROM offer GROUP BY p_partkey)
        SELECT s_acctbal, s_name, n_name, p_partkey, ps_cost FROM offer JOIN best ON p_partkey = k AND ps_cost = low
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""
        SELECT l_orderkey, {money(REVENUE, "revenue")}, o_orderdate
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q4": f"""
        SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE {Q4_WHEN} AND EXISTS (
          SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
        GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": f"""
        SELECT n_name, {money(REVENUE, "revenue")}
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND {Q5_WHEN}
        GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q6": f"""
        SELECT {money(f"{PRICE} * CAST(l_discount AS DECIMAL(4,2))", "revenue")} FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q7": f"""
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, {money(REVENUE, "revenue")}
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_8') OR (n1.n_name = 'NATION_8' AND n2.n_name = 'NATION_3'))
          AND {Q7_WHEN}
        GROUP BY n1.n_name, n2.n_name, CAST(year(l_shipdate) AS INT) ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
        WITH sales AS (
          SELECT CAST(year(o_orderdate) AS INT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
          FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
          JOIN nation n2 ON s_nationkey = n2.n_nationkey
          WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1999-12-31')
        SELECT o_year, round(CAST(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) AS DOUBLE) / CAST(sum(volume) AS DOUBLE), 8) AS mkt_share
        FROM sales GROUP BY o_year ORDER BY o_year""",
    "tpch_q9": f"""
        WITH {PS}
        SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year,
               round(CAST(sum({REVENUE}) AS DOUBLE) - CAST(sum(ps_cost * CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100, 2) AS sum_profit
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
        WHERE p_name LIKE '%ring%' GROUP BY n_name, CAST(year(o_orderdate) AS INT) ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, {money(REVENUE, "revenue")}, c_acctbal, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        WITH {PS}, v AS (
          SELECT ps_partkey, CAST(sum(ps_cost * ps_qty) AS BIGINT) AS cents
          FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_8' GROUP BY ps_partkey)
        SELECT ps_partkey, CAST(cents AS DOUBLE) / 100 AS value FROM v
        WHERE CAST(cents AS DOUBLE) > (SELECT CAST(sum(cents) AS DOUBLE) * 0.001 FROM v) ORDER BY value DESC, ps_partkey""",
    "tpch_q12": """
        SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_shipdate > o_orderdate
        GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
        WITH c_orders AS (
          SELECT c_custkey, count(o_orderkey) AS c_count FROM customer
          LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey)
        SELECT c_count, count(*) AS custdist FROM c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) AS DOUBLE) / CAST(sum({REVENUE}) AS DOUBLE), 8) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {Q14_WHEN}""",
    "tpch_q15": f"""
        WITH revenue AS (
          SELECT l_suppkey AS supplier_no, {money(REVENUE, "total_revenue")} FROM lineitem
          WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
        WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
        WITH {PS}
        SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": f"""
        SELECT round(CAST(sum({PRICE}) AS DOUBLE) / 7.0, 6) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(l_quantity) AS BIGINT) AS sum_qty
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT {money(REVENUE, "revenue")} FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#12' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21)
           OR (p_brand = 'Brand#23' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30)
           OR (p_brand = 'Brand#3' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 40)""",
    "tpch_q20": f"""
        WITH {PS}
        SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE n_name IN ('NATION_3', 'NATION_8', 'NATION_15') AND s_suppkey IN (
          SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
            AND ps_qty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
                          AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01'))
        ORDER BY s_name""",
    "tpch_q21": """
        WITH late AS (
          SELECT l_orderkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate + INTERVAL '60' DAY)
        SELECT s_name, count(*) AS numwait FROM supplier JOIN late l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
        JOIN nation ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND n_name IN ('NATION_3', 'NATION_8', 'NATION_15', 'NATION_20')
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM late l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        WITH c AS (SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS bal FROM customer WHERE c_nationkey IN (3, 7, 8, 13, 15, 18, 20))
        SELECT c_nationkey AS cntrycode, count(*) AS numcust, CAST(sum(bal) AS DOUBLE) AS totacctbal FROM c
        WHERE CAST(bal AS DOUBLE) > (SELECT CAST(sum(bal) AS DOUBLE) / count(*) FROM c WHERE bal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')
        GROUP BY c_nationkey ORDER BY cntrycode""",
    "ola_q23": f"""
        SELECT {money(REVENUE, "revenue")} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15'""",
    "ola_q24": f"""
        SELECT {money(REVENUE, "revenue")} FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' AND l_shipdate >= DATE '1996-10-01' AND l_shipdate < DATE '1996-10-01' + INTERVAL '12' MONTH""",
    "ola_q25": f"""
        SELECT {money(REVENUE, "revenue")}
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_8' AND {Q7_WHEN}""",
    "ola_q26": """
        WITH cents AS (
          SELECT l_returnflag, l_linestatus, l_shipdate, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice) AS BIGINT) AS p,
                 CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem)
        SELECT l_returnflag, l_linestatus, CAST(sum(q) AS BIGINT) AS sum_qty, CAST(sum(p) AS BIGINT) AS sum_base_price,
               CAST(sum(p * (100 - d)) AS BIGINT) AS sum_disc_price, CAST(sum(p * (100 - d) * (100 + t)) AS BIGINT) AS sum_charge, count(*) AS count_order
        FROM cents WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "ola_q27": """
        SELECT CAST(sum(CAST(round(l_extendedprice) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND CAST(round(l_discount * 100) AS BIGINT) BETWEEN 5 AND 7 AND l_quantity < 24""",
}


def deep_sql(depth: int) -> str:
    """Nested aggregation: ``depth`` + 1 levels over ten key columns, sums and maxima in turn, each
    level grouping by one key fewer; the outermost is a sum."""
    keys = [f"k{i}" for i in range(depth, 0, -1)]
    own = ", ".join(f"CAST(({c}) % 4 AS INT) AS k{i + 1}" for i, c in enumerate(DEEP_KEYS))
    sql = f"SELECT {own}, CAST(l_quantity AS BIGINT) AS x FROM lineitem"
    for level in range(depth, -1, -1):
        kept = keys[depth - level :]
        by = ", ".join(kept)
        how = f"CAST({'sum' if level % 2 == 0 else 'max'}(x) AS BIGINT) AS x"
        sql = f"SELECT {by + ', ' if kept else ''}{how} FROM ({sql}) t{level}{' GROUP BY ' + by if kept else ''}"
    return sql


DEEP_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_orderkey", "l_partkey + l_suppkey", "l_linenumber + l_suppkey", "l_orderkey + l_partkey", "l_linenumber + l_orderkey", "l_suppkey + l_orderkey", "l_linenumber + l_partkey"]
EXACT |= {f"deep_q30_d{d}": deep_sql(d) for d in (0, 1, 2, 3, 5, 10)}
