"""Domain inputs as SQL views over the driver's tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

VIEWS: dict[str, str] = {
    "fx_sales": r"""
SELECT
  (((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey) * 100 + CAST(l.l_quantity AS INT) AS id,
  CASE WHEN l.l_orderkey % 97 = 0 THEN 'Grand Total'
       WHEN l.l_orderkey % 29 = 0 THEN ' Don And Julio'
       WHEN l.l_orderkey % 31 = 0 THEN 'Italian Channel '
       WHEN l.l_orderkey % 5 = 0 THEN concat('BR ', sn.n_name, '  ')
       ELSE concat('BR ', sn.n_name) END AS branch,
  CASE WHEN l.l_linenumber = 6 THEN '1999-00' ELSE CAST(NULL AS VARCHAR(50)) END AS fy,
  CASE WHEN l.l_linenumber = 5 THEN 'Apr-01' WHEN l.l_linenumber = 4 THEN '' ELSE CAST(NULL AS VARCHAR(50)) END AS month,
  CASE WHEN l.l_linenumber = 5 THEN 'APR' WHEN l.l_linenumber = 4 THEN ' ' ELSE CAST(NULL AS VARCHAR(50)) END AS mmm,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'OWN REGION' ELSE CAST(NULL AS VARCHAR(255)) END AS region,
  CASE WHEN c.c_custkey % 50 = 0 THEN NULL WHEN c.c_custkey % 50 = 1 THEN '' ELSE cn.n_name END AS state,
  CASE c.c_custkey % 9 WHEN 0 THEN 'OWN DISTRICT' WHEN 1 THEN '' ELSE CAST(NULL AS VARCHAR(255)) END AS district,
  concat('CITY ', c.c_mktsegment) AS city,
  CAST(NULL AS VARCHAR(20)) AS pin_code,
  CASE WHEN c.c_custkey % 7 = 0 THEN 'RETAILER' ELSE NULL END AS business_type,
  CASE WHEN c.c_custkey % 11 = 0 THEN 'SHEET GROUP' ELSE NULL END AS party_grouped,
  CAST(NULL AS VARCHAR(255)) AS party_name_for_count,
  CASE l.l_linenumber WHEN 1 THEN concat('M/S ', c.c_name) WHEN 2 THEN lower(c.c_name) ELSE c.c_name END AS to_party_name,
  CASE WHEN l.l_orderkey % 58 = 0 OR l.l_orderkey % 37 = 0 THEN 'Rare Wool' ELSE CASE CAST(substr(p.p_brand, 7) AS INT) % 5 WHEN 0 THEN 'D&J' WHEN 1 THEN 'IC' WHEN 2 THEN 'RF' WHEN 3 THEN 'VERCELLI' ELSE p.p_brand END END AS brand,
  CASE l.l_linenumber WHEN 2 THEN lower(su.s_name) WHEN 3 THEN concat(su.s_name, '.') ELSE su.s_name END AS agent_name,
  concat('B-', CAST(l.l_orderkey AS VARCHAR(20))) AS bill_no,
  CASE WHEN l.l_linenumber = 5 THEN NULL WHEN l.l_orderkey % 13 = 0 THEN make_date(CAST(year(l.l_shipdate) + 24 AS INT), CAST(month(l.l_shipdate) AS INT), CAST(least(day(l.l_shipdate), 28) AS INT)) ELSE CAST(l.l_shipdate AS DATE) END AS bill_date,
  concat('ITEM ', CAST(p.p_partkey % 200 AS VARCHAR(20))) AS item_no,
  p.p_type AS shade_name,
  CAST(p.p_size AS VARCHAR(20)) AS size,
  CASE p.p_size % 4 WHEN 0 THEN '1,200' WHEN 1 THEN '12.5' WHEN 2 THEN 'N/A' ELSE NULL END AS units_pack,
  CAST(p.p_retailprice AS DECIMAL(15,4)) AS rate_unit,
  CAST(CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS DECIMAL(15,4)) AS sl_qty,
  CAST(l.l_extendedprice AS DECIMAL(15,4)) AS gross_amount,
  CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(15,4)) AS amount_before_tax,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE
    CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(15,4)) * (1 + CAST(l.l_tax AS DECIMAL(4,2))) AS DECIMAL(15,4)) END AS net_amount,
  CASE l.l_linenumber WHEN 1 THEN concat('MID/', CAST(o.o_orderkey AS VARCHAR(20))) WHEN 2 THEN concat('MIX-', CAST(o.o_orderkey AS VARCHAR(20)))
    WHEN 3 THEN 'src 9' WHEN 4 THEN 'ACS1' WHEN 5 THEN '"ACC2' WHEN 6 THEN concat('SO', CAST(o.o_orderkey AS VARCHAR(20))) ELSE NULL END AS sale_order_no,
  CAST(o.o_orderdate AS DATE) AS sale_order_date,
  p.p_type AS item_category,
  CASE WHEN o.o_orderkey % 8 = 0 THEN ' ' ELSE o.o_orderpriority END AS item_sub_cat,
  CASE l.l_suppkey % 5 WHEN 0 THEN 'OWN TYPE' WHEN 1 THEN ' ' ELSE CAST(NULL AS VARCHAR(255)) END AS so_type,
  CASE WHEN o.o_orderkey % 3 = 0 THEN concat('SCHEME ', CAST(l.l_linenumber AS VARCHAR(5))) ELSE CAST(NULL AS VARCHAR(255)) END AS scheme
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier su ON l.l_suppkey = su.s_suppkey
JOIN nation sn ON su.s_nationkey = sn.n_nationkey
""",
    "fx_region_master": r"""
SELECT n.n_name AS state, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 10 <> 9
""",
    "fx_party_master_app": r"""
SELECT CASE WHEN c_custkey % 2 = 1 THEN concat('M/S. ', c_name) ELSE c_name END AS account_name,
  concat('DIST ', CAST(c_custkey % 40 AS VARCHAR(10))) AS district, CAST(400000 + c_custkey % 900 AS VARCHAR(10)) AS pin_code
FROM customer WHERE c_custkey % 4 <> 3
""",
    "fx_party_grouping_master": r"""
SELECT c_custkey AS id, c_name AS to_party_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('GROUP ', CAST(c_custkey % 60 AS VARCHAR(10))) END AS party_grouped,
  c_name AS party_name_for_count FROM customer WHERE c_custkey % 3 <> 0
""",
    "fx_customer_type_master": r"""
SELECT c_custkey AS id, c_name AS party_name, CASE WHEN c_custkey % 2 = 0 THEN 'DISTRIBUTOR' ELSE 'DEALER' END AS type FROM customer WHERE c_custkey % 4 <> 0
""",
    "fx_agent_name_master": r"""
SELECT s_suppkey AS id, s_name AS agent_name, concat('AGENT ', CAST(s_suppkey % 20 AS VARCHAR(10))) AS combined_name FROM supplier WHERE s_suppkey % 3 <> 2
""",
    "fx_so_master": r"""
SELECT o_orderkey AS id, upper(c.c_name) AS party_name, CASE o.o_custkey % 4 WHEN 0 THEN 'DON AND JULIO' WHEN 1 THEN 'ITALIAN CHANNEL' WHEN 2 THEN 'RISHAB FABRICS' ELSE 'VERCELLI' END AS brand,
  concat(CAST(year(o_orderdate) AS VARCHAR(10)), '-', substr(CAST(year(o_orderdate) + 1 AS VARCHAR(10)), 3, 2)) AS fy,
  CAST(o_orderdate AS DATE) AS so_order_date, o_orderpriority AS type_of_order
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey % 5 <> 0
""",
    "fx_region_log": r"""
SELECT n_nationkey * 10 AS seq, n_name AS old_state, CASE WHEN n_nationkey % 3 = 0 THEN concat(' NATION_', CAST((n_nationkey + 1) % 25 AS VARCHAR(5))) ELSE lower(n_name) END AS new_state, concat(' REGION ', CAST(n_nationkey % 4 AS VARCHAR(5))) AS new_region FROM nation WHERE n_nationkey % 5 <> 4
UNION ALL SELECT n_nationkey * 10 + 5 AS seq, n_name AS old_state, n_name AS new_state, CAST(NULL AS VARCHAR(20)) AS new_region FROM nation WHERE n_nationkey % 7 = 2
""",
    "fx_party_log": r"""
SELECT c_custkey * 10 + k AS seq, c_name AS old_party, CASE WHEN k = 2 AND c_custkey % 3 = 0 THEN concat('Customer#', lpad(CAST(c_custkey + 1 AS VARCHAR(12)), 9, '0')) ELSE c_name END AS new_party,
  CASE WHEN k = 1 THEN concat('G', CAST(c_custkey % 9 AS VARCHAR(5))) WHEN c_custkey % 4 <> 0 THEN concat(' H', CAST(c_custkey % 5 AS VARCHAR(5))) END AS new_group, concat('N', CAST(k AS VARCHAR(5))) AS new_count,
  CASE WHEN k = 1 THEN 'retailer' WHEN k = 2 THEN 'Dealer' WHEN c_custkey % 8 = 0 THEN ' ' ELSE 'AGENT' END AS old_type, CASE WHEN k = 1 THEN 'DEALER' WHEN k = 2 THEN 'Agent ' WHEN c_custkey % 16 = 0 THEN NULL ELSE 'LAST' END AS new_type
FROM customer, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) r WHERE c_custkey % 2 = 0 OR k = 1
""",
    "fx_agent_log": r"""
SELECT s_suppkey * 10 + 1 AS seq, s_name AS old_agent, concat('Second ', CAST(s_suppkey AS VARCHAR(12))) AS new_agent, CAST(NULL AS VARCHAR(20)) AS old_combined, concat('C', CAST(s_suppkey % 3 AS VARCHAR(5))) AS new_combined FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT s_suppkey * 10 + 2 AS seq, concat('second ', CAST(s_suppkey AS VARCHAR(12))) AS old_agent, concat('Third ', CAST(s_suppkey % 50 AS VARCHAR(12))) AS new_agent, CAST(NULL AS VARCHAR(20)) AS old_combined, 'D' AS new_combined FROM supplier WHERE s_suppkey % 8 = 1
UNION ALL SELECT s_suppkey * 10 + 3 AS seq, s_name AS old_agent, s_name AS new_agent, CAST(NULL AS VARCHAR(20)) AS old_combined, CAST(NULL AS VARCHAR(20)) AS new_combined FROM supplier WHERE s_suppkey % 6 = 2
UNION ALL SELECT 900000000 + n_nationkey AS seq, ' ' AS old_agent, CAST(NULL AS VARCHAR(20)) AS new_agent, CASE n_nationkey WHEN 0 THEN 'agent 4' WHEN 1 THEN 'FOURTH' ELSE 'c1' END AS old_combined, CASE n_nationkey WHEN 0 THEN 'Fourth' WHEN 1 THEN 'Fifth' ELSE 'Sixth' END AS new_combined FROM nation WHERE n_nationkey < 3
""",
    "fx_so_log": r"""
SELECT c_custkey * 10 + k AS seq, c_name AS old_party, CASE WHEN k = 1 THEN 'ic' ELSE 'RF' END AS old_brand, c_name AS new_party, CASE WHEN c_custkey % 2 = 0 THEN 'Vercelli' ELSE CASE WHEN k = 1 THEN 'ic' ELSE 'RF' END END AS new_brand,
  CASE WHEN c_custkey % 6 = 0 AND k = 1 THEN 'Return' WHEN c_custkey % 5 = 0 THEN ' ' ELSE concat('T', CAST(k AS VARCHAR(5))) END AS new_type
FROM customer, (SELECT 1 AS k UNION ALL SELECT 2) r WHERE c_custkey % 3 <> 1
""",
    "fx_so_upload": r"""
SELECT o_orderkey * 3 + k AS seq, CASE WHEN k = 2 THEN concat(' ', c.c_name) ELSE c.c_name END AS party_name, CASE o.o_custkey % 4 WHEN 0 THEN 'don and julio' WHEN 1 THEN 'Italian Channel' WHEN 2 THEN ' RISHAB FABRICS' ELSE 'VERCELLI' END AS brand,
  CASE WHEN o_orderkey % 7 = 0 THEN '2031-32' ELSE concat(CAST(year(o_orderdate) AS VARCHAR(10)), '-', substr(CAST(year(o_orderdate) + 1 AS VARCHAR(10)), 3, 2)) END AS fy,
  CASE WHEN k = 1 THEN concat('NEW ', CAST(o_orderkey % 11 AS VARCHAR(5))) WHEN o_orderkey % 5 = 0 THEN 'LATER' ELSE ' ' END AS type_of_order
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey, (SELECT 1 AS k UNION ALL SELECT 2) r WHERE o_orderpriority = '1-URGENT'
""",
    "fx_grid": r"""
SELECT sheet, rn, split(line, ';') AS cells FROM (
  SELECT concat('S', CAST(r_regionkey AS VARCHAR(5))) AS sheet, CAST(1 AS BIGINT) AS rn, 'x;Report' AS line FROM region WHERE r_regionkey < 3
  UNION ALL SELECT concat('S', CAST(r_regionkey AS VARCHAR(5))) AS sheet, CAST(2 AS BIGINT) AS rn, 'x;Party  Name;Brand;Type Of Order;Bill Date;Qty;Sl. Qty;Rate;Rate' AS line FROM region WHERE r_regionkey < 3
  UNION ALL SELECT concat('S', CAST(o_custkey % 3 AS VARCHAR(5))) AS sheet, CAST(o_orderkey + 40 AS BIGINT) AS rn,
    concat('x;', CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat(' customer', CAST(o_custkey % 500 AS VARCHAR(10))) END, ';IC;', o_orderpriority, ';', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), ';7;', CAST(o_custkey AS VARCHAR(10)), ';1,200') AS line FROM orders
) g
""",
    "fx_alias": r"""
SELECT CASE r_regionkey WHEN 0 THEN 'PARTY NAME' WHEN 1 THEN 'TYPE OF ORDER' WHEN 2 THEN 'QTY' WHEN 3 THEN 'SL QTY' ELSE 'RATE' END AS norm_header,
  CASE r_regionkey WHEN 0 THEN 'PARTY NAME' WHEN 1 THEN 'TYPE OF ORDER' WHEN 2 THEN 'SL QTY' WHEN 3 THEN 'SL QTY' ELSE 'RATE/UNIT' END AS canonical, 1 AS priority FROM region
""",
    "fx_sheet": r"""
SELECT sheet, rn, split(line, ';') AS cells FROM (
  SELECT CASE WHEN r_regionkey = 0 THEN 'A' ELSE 'B' END AS sheet, CAST(r_regionkey + 1 AS BIGINT) AS rn,
    concat('x;Branch;STATE;City;Brand;Agent  Name;To Party Name;Bill No.;Bill Date;Shade Name;Rate/Unit;Size;Units/Pack;SL Qty;Gross Amount;Amount Before Tax;Net Amount;Sale Order No;Sale Order Date;Item Category;Item Sub Cat;', CASE WHEN r_regionkey = 0 THEN 'Item No;Item Name;FY;Region' ELSE 'Item Name;FY;Other' END) AS line FROM region WHERE r_regionkey < 2
  UNION ALL SELECT 'B' AS sheet, CAST(1 AS BIGINT) AS rn, 'x;Report;of sales' AS line FROM region WHERE r_regionkey = 0
  UNION ALL SELECT CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE CASE WHEN o_orderkey < 20 THEN 'D' ELSE 'B' END END AS sheet, CAST(o_orderkey + 40 AS BIGINT) AS rn,
    concat('x;BR 1;ST ', CAST(o_custkey % 7 AS VARCHAR(5)), ';;IC;Agent;Party ', CAST(o_custkey % 50 AS VARCHAR(5)), ';B-', CAST(o_orderkey AS VARCHAR(12)), ';', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), ';;1;2;3;', CAST(o_custkey AS VARCHAR(12)), ';5;6;7;SO;;CAT;SUB;', CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('I', CAST(o_orderkey % 9 AS VARCHAR(5))) END, ';NAME;1999-00;EAST') AS line FROM orders
) g
""",
    "fx_sheet_alias": r"""
SELECT upper(replace(h, '.', '')) AS norm_header, h AS canonical, 1 AS priority FROM (SELECT 'BRANCH' AS h UNION ALL SELECT 'STATE' UNION ALL SELECT 'CITY' UNION ALL SELECT 'BRAND' UNION ALL SELECT 'AGENT NAME' UNION ALL SELECT 'TO PARTY NAME' UNION ALL SELECT 'BILL NO.'
  UNION ALL SELECT 'BILL Date' UNION ALL SELECT 'SHADE NAME' UNION ALL SELECT 'RATE/UNIT' UNION ALL SELECT 'SIZE' UNION ALL SELECT 'UNITS/PACK' UNION ALL SELECT 'SL QTY' UNION ALL SELECT 'GROSS AMOUNT' UNION ALL SELECT 'AMOUNT BEFORE TAX' UNION ALL SELECT 'NET AMOUNT'
  UNION ALL SELECT 'SALE ORDER NO.' UNION ALL SELECT 'SALE ORDER Date' UNION ALL SELECT 'Item Category' UNION ALL SELECT 'Item Sub cat' UNION ALL SELECT 'ITEM NO' UNION ALL SELECT 'ITEM NAME' UNION ALL SELECT 'FY' UNION ALL SELECT 'REGION') a
""",
    "fx_event": r"""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'party' ELSE 'type' END AS table_name, CAST(o_custkey AS VARCHAR(20)) AS row_id, CAST(o_orderdate AS DATE) AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 1000 AS processed_rows, o_orderkey % 7 AS failed_rows,
  o_custkey AS job, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE NULL END AS queued_at, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) ELSE NULL END AS started_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ended FROM orders
""",
}


_ORDER, _PART = "JOIN orders o ON l.l_orderkey = o.o_orderkey", "JOIN part p ON l.l_partkey = p.p_partkey"
_CUSTOMER = "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey"
#: The joins of sales lines as written, and as Spark runs them: it keeps their order, and shuffles all that is joined so far by
#: each next key. Lines meet their parts, and orders their customers, before both meet, so that lines are shuffled twice and not
#: three times.
JOINS = f"{_ORDER}\n{_CUSTOMER}\n{_PART}", f"{_PART} {_ORDER.replace('orders o', f'(orders o {_CUSTOMER})')}"
#: Types that the views cast these columns to wherever they use them. Tables are bound with them, so that rows are smaller, and so
#: is the method that Spark generates for a sales line, which the JVM interprets if it has over 8000 bytes.
TYPES = {"lineitem": {"l_shipdate": "date", "l_discount": "decimal(4,2)", "l_tax": "decimal(4,2)"}, "orders": {"o_orderdate": "date"}, "part": {"p_retailprice": "decimal(15,4)"}}

#: Columns of a sales line that its id is made of.
PARTS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def ids_fit(lines: DataFrame) -> bool:
    """Whether the ids of all sales lines are bigints, by the greatest of each of their parts."""
    order, line, part, supplier, quantity = (int(x or 0) for x in lines.agg(*(F.max(F.abs(c)) for c in PARTS)).first())
    return (((order * 10 + line) * 100000 + part) * 10000 + supplier) * 100 + quantity < 2**63


def load(spark: SparkSession, sf_dir: str, name: str = "fx_sales") -> DataFrame:
    """A view as a DataFrame; tables are bound to the query, so no session state is changed. Sales lines that come in few
    large pieces are dealt out before their joins. Their ids are bigint; where keys are too large for that, decimal(38,0)."""
    sql = VIEWS[name].replace(*JOINS)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(\bFROM |\bJOIN |\(){t}\b", sql)}
    used |= {t: used[t].withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}) for t, kinds in TYPES.items() if t in used}
    cores = spark.sparkContext.defaultParallelism
    if "lineitem" in used:
        lines = used["lineitem"]
        if not ids_fit(lines):  # one decimal makes the id's arithmetic decimal, its keys stay as they are
            used["lineitem"] = lines.withColumn("l_linenumber", F.col("l_linenumber").cast("decimal(10,0)"))
        if lines.rdd.getNumPartitions() < cores:
            used["lineitem"] = used["lineitem"].repartition(cores)
    bound = re.sub(r"(\bFROM |\bJOIN |\()(\w+)", lambda m: f"{m[1]}{{{m[2]}}}" if m[2] in used else m[0], sql)
    return spark.sql(bound, **used)


def with_views(sql: str, *names: str) -> str:
    """sql with the named views as common table expressions, for the oracle."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    rest = sql.strip()
    return f"WITH {ctes}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes} {rest}"
