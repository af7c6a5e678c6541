"""The business tables in SQL over the test tables, as ``bizpanel.sources.standin`` maps them."""

from __future__ import annotations

import re

_ACCOUNT = """['1241','1242','2321','2322','4211','4212','4221','4231','1261','1262','1271',
    '1272','1278','1270','1279','5111']"""
_DEPARTMENTS = """['ادارة المبيعات',' ادارة  الانتاج ','ادارة مخزن PR1','قسم المشتريات الخارجية',
    'الادارة المالية','ادارة الأمن','TESTER1','ادارة النظم والمعلومات','مشاريع جديدة',
    'قسم الجودة','ادارة الخدمات','MACHINERY']"""
_MARKS = "['EG','SD','EU','XX']"
_ITEM_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'R' WHEN 'SMALL' THEN 'P' WHEN 'LARGE' THEN 'B'
    WHEN 'MEDIUM' THEN 'S' WHEN 'PROMO' THEN 'X' END"""

TABLES = {
    "journal_line": f"""
SELECT ({_ACCOUNT})[l_partkey % 16 + 1] AS account,
  CASE l_linenumber WHEN 1 THEN 'GR' WHEN 2 THEN 'BT' WHEN 3 THEN 'NR' WHEN 4 THEN 'GP'
    WHEN 5 THEN 'NP' ELSE 'JV' END || l_orderkey AS journal_no,
  CAST(l_shipdate AS DATE) AS journal_date,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 1 THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS debit_book,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 1 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS credit_book,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 1 THEN CAST(l_quantity * 10 AS DECIMAL(18,2)) ELSE 0 END AS debit_txn,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 1 THEN 0 ELSE CAST(l_quantity * 10 AS DECIMAL(18,2)) END AS credit_txn,
  CASE WHEN l_linestatus = 'F' THEN 'EGP' WHEN l_returnflag = 'A' THEN 'USD'
    WHEN l_returnflag = 'N' THEN 'EUR' END AS line_currency,
  CASE WHEN l_suppkey % 12 = 0 THEN '' ELSE 'BK' || (l_suppkey % 12) || ({_MARKS})[l_suppkey % 12 % 4 + 1] END AS bank,
  CAST(l_suppkey AS VARCHAR) AS vendor,
  'N' || (l_suppkey % 27) AS segment9
FROM lineitem""",
    "accounts_master": f"""
SELECT DISTINCT ({_ACCOUNT})[p_partkey % 16 + 1] AS account_number,
  'Account ' || ({_ACCOUNT})[p_partkey % 16 + 1] AS account_description
FROM part WHERE ({_ACCOUNT})[p_partkey % 16 + 1] <> '4231'""",
    "bank_accounts_master": f"""
SELECT DISTINCT 'BK' || (s_suppkey % 12) || ({_MARKS})[s_suppkey % 12 % 4 + 1] AS bank_account_number,
  'Bank ' || (s_suppkey % 12) || ' ' || (['dollar','egp','euro'])[s_suppkey % 12 % 3 + 1] AS bank_account_name
FROM supplier WHERE s_suppkey % 12 BETWEEN 1 AND 10""",
    "segments_master": """
SELECT i.id AS segment_id, v.value AS segment_value,
  CASE WHEN i.id = 8 THEN 'Old ' || v.name ELSE v.name END AS value_description, v.parent AS parent_value
FROM (SELECT 'N' || n_nationkey AS value, n_name AS name, 'R' || n_regionkey AS parent FROM nation
      UNION ALL SELECT 'R' || r_regionkey, r_name, NULL FROM region) v
CROSS JOIN (SELECT 9 AS id UNION ALL SELECT 8) i""",
    "sales_header": """
SELECT o_orderkey AS internal_id, year(CAST(o_orderdate AS DATE) + 5) AS invoice_year,
  CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_custkey AS VARCHAR) AS customer_number,
  o_orderpriority AS sales_person_number, CAST(o_totalprice AS DECIMAL(18,2)) AS total_taxable_amount,
  CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS exchange_rate,
  CAST(o_totalprice AS DECIMAL(18,2)) + 10 AS total_final_amount_base
FROM orders""",
    "sales_line": """
SELECT l_orderkey AS int_id, l_partkey AS item_id, CAST(l_shipdate AS DATE) AS invoice_date,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS line_weight,
  CAST(l_quantity AS DECIMAL(18,2)) AS invoiced_quantity
FROM lineitem""",
    "customer_master": """
SELECT CAST(c_custkey AS VARCHAR) AS customer_no,
  CASE c_mktsegment WHEN 'BUILDING' THEN '1B' WHEN 'AUTOMOBILE' THEN '2A' WHEN 'MACHINERY' THEN '3M'
    WHEN 'HOUSEHOLD' THEN '4H' END AS customer_sales_person
FROM customer""",
    "customer_monthly_summary": """
SELECT CAST(o_custkey AS VARCHAR) AS customer_no,
  CASE WHEN o_custkey % 9 <> 0 THEN 'Customer ' || o_custkey END AS customer_name,
  year(o_orderdate) AS summary_year, month(o_orderdate) AS summary_month,
  sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total_amount,
  CAST(sum(o_orderkey % 100) AS DECIMAL(18,2)) AS total_weight,
  CAST(count(*) AS DECIMAL(18,2)) AS total_volume
FROM orders GROUP BY ALL""",
    "purchase_header": """
SELECT o_orderkey AS internal_id, year(o_orderdate) AS invoice_year,
  CAST(o_orderdate AS DATE) AS invoice_date, CAST(o_custkey // 15 AS VARCHAR) AS vendor_number,
  CASE o_orderstatus WHEN 'F' THEN 'NL' WHEN 'O' THEN 'IM' END AS vendor_type,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_lines_amount,
  CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS total_discount,
  CASE WHEN o_orderstatus = 'O' THEN 31 ELSE 1 END AS invoice_exchange_rate,
  CASE WHEN o_orderstatus = 'O' THEN 'USD' ELSE 'EGP' END AS invoice_currency
FROM orders""",
    "purchase_line": """
SELECT l_orderkey AS int_id, year(l_shipdate) AS inv_year,
  CASE WHEN l_partkey % 17 = 0 THEN '' WHEN l_partkey % 19 <> 0 THEN 'I' || l_partkey END AS item_code,
  CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'N' THEN 'P' ELSE 'F' END AS item_type,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_amount,
  CAST(l_quantity AS DECIMAL(18,2)) AS line_discount
FROM lineitem""",
    "vendor_master": """
SELECT CAST(s_suppkey AS VARCHAR) AS vendor_number,
  CASE WHEN s_suppkey % 10 <> 7 THEN 'Vendor ' || (s_suppkey // 2) END AS vendor_extra_name
FROM supplier WHERE s_suppkey % 13 <> 0""",
    "item_balance": """
SELECT l_partkey AS item_id, 'I' || l_partkey AS item_code,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DECIMAL(18,2)) AS item_balance
FROM lineitem""",
    "item_master": f"""
SELECT p_partkey AS item_id, {_ITEM_TYPE} AS item_type,
  CASE WHEN p_size <> 7 THEN p_name END AS item_extra_description,
  CASE WHEN p_partkey % 11 <> 0 THEN p_size END AS volume
FROM part""",
    "charging": """
SELECT CAST(o_custkey AS INT) AS client_id, year(o_orderdate) AS charging_year, month(o_orderdate) AS charging_month,
  o_orderpriority AS card_type, o_orderkey % 5 + 1 AS total_cards, CAST(o_totalprice AS DECIMAL(18,2)) AS total_points
FROM orders""",
    "activation": """
SELECT year(l_shipdate) AS activation_year, month(l_shipdate) AS activation_month,
  CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '9-NEW' END AS card_type,
  1 AS total_cards, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_points
FROM lineitem""",
    "redemption": """
SELECT CAST(o_custkey AS INT) AS client_id, year(o_orderdate) AS redemption_year, month(o_orderdate) AS redemption_month,
  'Gift ' || (o_orderkey % 40) AS gift_name, CAST(o_totalprice AS DECIMAL(18,2)) AS gift_point,
  CAST(o_orderkey % 500 AS DECIMAL(18,2)) AS offer_value,
  CASE o_orderkey % 3 WHEN 0 THEN 'NOVA' WHEN 1 THEN 'CCALL' ELSE 'SHOP' END AS source
FROM orders WHERE o_orderstatus = 'F'""",
    "client_master": """
SELECT CAST(c_custkey AS INT) AS glcid, CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS name,
  DATE '1998-01-01' + CAST(c_custkey % 1200 AS INT) AS created_date,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN NULL ELSE 0 END AS is_painter,
  c_nationkey AS governorate_id
FROM customer CROSS JOIN (SELECT 1 AS copy UNION ALL SELECT 2) k
WHERE c_custkey % 31 <> 0 AND (copy = 1 OR c_custkey % 50 = 0)""",
    "governorate": """
SELECT n_nationkey AS governorate_id, n_name AS name FROM nation WHERE n_nationkey % 6 <> 5""",
    "employee": f"""
SELECT CAST(c_custkey AS INT) AS employee_id, c_name AS full_name,
  CASE WHEN c_custkey % 29 <> 0 THEN 'Branch ' || c_nationkey END AS branch_name,
  CASE WHEN c_custkey % 43 <> 0 THEN ({_DEPARTMENTS})[c_custkey % 12 + 1] END AS department_name,
  'Division ' || (c_custkey % 7) AS division_name, 'Job ' || (c_custkey % 23) AS job_name,
  CAST(c_custkey // 10 AS INT) AS report_to, DATE '1995-01-01' + CAST(c_custkey * 7 % 2500 AS INT) AS joining_date,
  'Street ' || (c_custkey % 100) AS address, DATE '1995-02-01' + CAST(c_custkey * 7 % 2500 AS INT) AS contract_date,
  DATE '2001-02-01' + CAST(c_custkey % 365 AS INT) AS contract_expired_date,
  CASE WHEN c_custkey % 8 = 0 THEN 'Resigned' WHEN c_custkey % 3 = 0 THEN 'Working ' ELSE 'Working' END AS state_description,
  CASE WHEN c_custkey % 8 = 0 THEN DATE '2000-01-01' + CAST(c_custkey % 400 AS INT) END AS leaving_date,
  CASE WHEN c_custkey % 8 = 0 THEN 'Note ' || c_custkey END AS termination_notes,
  (['W','W','N ','N','X'])[c_custkey % 5 + 1] AS group_code, c_mktsegment AS education,
  CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS is_manager, CAST(c_custkey // 10 AS INT) AS manager_id,
  CASE WHEN c_custkey % 20 <> 3 THEN CAST(c_custkey AS INT) END AS image_id,
  DATE '1960-01-01' + CAST(c_custkey * 11 % 12000 AS INT) AS birthdate,
  '02-' || c_custkey AS tel, '01-' || c_custkey AS mob
FROM customer""",
    "employee_master": """
SELECT CAST(c_custkey AS INT) AS employee_id, upper(c_name) AS full_name FROM customer WHERE c_custkey % 37 <> 0""",
    "employee_salary": """
SELECT CAST(c_custkey AS INT) AS employee_id, s.id AS salary_id,
  CASE WHEN s.id = 1 THEN CAST(c_acctbal AS DECIMAL(18,2)) ELSE 500 END AS salary_amount
FROM customer CROSS JOIN (SELECT 1 AS id UNION ALL SELECT 2) s
WHERE c_custkey % 41 <> 0 AND (s.id = 1 OR c_custkey % 3 = 0)""",
    "salary_master": "SELECT r_regionkey AS salary_id, r_name AS salary_name FROM region",
    "termination": """
SELECT CAST(c_custkey AS INT) AS employee_id, DATE '2000-01-01' + CAST(c_custkey % 400 AS INT) AS termination_date,
  'Left ' || c_custkey AS termination_note, CASE WHEN c_custkey % 16 = 0 THEN 10 ELSE 20 END AS termination_state
FROM customer WHERE c_custkey % 8 = 0""",
    "kpi_evaluation": """
SELECT CAST(o_custkey AS INT) AS employee_id, year(o_orderdate) AS evaluation_year,
  quarter(o_orderdate) AS evaluation_quarter, CAST(o_orderkey % 7 AS INT) AS kpi_id,
  CAST(o_orderkey % 3 * 100 AS DECIMAL(18,2)) AS target_score, CAST(o_orderkey % 250 AS DECIMAL(18,2)) AS achieved_score,
  CAST(o_custkey // 10 AS INT) AS evaluate_by, CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 10 END AS record_state
FROM orders""",
    "kpi_master": "SELECT r_regionkey AS kpi_id, 'KPI ' || r_name AS kpi_description FROM region",
    "leave_history": """
SELECT CAST(o_custkey AS INT) AS employee_id, CAST(o_orderkey % 5 AS INT) AS leave_id,
  CAST(o_orderdate AS DATE) AS leave_date FROM orders""",
    "leave_master": """
SELECT r_regionkey AS leave_id, r_name AS leave_name, CASE WHEN r_regionkey = 4 THEN 1 ELSE 2 END AS leave_type,
  CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS is_business_leave FROM region""",
    "leave_balance": """
SELECT CAST(c_custkey AS INT) AS employee_id, CAST(c_custkey % 5 AS INT) AS leave_master_id, 2000 AS balance_year,
  CAST(21 AS DECIMAL(9,2)) AS open_balance, CAST(c_custkey % 25 AS DECIMAL(9,2)) AS issued,
  CAST(c_custkey % 3 AS DECIMAL(9,2)) AS approve_needed, CAST(c_custkey % 2 AS DECIMAL(9,2)) AS adjustments
FROM customer""",
    "safety_stock": f"""
SELECT p_partkey AS id, p_partkey AS item_id, 'I' || p_partkey AS item_code, p_name AS item_description,
  CASE WHEN p_partkey % 2 = 0 THEN lower({_ITEM_TYPE}) ELSE {_ITEM_TYPE} END AS item_type,
  CAST(p_size AS DECIMAL(18,2)) AS safety_stock,
  CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'W' || (p_partkey % 7) END AS purchasing_warehouse,
  CASE WHEN p_partkey % 17 <> 0 THEN 'P' || (p_partkey % 11) END AS production_warehouse,
  'user' || (p_partkey % 4) AS created_by, TIMESTAMP '2000-01-01 08:30:00' AS created_date,
  CASE WHEN p_partkey % 3 = 0 THEN 'user' || (p_partkey % 5) END AS last_maint_by,
  CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2000-01-01 08:30:00' + to_days(CAST(p_partkey % 300 AS INT))
    + to_hours(CAST(p_partkey % 24 AS INT)) END AS last_maint_date
FROM part""",
    # Requests made of the events: period kind, month text, quarter and year by event number.
    "request": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'yearly' WHEN 1 THEN 'quarterly' ELSE 'monthly' END AS period,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 IN (0, 1) THEN ''
    WHEN event_id % 4 = 2 THEN CAST(event_id % 12 + 1 AS VARCHAR)
    ELSE (event_id % 12 + 1) || ',' || (event_id % 7 + 1) || ',' || (event_id % 12 + 1) END AS months,
  CAST(event_id % 5 AS INT) AS quarter, CAST(1995 + event_id % 7 AS INT) AS year
FROM events""",
}

_NAMES = sorted(TABLES, key=len, reverse=True)


def with_tables(sql: str) -> str:
    """``sql`` with a CTE in front for each business table it names."""
    used = [n for n in _NAMES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in used)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH "):
        body = body[5 + len(recursive):]
        return f"WITH {recursive}{ctes},\n{body}"
    return f"WITH {ctes}\n{body}"


def finish(sql: str, money: str = "", ints: str = "", longs: str = "", dates: str = "") -> str:
    """Query with its tables, and the named columns in their final types."""
    casts = [f"round(CAST({c} AS DOUBLE), 2) AS {c}" for c in money.split()]
    casts += [f"CAST({c} AS INTEGER) AS {c}" for c in ints.split()]
    casts += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    full = with_tables(sql)
    if not casts:
        return full
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{full}\n) q"
