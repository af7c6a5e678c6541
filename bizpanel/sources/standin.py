"""The business tables mapped onto the TPC-H-like test tables.

Each table is a projection of a test table, so its size grows with the test data.
The expressions follow the column order of ``bizpanel.sources.schema``. The same
mapping is stated in DuckDB's SQL in ``bizpanel.checks.mapping``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from bizpanel.sources.schema import columns
from bizpanel.sources.tables import Tables

Read = Callable[[str], DataFrame]

# The test tables this mapping reads; a declared schema saves reading a footer per table.
TEST_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}

# Accounts by part number modulo 16, departments by customer number modulo 12.
ACCOUNTS = (
    "1241 1242 2321 2322 4211 4212 4221 4231 1261 1262 1271 1272 1278 1270 1279 5111"
).split()
DEPARTMENTS = (
    "ادارة المبيعات",
    " ادارة  الانتاج ",
    "ادارة مخزن PR1",
    "قسم المشتريات الخارجية",
    "الادارة المالية",
    "ادارة الأمن",
    "TESTER1",
    "ادارة النظم والمعلومات",
    "مشاريع جديدة",
    "قسم الجودة",
    "ادارة الخدمات",
    "MACHINERY",
)


def pick(values: Sequence[str], index: str) -> str:
    """SQL for the value at a 0-based index."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({index} AS INT) + 1)"


def day(column: str) -> str:
    return f"CAST({column} AS DATE)"


def plus_days(first: str, days: str) -> str:
    return f"date_add(DATE'{first}', CAST({days} AS INT))"


DEBIT = "CAST(l_quantity AS INT) % 2 = 1"
BOOK = "l_extendedprice"
TXN = "l_quantity * 10"
DOCUMENT = """CASE l_linenumber WHEN 1 THEN 'GR' WHEN 2 THEN 'BT' WHEN 3 THEN 'NR'
    WHEN 4 THEN 'GP' WHEN 5 THEN 'NP' ELSE 'JV' END"""
BANK_MARKS = ("EG", "SD", "EU", "XX")
BANK_WORDS = ("dollar", "egp", "euro")
ITEM_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'R' WHEN 'SMALL' THEN 'P' WHEN 'LARGE' THEN 'B'
    WHEN 'MEDIUM' THEN 'S' WHEN 'PROMO' THEN 'X' END"""


def bank_code(key: str) -> str:
    return f"concat('BK', {key} % 12, {pick(BANK_MARKS, f'{key} % 12 % 4')})"


def _segments(read: Read) -> DataFrame:
    nation = read("nation").selectExpr(
        "concat('N', n_nationkey) AS v", "n_name AS d", "concat('R', n_regionkey) AS p"
    )
    region = read("region").selectExpr("concat('R', r_regionkey)", "r_name", "CAST(NULL AS STRING)")
    return nation.union(region).selectExpr("explode(array(9, 8)) AS id", "v", "d", "p")


def _months(read: Read) -> DataFrame:
    """Monthly order amounts; weight and volume stand in as key sums and counts."""
    rows = read("orders").selectExpr(
        "o_custkey",
        "year(o_orderdate) AS y",
        "month(o_orderdate) AS m",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amount",
        "o_orderkey % 100 AS weight",
        "1 AS volume",
    )
    return rows.groupBy("o_custkey", "y", "m").sum("amount", "weight", "volume").toDF(
        "o_custkey", "y", "m", "amount", "weight", "volume"
    )


# Table: rows to project, and one SQL expression per declared column.
MAPPINGS: dict[str, tuple[Callable[[Read], DataFrame], tuple[str, ...]]] = {
    "journal_line": (
        lambda read: read("lineitem"),
        (
            pick(ACCOUNTS, "l_partkey % 16"),
            f"concat({DOCUMENT}, l_orderkey)",
            day("l_shipdate"),
            f"CASE WHEN {DEBIT} THEN {BOOK} ELSE 0 END",
            f"CASE WHEN {DEBIT} THEN 0 ELSE {BOOK} END",
            f"CASE WHEN {DEBIT} THEN {TXN} ELSE 0 END",
            f"CASE WHEN {DEBIT} THEN 0 ELSE {TXN} END",
            """CASE WHEN l_linestatus = 'F' THEN 'EGP' WHEN l_returnflag = 'A' THEN 'USD'
                WHEN l_returnflag = 'N' THEN 'EUR' END""",
            f"CASE WHEN l_suppkey % 12 = 0 THEN '' ELSE {bank_code('l_suppkey')} END",
            "l_suppkey",
            "concat('N', l_suppkey % 27)",
        ),
    ),
    "accounts_master": (
        lambda read: read("part")
        .selectExpr(f"{pick(ACCOUNTS, 'p_partkey % 16')} AS account")
        .distinct()
        .where("account <> '4231'"),
        ("account", "concat('Account ', account)"),
    ),
    "bank_accounts_master": (
        lambda read: read("supplier")
        .selectExpr("s_suppkey % 12 AS k")
        .distinct()
        .where("k BETWEEN 1 AND 10"),
        (bank_code("k"), f"concat('Bank ', k, ' ', {pick(BANK_WORDS, 'k % 3')})"),
    ),
    "segments_master": (
        _segments,
        ("id", "v", "CASE WHEN id = 8 THEN concat('Old ', d) ELSE d END", "p"),
    ),
    "sales_header": (
        lambda read: read("orders"),
        (
            "o_orderkey",
            f"year(date_add({day('o_orderdate')}, 5))",
            day("o_orderdate"),
            "o_custkey",
            "o_orderpriority",
            "o_totalprice",
            "CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END",
            "o_totalprice + 10",
        ),
    ),
    "sales_line": (
        lambda read: read("lineitem"),
        (
            "l_orderkey",
            "l_partkey",
            day("l_shipdate"),
            "CASE WHEN l_linenumber <> 7 THEN l_quantity END",
            "l_quantity",
        ),
    ),
    "customer_master": (
        lambda read: read("customer"),
        (
            "c_custkey",
            """CASE c_mktsegment WHEN 'BUILDING' THEN '1B' WHEN 'AUTOMOBILE' THEN '2A'
                WHEN 'MACHINERY' THEN '3M' WHEN 'HOUSEHOLD' THEN '4H' END""",
        ),
    ),
    "customer_monthly_summary": (
        _months,
        (
            "o_custkey",
            "CASE WHEN o_custkey % 9 <> 0 THEN concat('Customer ', o_custkey) END",
            "y",
            "m",
            "amount",
            "weight",
            "volume",
        ),
    ),
    "purchase_header": (
        lambda read: read("orders"),
        (
            "o_orderkey",
            "year(o_orderdate)",
            day("o_orderdate"),
            "o_custkey div 15",
            "CASE o_orderstatus WHEN 'F' THEN 'NL' WHEN 'O' THEN 'IM' END",
            "o_totalprice",
            "CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END",
            "CASE WHEN o_orderstatus = 'O' THEN 31 ELSE 1 END",
            "CASE WHEN o_orderstatus = 'O' THEN 'USD' ELSE 'EGP' END",
        ),
    ),
    "purchase_line": (
        lambda read: read("lineitem"),
        (
            "l_orderkey",
            "year(l_shipdate)",
            """CASE WHEN l_partkey % 17 = 0 THEN ''
                WHEN l_partkey % 19 <> 0 THEN concat('I', l_partkey) END""",
            "CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'N' THEN 'P' ELSE 'F' END",
            BOOK,
            BOOK,
            "l_quantity",
        ),
    ),
    "vendor_master": (
        lambda read: read("supplier").where("s_suppkey % 13 <> 0"),
        ("s_suppkey", "CASE WHEN s_suppkey % 10 <> 7 THEN concat('Vendor ', s_suppkey div 2) END"),
    ),
    "item_balance": (
        lambda read: read("lineitem"),
        (
            "l_partkey",
            "concat('I', l_partkey)",
            "CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END",
        ),
    ),
    "item_master": (
        lambda read: read("part"),
        (
            "p_partkey",
            ITEM_TYPE,
            "CASE WHEN p_size <> 7 THEN p_name END",
            "CASE WHEN p_partkey % 11 <> 0 THEN p_size END",
        ),
    ),
    "charging": (
        lambda read: read("orders"),
        (
            "o_custkey",
            "year(o_orderdate)",
            "month(o_orderdate)",
            "o_orderpriority",
            "o_orderkey % 5 + 1",
            "o_totalprice",
        ),
    ),
    "activation": (
        lambda read: read("lineitem"),
        (
            "year(l_shipdate)",
            "month(l_shipdate)",
            "CASE l_returnflag WHEN 'A' THEN '1-URGENT' WHEN 'N' THEN '2-HIGH' ELSE '9-NEW' END",
            "1",
            BOOK,
        ),
    ),
    "redemption": (
        lambda read: read("orders").where("o_orderstatus = 'F'"),
        (
            "o_custkey",
            "year(o_orderdate)",
            "month(o_orderdate)",
            "concat('Gift ', o_orderkey % 40)",
            "o_totalprice",
            "o_orderkey % 500",
            "CASE o_orderkey % 3 WHEN 0 THEN 'NOVA' WHEN 1 THEN 'CCALL' ELSE 'SHOP' END",
        ),
    ),
    "client_master": (
        lambda read: read("customer")
        .where("c_custkey % 31 <> 0")
        .selectExpr("*", "explode(sequence(1, IF(c_custkey % 50 = 0, 2, 1))) AS copy"),
        (
            "c_custkey",
            "CASE WHEN c_custkey % 9 <> 0 THEN c_name END",
            plus_days("1998-01-01", "c_custkey % 1200"),
            "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN NULL ELSE 0 END",
            "c_nationkey",
        ),
    ),
    "governorate": (
        lambda read: read("nation").where("n_nationkey % 6 <> 5"),
        ("n_nationkey", "n_name"),
    ),
    "employee": (
        lambda read: read("customer"),
        (
            "c_custkey",
            "c_name",
            "CASE WHEN c_custkey % 29 <> 0 THEN concat('Branch ', c_nationkey) END",
            f"CASE WHEN c_custkey % 43 <> 0 THEN {pick(DEPARTMENTS, 'c_custkey % 12')} END",
            "concat('Division ', c_custkey % 7)",
            "concat('Job ', c_custkey % 23)",
            "c_custkey div 10",
            plus_days("1995-01-01", "c_custkey * 7 % 2500"),
            "concat('Street ', c_custkey % 100)",
            plus_days("1995-02-01", "c_custkey * 7 % 2500"),
            plus_days("2001-02-01", "c_custkey % 365"),
            """CASE WHEN c_custkey % 8 = 0 THEN 'Resigned' WHEN c_custkey % 3 = 0 THEN 'Working '
                ELSE 'Working' END""",
            f"CASE WHEN c_custkey % 8 = 0 THEN {plus_days('2000-01-01', 'c_custkey % 400')} END",
            "CASE WHEN c_custkey % 8 = 0 THEN concat('Note ', c_custkey) END",
            pick(("W", "W", "N ", "N", "X"), "c_custkey % 5"),
            "c_mktsegment",
            "CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END",
            "c_custkey div 10",
            "CASE WHEN c_custkey % 20 <> 3 THEN c_custkey END",
            plus_days("1960-01-01", "c_custkey * 11 % 12000"),
            "concat('02-', c_custkey)",
            "concat('01-', c_custkey)",
        ),
    ),
    "employee_master": (
        lambda read: read("customer").where("c_custkey % 37 <> 0"),
        ("c_custkey", "upper(c_name)"),
    ),
    # Component 1 is the account balance; every third customer has a second one.
    "employee_salary": (
        lambda read: read("customer")
        .where("c_custkey % 41 <> 0")
        .selectExpr("*", "explode(sequence(1, IF(c_custkey % 3 = 0, 2, 1))) AS component"),
        ("c_custkey", "component", "IF(component = 1, c_acctbal, 500)"),
    ),
    "salary_master": (lambda read: read("region"), ("r_regionkey", "r_name")),
    "termination": (
        lambda read: read("customer").where("c_custkey % 8 = 0"),
        (
            "c_custkey",
            plus_days("2000-01-01", "c_custkey % 400"),
            "concat('Left ', c_custkey)",
            "CASE WHEN c_custkey % 16 = 0 THEN 10 ELSE 20 END",
        ),
    ),
    "kpi_evaluation": (
        lambda read: read("orders"),
        (
            "o_custkey",
            "year(o_orderdate)",
            "quarter(o_orderdate)",
            "o_orderkey % 7",
            "o_orderkey % 3 * 100",
            "o_orderkey % 250",
            "o_custkey div 10",
            "CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 10 END",
        ),
    ),
    "kpi_master": (lambda read: read("region"), ("r_regionkey", "concat('KPI ', r_name)")),
    "leave_history": (
        lambda read: read("orders"),
        ("o_custkey", "o_orderkey % 5", day("o_orderdate")),
    ),
    "leave_master": (
        lambda read: read("region"),
        (
            "r_regionkey",
            "r_name",
            "CASE WHEN r_regionkey = 4 THEN 1 ELSE 2 END",
            "CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END",
        ),
    ),
    "leave_balance": (
        lambda read: read("customer"),
        ("c_custkey", "c_custkey % 5", "2000", "21", "c_custkey % 25", "c_custkey % 3", "c_custkey % 2"),
    ),
    "safety_stock": (
        lambda read: read("part"),
        (
            "p_partkey",
            "p_partkey",
            "concat('I', p_partkey)",
            "p_name",
            f"IF(p_partkey % 2 = 0, lower({ITEM_TYPE}), {ITEM_TYPE})",
            "p_size",
            "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('W', p_partkey % 7) END",
            "CASE WHEN p_partkey % 17 <> 0 THEN concat('P', p_partkey % 11) END",
            "concat('user', p_partkey % 4)",
            "TIMESTAMP_NTZ'2000-01-01 08:30:00'",
            "CASE WHEN p_partkey % 3 = 0 THEN concat('user', p_partkey % 5) END",
            """CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP_NTZ'2000-01-01 08:30:00'
                + make_dt_interval(CAST(p_partkey % 300 AS INT), CAST(p_partkey % 24 AS INT)) END""",
        ),
    ),
}


def mapped(name: str, read: Read) -> DataFrame:
    """One business table with its declared column names and types."""
    rows, expressions = MAPPINGS[name]
    return rows(read).selectExpr(
        *[
            f"CAST({e} AS {kind}) AS {column}"
            for e, (column, kind) in zip(expressions, columns(name), strict=True)
        ]
    )


def request_documents(read: Read) -> DataFrame:
    """JSON report requests made of the events; every tenth document is cut off."""
    months = """CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 4 < 2 THEN ''
        WHEN event_id % 4 = 2 THEN CAST(event_id % 12 + 1 AS STRING)
        ELSE concat(event_id % 12 + 1, ',', event_id % 7 + 1, ',', event_id % 12 + 1) END"""
    period = "element_at(array('yearly', 'quarterly', 'monthly', 'monthly'), CAST(event_id % 4 AS INT) + 1)"
    document = f"""to_json(named_struct('Period', {period}, 'Months', {months},
        'Quarter', event_id % 5, 'Year', event_id % 7 + 1995))"""
    return read("events").selectExpr(
        "event_id",
        f"IF(event_id % 10 = 9, left({document}, 20), {document}) AS document",
        "props",
    )


def standin_tables(spark: SparkSession, folder: str) -> Tables:
    """The business tables over a folder of test tables."""
    def read(name: str) -> DataFrame:
        return spark.read.schema(TEST_TABLES[name]).parquet(f"{folder}/{name}.parquet")

    loaders = {name: (lambda n=name: mapped(n, read)) for name in MAPPINGS}
    loaders["request_documents"] = lambda: request_documents(read)
    return Tables(spark, loaders)
