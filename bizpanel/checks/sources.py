"""Scans, requests, profiles, exports and period operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.checks.registry import check, count
from bizpanel.checks.settings import AS_OF, GAP, SECOND_QUARTER, WHOLE_YEAR, YEAR
from bizpanel.operators import period as pd
from bizpanel.operators.joins import on_month_spine
from bizpanel.operators.lineage import ensure_checkpoint_dir
from bizpanel.operators.policy import EMPTY, Policy, Rule
from bizpanel.plans import ledger, sales, stock
from bizpanel.sources import profile, requests, sinks
from bizpanel.sources.tables import Tables, write_table


@check(
    "s1_ledger_scan",
    """SELECT account, count(*) AS n, sum(debit_book) AS debit, sum(credit_book) AS credit,
       min(journal_date) AS first_day, max(journal_date) AS last_day FROM journal_line GROUP BY account""",
    money="debit credit",
    dates="first_day last_day",
)
def _(t):
    return t.journal_line.groupBy("account").agg(
        count().alias("n"),
        F.sum("debit_book").alias("debit"),
        F.sum("credit_book").alias("credit"),
        F.min("journal_date").alias("first_day"),
        F.max("journal_date").alias("last_day"),
    )


@check(
    "s2_sales_scan",
    """SELECT h.invoice_year, h.n, h.amount, l.lines, l.weight FROM
       (SELECT invoice_year, count(*) AS n, sum(total_taxable_amount * exchange_rate) AS amount
        FROM sales_header GROUP BY 1) h
       JOIN (SELECT year(invoice_date) AS y, count(*) AS lines, sum(line_weight) AS weight
        FROM sales_line GROUP BY 1) l ON h.invoice_year = l.y""",
    money="amount weight",
    ints="invoice_year",
)
def _(t):
    header = t.sales_header.groupBy("invoice_year").agg(
        count().alias("n"), F.sum(sales.taxable_amount()).alias("amount")
    )
    line = t.sales_line.groupBy(F.year("invoice_date").alias("invoice_year")).agg(
        count().alias("lines"), F.sum("line_weight").alias("weight")
    )
    return header.join(line, "invoice_year")


@check(
    "s3_purchase_scan",
    """SELECT 'header' AS part, invoice_year AS year, count(*) AS n, sum(total_lines_amount - total_discount) AS amount
       FROM purchase_header GROUP BY 2
       UNION ALL SELECT 'line', inv_year, count(*), sum(line_amount - line_discount) FROM purchase_line GROUP BY 2""",
    money="amount",
    ints="year",
)
def _(t):
    header = t.purchase_header.groupBy(F.col("invoice_year").alias("year")).agg(
        count().alias("n"), F.sum(F.col("total_lines_amount") - F.col("total_discount")).alias("amount")
    )
    line = t.purchase_line.groupBy(F.col("inv_year").alias("year")).agg(
        count().alias("n"), F.sum(F.col("line_amount") - F.col("line_discount")).alias("amount")
    )
    return header.select(F.lit("header").alias("part"), "*").unionByName(
        line.select(F.lit("line").alias("part"), "*")
    )


@check(
    "s4_dimension_scan",
    """SELECT 'account' AS kind, account_number AS code, account_description AS label FROM accounts_master
       UNION ALL SELECT 'bank', bank_account_number, bank_account_name FROM bank_accounts_master
       UNION ALL SELECT 'segment', segment_value, value_description FROM segments_master WHERE segment_id = 9
       UNION ALL SELECT 'vendor', vendor_number, vendor_extra_name FROM vendor_master
       UNION ALL SELECT 'customer', customer_no, customer_sales_person FROM customer_master
       UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), item_extra_description FROM item_master""",
)
def _(t):
    def part(kind, df, code, label):
        return df.select(
            F.lit(kind).alias("kind"),
            F.col(code).cast("string").alias("code"),
            F.col(label).alias("label"),
        )

    segments = t.segments_master.filter(F.col("segment_id") == 9)
    return (
        part("account", t.accounts_master, "account_number", "account_description")
        .unionByName(part("bank", t.bank_accounts_master, "bank_account_number", "bank_account_name"))
        .unionByName(part("segment", segments, "segment_value", "value_description"))
        .unionByName(part("vendor", t.vendor_master, "vendor_number", "vendor_extra_name"))
        .unionByName(part("customer", t.customer_master, "customer_no", "customer_sales_person"))
        .unionByName(part("item", t.item_master, "item_id", "item_extra_description"))
    )


@check(
    "s5_stock_scan",
    "SELECT item_code, count(*) AS n, sum(item_balance) AS balance FROM item_balance GROUP BY item_code",
    money="balance",
)
def _(t):
    return t.item_balance.groupBy("item_code").agg(
        count().alias("n"), F.sum("item_balance").alias("balance")
    )


@check(
    "s6_loyalty_scan",
    """SELECT 'charging' AS fact, charging_year AS year, count(*) AS n, sum(total_points) AS points FROM charging GROUP BY 2
       UNION ALL SELECT 'activation', activation_year, count(*), sum(total_points) FROM activation GROUP BY 2
       UNION ALL SELECT 'redemption', redemption_year, count(*), sum(gift_point) FROM redemption GROUP BY 2
       UNION ALL SELECT 'client', year(created_date), count(*), NULL FROM client_master GROUP BY 2""",
    money="points",
    ints="year",
)
def _(t):
    def part(fact, df, year, value):
        return df.groupBy(F.lit(fact).alias("fact"), year.alias("year")).agg(
            count().alias("n"), F.sum(value).alias("points")
        )

    return (
        part("charging", t.charging, F.col("charging_year"), F.col("total_points"))
        .unionByName(part("activation", t.activation, F.col("activation_year"), F.col("total_points")))
        .unionByName(part("redemption", t.redemption, F.col("redemption_year"), F.col("gift_point")))
        .unionByName(
            part("client", t.client_master, F.year("created_date"), F.lit(None).cast("decimal(18,2)"))
        )
    )


@check(
    "s7_hr_scan",
    """SELECT 'employee' AS name, count(*) AS n FROM employee UNION ALL SELECT 'salary', count(*) FROM employee_salary
       UNION ALL SELECT 'termination', count(*) FROM termination UNION ALL SELECT 'evaluation', count(*) FROM kpi_evaluation
       UNION ALL SELECT 'leave', count(*) FROM leave_history UNION ALL SELECT 'balance', count(*) FROM leave_balance""",
)
def _(t):
    named = {
        "employee": t.employee,
        "salary": t.employee_salary,
        "termination": t.termination,
        "evaluation": t.kpi_evaluation,
        "leave": t.leave_history,
        "balance": t.leave_balance,
    }
    return profile.table_profile(named).toDF("name", "n")


@check(
    "s8_catalog_names",
    """SELECT line_currency, count(*) AS n, sum(debit_book - credit_book) AS balance
       FROM journal_line GROUP BY line_currency""",
    money="balance",
)
def _(t):
    # a view of another database, by catalog, database and name
    spark = t.spark
    spark.sql("CREATE DATABASE IF NOT EXISTS books_of_account")
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/check-{uuid.uuid4().hex}"
    write_table(t.journal_line, root, "journal_line")
    spark.sql(
        "CREATE OR REPLACE VIEW spark_catalog.books_of_account.journal AS "
        f"SELECT * FROM parquet.`{root}/journal_line`"
    )
    named = Tables.from_catalog(spark, {"journal_line": "spark_catalog.books_of_account.journal"})
    return named.journal_line.groupBy("line_currency").agg(
        count().alias("n"), F.sum(ledger.book_balance()).alias("balance")
    )


REQUEST = """SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN period END AS period,
    CASE WHEN event_id % 10 <> 9 THEN months END AS months, CASE WHEN event_id % 10 <> 9 THEN quarter END AS quarter,
    CASE WHEN event_id % 10 <> 9 THEN year END AS year FROM request"""


@check("s9_typed_requests", f"SELECT *, CAST(NULL AS VARCHAR) AS customer_type FROM ({REQUEST})")
def _(t):
    return requests.requests(t.request_documents, "document").drop("document", "props")


@check("s10_json_validity", "SELECT event_id, event_id % 10 <> 9 AS valid FROM events")
def _(t):
    return t.request_documents.select(
        "event_id", requests.is_valid_json(F.col("document")).alias("valid")
    )


@check(
    "s11_json_path",
    """SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1""",
)
def _(t):
    return t.request_documents.groupBy(
        requests.json_int(F.col("props"), "$.k").alias("k")
    ).agg(count().alias("n"))


@check(
    "s12_month_rows",
    """SELECT m.month, count(h.internal_id) AS invoices FROM range(1, 13) m(month)
       LEFT JOIN sales_header h ON month(h.invoice_date) = m.month AND year(h.invoice_date) = 2000 GROUP BY 1""",
    ints="month",
)
def _(t):
    of_year = t.sales_header.filter(pd.in_year(F.col("invoice_date"), YEAR))
    monthly = of_year.groupBy(F.month("invoice_date").alias("month")).agg(count().alias("invoices"))
    return on_month_spine(t.spark, monthly)


LISTED = f"""SELECT event_id, list_sort(list_distinct(CASE
      WHEN period = 'yearly' THEN range(1, 13)
      WHEN period = 'quarterly' AND coalesce(months, '') = '' THEN
        CASE WHEN quarter BETWEEN 1 AND 4 THEN range(quarter * 3 - 2, quarter * 3 + 1) ELSE [] END
      WHEN coalesce(months, '') = '' THEN []
      ELSE [CAST(x AS BIGINT) FOR x IN string_split(months, ',')] END)) AS list FROM ({REQUEST})"""


@check(
    "s13_split_list_rows",
    f"""SELECT event_id, unnest(list) AS month FROM ({LISTED})""",
    ints="month",
)
def _(t):
    typed = requests.requests(t.request_documents, "document")
    return requests.month_rows(typed).select("event_id", "month")


@check(
    "s14_emptied_list",
    """SELECT account, sum(debit_book - credit_book) AS total_amount FROM journal_line
       WHERE account IN ('4211', '4212', '4221', '4231') GROUP BY account
       UNION ALL SELECT account, 0 FROM journal_line WHERE 1 = 0""",
    money="total_amount",
)
def _(t):
    expenses = (
        t.journal_line.filter(F.col("account").isin("4211", "4212", "4221", "4231"))
        .groupBy("account")
        .agg(F.sum(ledger.book_balance()).alias("total_amount"))
    )
    policy = Policy((Rule("control_period", "buyer", EMPTY, ("expenses",)),))
    shown = policy.apply({"expenses": expenses}, "control_period", "owner")["expenses"]
    hidden = policy.apply({"expenses": expenses}, "control_period", "buyer")["expenses"]
    return shown.unionByName(hidden)


@check(
    "s15_table_profile",
    """SELECT 'charging' AS table_name, count(*) AS row_count FROM charging
       UNION ALL SELECT 'activation', count(*) FROM activation
       UNION ALL SELECT 'redemption', count(*) FROM redemption""",
)
def _(t):
    return profile.table_profile(
        {"charging": t.charging, "activation": t.activation, "redemption": t.redemption}
    )


@check(
    "s16_schema_profile",
    """SELECT 1 AS position, 'glcid' AS column_name, 'int' AS data_type, count(*) - count(glcid) AS null_rows FROM client_master
       UNION ALL SELECT 2, 'name', 'string', count(*) - count(name) FROM client_master
       UNION ALL SELECT 3, 'created_date', 'date', count(*) - count(created_date) FROM client_master
       UNION ALL SELECT 4, 'is_painter', 'int', count(*) - count(is_painter) FROM client_master
       UNION ALL SELECT 5, 'governorate_id', 'int', count(*) - count(governorate_id) FROM client_master""",
)
def _(t):
    return profile.schema_profile(t.client_master).drop("is_nullable")


STOCK = """WITH items AS (SELECT item_id, item_type AS kind, item_extra_description AS extra FROM item_master),
    held AS (SELECT item_code, kind, extra, sum(item_balance) AS item_balance
      FROM item_balance LEFT JOIN items USING (item_id)
      WHERE kind IS NULL OR kind NOT IN ('B', 'S', 'F') GROUP BY ALL HAVING sum(item_balance) <> 0),
    bought AS (SELECT item_code, max({'day': invoice_date, 'invoice': internal_id, 'price': price,
        'currency': invoice_currency, 'rate': invoice_exchange_rate}) AS latest
      FROM purchase_line JOIN purchase_header ON internal_id = int_id WHERE item_code <> '' GROUP BY item_code),
    priced AS (SELECT held.*, coalesce(latest.price, 0) AS last_price, coalesce(latest.rate, 1) AS last_exchange_rate, latest
      FROM held LEFT JOIN bought USING (item_code))
    SELECT item_code, coalesce(kind, 'N/A') AS item_type, coalesce(extra, '') AS item_extra_description, item_balance, last_price,
      coalesce(latest.currency, '') AS last_currency, last_price * item_balance AS item_amount, latest.day AS last_invoice_date,
      last_exchange_rate, last_price * last_exchange_rate * item_balance AS item_amount_base FROM priced"""


@check(
    "s17_stock_export",
    f"""SELECT item_code AS "Item Code", item_type AS "Type", item_extra_description AS "Item Extra Description",
        round(CAST(item_balance AS DOUBLE), 2) AS "Balance",
        rtrim(rtrim(CAST(CAST(last_price AS DECIMAL(38,5)) AS VARCHAR), '0'), '.') || ' ' || last_currency AS "Last Price",
        coalesce(strftime(last_invoice_date, '%Y-%m-%d'), '') AS "Last Invoice Date",
        rtrim(rtrim(CAST(CAST(item_amount AS DECIMAL(38,5)) AS VARCHAR), '0'), '.') || ' ' || last_currency AS "Amount",
        round(CAST(item_amount_base AS DOUBLE), 2) AS "Amount (Base)" FROM ({STOCK})""",
)
def _(t):
    return sinks.stock_export(stock.stock_valuation(t))


@check(
    "s18_safety_stock_export",
    """SELECT item_code AS "Item Code", coalesce(item_type, '') AS "Item Type", item_description AS "Item Description",
       round(CAST(safety_stock AS DOUBLE), 2) AS "Safety Stock", coalesce(purchasing_warehouse, '') AS "Purchasing Warehouse",
       coalesce(production_warehouse, '') AS "Production Warehouse", created_by AS "Created By",
       strftime(created_date, '%Y-%m-%d %H:%M') AS "Created Date", coalesce(last_maint_by, '') AS "Last Maint By",
       coalesce(strftime(last_maint_date, '%Y-%m-%d %H:%M'), '') AS "Last Maint Date" FROM safety_stock""",
)
def _(t):
    return sinks.safety_stock_export(t.safety_stock)


@check(
    "p1_quarter_months",
    f"""SELECT event_id, array_to_string(list, ',') AS month_list FROM ({LISTED})""",
)
def _(t):
    typed = requests.with_month_list(requests.requests(t.request_documents, "document"))
    return typed.select("event_id", F.concat_ws(",", "month_list").alias("month_list"))


def _amount(t, predicate):
    return t.sales_header.filter(predicate).agg(
        count().alias("n"), F.sum(sales.taxable_amount()).alias("amount")
    )


def _amount_sql(where: str) -> str:
    return f"""SELECT count(*) AS n, sum(total_taxable_amount * exchange_rate) AS amount
        FROM sales_header WHERE {where}"""


@check(
    "p2_multi_quarter_months",
    """SELECT month(invoice_date) AS month, count(*) AS n FROM sales_header
       WHERE year(invoice_date) = 2000 AND month(invoice_date) IN (1, 2, 3, 10, 11, 12) GROUP BY 1""",
    ints="month",
)
def _(t):
    period = pd.Period.from_quarters(YEAR, [4, 1, 4])
    rows = t.sales_header.filter(period.date_filter(F.col("invoice_date")))
    return rows.groupBy(F.month("invoice_date").alias("month")).agg(count().alias("n"))


@check(
    "p3_month_set",
    _amount_sql("year(invoice_date) = 2000 AND month(invoice_date) IN (1, 3)"),
    money="amount",
)
def _(t):
    return _amount(t, GAP.date_filter(F.col("invoice_date")))


@check(
    "p3_yearly_pass_through",
    _amount_sql("invoice_year = 2000 AND 1 = 1"),
    money="amount",
)
def _(t):
    invoiced = (F.col("invoice_year") == YEAR) & WHOLE_YEAR.month_filter(F.col("invoice_date"))
    return _amount(t, invoiced)


@check(
    "p4_contiguous_range",
    _amount_sql("invoice_date >= DATE '2000-01-01' AND invoice_date <= DATE '2000-03-31'"),
    money="amount",
)
def _(t):
    return _amount(t, GAP.range_filter(F.col("invoice_date")))


def _balances(t, predicate):
    return (
        t.journal_line.filter(predicate)
        .groupBy("account")
        .agg(F.sum(ledger.book_balance()).alias("balance"))
    )


def _balance_sql(where: str) -> str:
    return f"""SELECT account, sum(debit_book - credit_book) AS balance FROM journal_line
        WHERE {where} GROUP BY account"""


@check("p5_before_period", _balance_sql("journal_date < DATE '2000-04-01'"), money="balance")
def _(t):
    return _balances(t, SECOND_QUARTER.before_start(F.col("journal_date")))


@check("p5_before_year", _balance_sql("journal_date < DATE '2000-01-01'"), money="balance")
def _(t):
    return _balances(t, SECOND_QUARTER.before_year(F.col("journal_date")))


@check("p6_until_period_end", _balance_sql("journal_date <= DATE '2000-06-30'"), money="balance")
def _(t):
    return _balances(t, SECOND_QUARTER.until_end(F.col("journal_date")))


@check(
    "p7_month_end_day",
    """SELECT year(invoice_date) AS year, month(invoice_date) AS month, day(last_day(max(invoice_date))) AS last_day
       FROM sales_header GROUP BY 1, 2""",
    ints="year month last_day",
)
def _(t):
    year, month = F.year("invoice_date").alias("year"), F.month("invoice_date").alias("month")
    return t.sales_header.groupBy(year, month).agg(
        F.day(F.last_day(F.max("invoice_date"))).alias("last_day")
    )


@check(
    "p8_year_to_date",
    _amount_sql("year(invoice_date) = 2000 AND invoice_date <= DATE '2000-06-15'"),
    money="amount",
)
def _(t):
    return _amount(t, pd.ytd(F.col("invoice_date"), YEAR, AS_OF))


@check(
    "p9_year_to_date_prior",
    _amount_sql("year(invoice_date) = 1999 AND invoice_date <= DATE '1999-06-15'"),
    money="amount",
)
def _(t):
    return _amount(t, pd.ytd_prior(F.col("invoice_date"), YEAR, AS_OF))


@check(
    "p10_same_months_prior_year",
    _amount_sql("year(invoice_date) = 1999 AND month(invoice_date) IN (4, 5, 6)"),
    money="amount",
)
def _(t):
    return _amount(t, SECOND_QUARTER.prior_year().date_filter(F.col("invoice_date")))


@check(
    "p11_request_fallback",
    _amount_sql("year(invoice_date) = 2000 AND month(invoice_date) IN (6)"),
    money="amount",
)
def _(t):
    period = pd.Period.from_loyalty_request(None, AS_OF)
    return _amount(t, period.date_filter(F.col("invoice_date")))


@check(
    "p12_months_to_quarters",
    """SELECT CAST(ceil(month(invoice_date) / 3.0) AS INT) AS quarter, count(*) AS n,
       sum(total_taxable_amount * exchange_rate) AS amount FROM sales_header WHERE year(invoice_date) = 2000 GROUP BY 1""",
    money="amount",
)
def _(t):
    rows = t.sales_header.filter(pd.in_year(F.col("invoice_date"), YEAR))
    return rows.groupBy(pd.quarter_of(F.month("invoice_date")).alias("quarter")).agg(
        count().alias("n"), F.sum(sales.taxable_amount()).alias("amount")
    )


@check(
    "p14_period_label",
    """SELECT strftime(min(date_trunc('month', invoice_date)), '%B %Y') AS label, count(*) AS n
       FROM sales_header GROUP BY year(invoice_date), month(invoice_date)""",
)
def _(t):
    label = pd.month_label(F.year("invoice_date"), F.month("invoice_date"))
    return t.sales_header.groupBy(label.alias("label")).agg(count().alias("n"))


def _labelled(label: str, where: str) -> str:
    return f"SELECT '{label}' AS label, count(*) AS n FROM sales_header WHERE year(invoice_date) = 2000 AND {where}"


@check(
    "p14_period_names",
    " UNION ALL ".join(
        [
            _labelled("June 2000", "month(invoice_date) = 6"),
            _labelled("Jan, Mar 2000", "month(invoice_date) IN (1, 3)"),
            _labelled("Q2 2000", "quarter(invoice_date) = 2"),
            _labelled("Q1, Q3 2000", "quarter(invoice_date) IN (1, 3)"),
            _labelled("Year 2000", "1 = 1"),
        ]
    ),
)
def _(t):
    periods = [pd.Period.monthly(YEAR, [6]), GAP, SECOND_QUARTER, pd.Period.from_quarters(YEAR, [1, 3]), WHOLE_YEAR]
    date = F.col("invoice_date")
    counts = [
        t.sales_header.filter(pd.in_year(date, YEAR) & period.month_filter(date)).agg(
            F.lit(period.label).alias("label"), count().alias("n")
        )
        for period in periods
    ]
    return reduce(DataFrame.union, counts)
