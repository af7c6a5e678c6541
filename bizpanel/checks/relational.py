"""Filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizpanel.checks.registry import check, count
from bizpanel.checks.settings import AS_OF, CUSTOMER_TYPE, SECOND_QUARTER, WHOLE_YEAR, YEAR
from bizpanel.checks.sources import STOCK
from bizpanel.functions import classify, fixed_values as fixed, numbers
from bizpanel.operators import aggregates as agg
from bizpanel.operators import filters, hierarchy, joins
from bizpanel.operators.period import in_year
from bizpanel.plans import cash, expenses, hr, ledger, loyalty, purchasing, sales, stock
from bizpanel.sources.requests import requests, with_month_list


# --- filters ---------------------------------------------------------------


@check(
    "f1_stored_year",
    "SELECT count(*) AS n, sum(total_lines_amount) AS amount FROM purchase_header WHERE invoice_year = 2000",
    money="amount",
)
def _(t):
    return t.purchase_header.filter(F.col("invoice_year") == YEAR).agg(
        count().alias("n"), F.sum("total_lines_amount").alias("amount")
    )


def _ledger_rows(t, predicate):
    return t.journal_line.filter(predicate).agg(
        count().alias("n"), F.sum("debit_book").alias("debit"), F.sum("credit_book").alias("credit")
    )


def _ledger_sql(where: str) -> str:
    return f"""SELECT count(*) AS n, sum(debit_book) AS debit, sum(credit_book) AS credit
        FROM journal_line WHERE {where}"""


@check("f2_account_in_list", _ledger_sql("account IN ('2321', '2322')"), money="debit credit")
def _(t):
    return _ledger_rows(t, filters.in_list(F.col("account"), (2321, 2322)))


@check(
    "f3_account_not_in_list",
    _ledger_sql("account NOT IN ('1278', '1279', '1270')"),
    money="debit credit",
)
def _(t):
    return _ledger_rows(t, filters.not_in_list(F.col("account"), fixed.NON_CASH_ACCOUNTS))


@check(
    "f4_prefix",
    _ledger_sql("account LIKE '126%' OR account LIKE '127%'"),
    money="debit credit",
)
def _(t):
    return _ledger_rows(t, filters.prefix(F.col("account"), "126", "127"))


@check(
    "f5_negative_prefixes",
    """SELECT customer_sales_person, count(*) AS n FROM customer_master
       WHERE customer_sales_person NOT LIKE '1%' AND customer_sales_person NOT LIKE '2%'
         AND customer_sales_person NOT LIKE '3%' AND customer_no NOT LIKE '6%' GROUP BY 1""",
)
def _(t):
    keep = filters.not_prefix(F.col("customer_sales_person"), "1", "2", "3")
    rows = t.customer_master.filter(keep & filters.not_prefix(F.col("customer_no"), "6"))
    return rows.groupBy("customer_sales_person").agg(count().alias("n"))


@check(
    "f6_document_type",
    _ledger_sql("substring(journal_no, 1, 2) IN ('GR', 'BT', 'NR')"),
    money="debit credit",
)
def _(t):
    return _ledger_rows(t, filters.doc_type(F.col("journal_no"), fixed.COLLECTION_DOCUMENTS))


@check("f7_positive_amount", _ledger_sql("credit_book > 0"), money="debit credit")
def _(t):
    return _ledger_rows(t, filters.positive(F.col("credit_book")))


@check(
    "f8_non_empty_text",
    "SELECT item_code, count(*) AS n FROM purchase_line WHERE coalesce(item_code, '') <> '' GROUP BY 1",
)
def _(t):
    rows = t.purchase_line.filter(filters.non_empty(F.col("item_code")))
    return rows.groupBy("item_code").agg(count().alias("n"))


@check(
    "f9_having",
    """SELECT a.item_code, b.item_type, sum(a.item_balance) AS balance FROM item_balance a
       LEFT JOIN item_master b ON a.item_id = b.item_id GROUP BY a.item_code, b.item_type
       HAVING sum(a.item_balance) <> 0 AND coalesce(b.item_type, '') NOT IN ('B', 'S', 'F')""",
    money="balance",
)
def _(t):
    per_item = t.item_balance.groupBy("item_id", "item_code").agg(
        F.sum("item_balance").alias("balance")
    )
    grouped = (
        joins.left_dim(per_item, t.item_master.select("item_id", "item_type"), "item_id")
        .groupBy("item_code", "item_type")
        .agg(F.sum("balance").alias("balance"))
    )
    kind = F.coalesce(F.col("item_type"), F.lit(""))
    return filters.having(
        grouped,
        (F.col("balance") != 0) & filters.not_in_list(kind, fixed.EXCLUDED_STOCK_TYPES),
    )


@check(
    "f10_optional_months",
    """SELECT gift_name, count(*) AS n FROM redemption
       WHERE redemption_year = 2000 AND ('quarterly' = 'yearly' OR redemption_month IN (4, 5, 6)) GROUP BY 1""",
)
def _(t):
    chosen = SECOND_QUARTER.month_number_filter(F.col("redemption_month"))
    rows = t.redemption.filter((F.col("redemption_year") == YEAR) & chosen)
    return rows.groupBy("gift_name").agg(count().alias("n"))


def _kind_rows(t, kind):
    keep = classify.customer_type_filter(
        kind, F.col("customer_sales_person"), F.col("customer_no")
    )
    return t.customer_master.filter(keep).select(F.lit(kind).alias("kind"), "customer_no")


@check(
    "f11_customer_types",
    """SELECT 'White Customers' AS kind, customer_no FROM customer_master
         WHERE customer_sales_person LIKE '1%' AND customer_no NOT LIKE '6%'
       UNION ALL SELECT 'Color Centers', customer_no FROM customer_master
         WHERE customer_sales_person LIKE '2%' AND customer_no NOT LIKE '6%'
       UNION ALL SELECT 'Projects', customer_no FROM customer_master
         WHERE customer_sales_person LIKE '3%' AND customer_no NOT LIKE '6%'
       UNION ALL SELECT 'Export', customer_no FROM customer_master WHERE customer_no LIKE '6%'
       UNION ALL SELECT 'Other', customer_no FROM customer_master
         WHERE customer_sales_person NOT LIKE '1%' AND customer_sales_person NOT LIKE '2%'
           AND customer_sales_person NOT LIKE '3%' AND customer_no NOT LIKE '6%'""",
)
def _(t):
    parts = [_kind_rows(t, kind) for kind in fixed.CUSTOMER_TYPES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@check(
    "f12_state_codes",
    """SELECT employee_id, termination_date FROM termination WHERE termination_state = 20""",
    dates="termination_date",
)
def _(t):
    return hr.confirmed_terminations(t.termination).select("employee_id", "termination_date")


@check(
    "f13_trimmed_text",
    """SELECT group_code, count(*) AS n FROM employee
       WHERE trim(state_description) = 'Working' AND trim(group_code) IN ('W', 'N') GROUP BY 1""",
)
def _(t):
    keep = hr.is_working(F.col("state_description")) & filters.trim_in(
        F.col("group_code"), fixed.STAFF_GROUPS
    )
    return t.employee.filter(keep).groupBy("group_code").agg(count().alias("n"))


@check(
    "f14_text_search",
    """SELECT id, item_code FROM safety_stock WHERE contains(lower(item_code), 'w3')
       OR contains(lower(coalesce(item_description, '')), 'w3')
       OR contains(lower(coalesce(purchasing_warehouse, '')), 'w3')
       OR contains(lower(coalesce(production_warehouse, '')), 'w3')""",
)
def _(t):
    return filters.search(t.safety_stock, "W3", stock.SAFETY_SEARCH_COLUMNS).select(
        "id", "item_code"
    )


@check(
    "f15_facets",
    """SELECT employee_id, full_name FROM employee
       WHERE division_name = 'Division 3' AND group_code = 'W'""",
)
def _(t):
    choices = {
        "division_name": "Division 3",
        "group_code": "W",
        "branch_name": "All",
        "department_name": "",
    }
    return filters.facets(t.employee, choices).select("employee_id", "full_name")


@check(
    "f16_item_buckets",
    """SELECT 'ALL' AS bucket, count(*) AS n FROM item_master
       UNION ALL SELECT 'R', count(*) FROM item_master WHERE item_type = 'R'
       UNION ALL SELECT 'P', count(*) FROM item_master WHERE item_type = 'P'
       UNION ALL SELECT 'OTHERS', count(*) FROM item_master WHERE coalesce(item_type, '') NOT IN ('R', 'P')""",
)
def _(t):
    names = ("ALL", "R", "P", "OTHERS")
    counts = t.item_master.agg(
        *[numbers.count_if(filters.item_bucket(F.col("item_type"), b)).alias(b) for b in names]
    )
    return counts.unpivot([], list(names), "bucket", "n")


@check(
    "f17_projection_defaults",
    """SELECT glcid, coalesce(name, 'Client #' || glcid) AS client_name, coalesce(is_painter, 0) AS painter
       FROM client_master""",
)
def _(t):
    fallback = F.concat(F.lit("Client #"), F.col("glcid").cast("string"))
    return t.client_master.select(
        "glcid",
        F.coalesce(F.col("name"), fallback).alias("client_name"),
        numbers.or_zero(F.col("is_painter")).alias("painter"),
    )


@check(
    "f18_facet_values",
    "SELECT DISTINCT branch_name FROM employee WHERE coalesce(branch_name, '') <> ''",
)
def _(t):
    return filters.facet_values(t.employee, "branch_name")


# --- joins -----------------------------------------------------------------


@check(
    "j1_left_dimension",
    """SELECT a.vendor_number, b.vendor_extra_name AS vendor_name,
         sum((total_lines_amount - total_discount) * invoice_exchange_rate) AS amount
       FROM purchase_header a LEFT JOIN vendor_master b ON a.vendor_number = b.vendor_number GROUP BY 1, 2""",
    money="amount",
)
def _(t):
    totals = t.purchase_header.groupBy("vendor_number").agg(
        F.sum(purchasing.net_amount()).alias("amount")
    )
    return joins.left_dim(totals, t.vendor_master, "vendor_number").select(
        "vendor_number", F.col("vendor_extra_name").alias("vendor_name"), "amount"
    )


@check(
    "j2_header_lines",
    """SELECT h.invoice_currency, count(*) AS n, sum(l.price * h.invoice_exchange_rate) AS amount
       FROM purchase_header h JOIN purchase_line l ON h.internal_id = l.int_id GROUP BY 1""",
    money="amount",
)
def _(t):
    joined = joins.header_lines(t.purchase_header, t.purchase_line)
    return joined.groupBy("invoice_currency").agg(
        count().alias("n"), F.sum(F.col("price") * F.col("invoice_exchange_rate")).alias("amount")
    )


@check(
    "j3_left_join_made_inner",
    """SELECT sum(a.line_weight) AS weight FROM sales_line a LEFT JOIN sales_header b ON a.int_id = b.internal_id
       WHERE year(a.invoice_date) = 2000 AND b.sales_person_number LIKE '1%'""",
    money="weight",
)
def _(t):
    lines = t.sales_line.filter(in_year(F.col("invoice_date"), YEAR))
    per_invoice = lines.groupBy("int_id").agg(F.sum("line_weight").alias("weight"))
    white = t.sales_header.filter(F.col("sales_person_number").startswith("1"))
    joined = joins.semi(per_invoice, white.select(F.col("internal_id").alias("int_id")), "int_id")
    return joined.agg(F.sum("weight").alias("weight"))


@check(
    "j4_full_outer_card_type",
    """SELECT coalesce(c.card_type, a.card_type) AS card_type, c.points AS charged, a.points AS activated FROM
       (SELECT card_type, sum(total_points) AS points FROM charging WHERE charging_year = 2000 GROUP BY 1) c
       FULL JOIN (SELECT card_type, sum(total_points) AS points FROM activation WHERE activation_year = 2000 GROUP BY 1) a
       ON c.card_type = a.card_type""",
    money="charged activated",
)
def _(t):
    charged = (
        t.charging.filter(F.col("charging_year") == YEAR)
        .groupBy("card_type")
        .agg(F.sum("total_points").alias("charged"))
    )
    activated = (
        t.activation.filter(F.col("activation_year") == YEAR)
        .groupBy("card_type")
        .agg(F.sum("total_points").alias("activated"))
    )
    return joins.full_merge(charged, activated, ["card_type"])


@check(
    "j5_two_key_left_join",
    """SELECT m.account, m.line_currency, m.movement, o.opening FROM
       (SELECT account, line_currency, sum(debit_book - credit_book) AS movement FROM journal_line
        WHERE year(journal_date) = 2000 GROUP BY 1, 2) m
       LEFT JOIN (SELECT account, line_currency, sum(debit_book - credit_book) AS opening FROM journal_line
        WHERE journal_date < DATE '2000-01-01' GROUP BY 1, 2) o
       ON m.account = o.account AND m.line_currency = o.line_currency""",
    money="movement opening",
)
def _(t):
    keys = ["account", "line_currency"]
    date = F.col("journal_date")
    balance = F.sum(ledger.book_balance())
    movement = t.journal_line.filter(in_year(date, YEAR)).groupBy(*keys).agg(balance.alias("movement"))
    before = t.journal_line.filter(SECOND_QUARTER.before_year(date))
    return joins.left_dim(movement, before.groupBy(*keys).agg(balance.alias("opening")), keys)


@check(
    "j7_segment_parents",
    """SELECT a.segment9, s1.value_description AS segment_description, s2.value_description AS parent_description,
         count(*) AS n FROM journal_line a
       LEFT JOIN segments_master s1 ON s1.segment_value = a.segment9 AND s1.segment_id = 9
       LEFT JOIN segments_master s2 ON s2.segment_value = s1.parent_value AND s2.segment_id = 9 GROUP BY 1, 2, 3""",
)
def _(t):
    counted = t.journal_line.groupBy("segment9").agg(count().alias("n"))
    return joins.with_parent(counted, t.segments_master, fixed.EXPENSE_SEGMENT_ID).drop(
        "parent_value"
    )


@check(
    "j8_month_spine_star",
    """SELECT m.month, coalesce(c.points, 0) AS charged, coalesce(a.points, 0) AS activated, coalesce(j.n, 0) AS joined
       FROM range(1, 13) m(month)
       LEFT JOIN (SELECT charging_month AS k, sum(total_points) AS points FROM charging WHERE charging_year = 2000 GROUP BY 1) c ON c.k = m.month
       LEFT JOIN (SELECT activation_month AS k, sum(total_points) AS points FROM activation WHERE activation_year = 2000 GROUP BY 1) a ON a.k = m.month
       LEFT JOIN (SELECT month(created_date) AS k, count(*) AS n FROM client_master WHERE year(created_date) = 2000 GROUP BY 1) j ON j.k = m.month""",
    money="charged activated",
    ints="month",
)
def _(t):
    charged = (
        t.charging.filter(F.col("charging_year") == YEAR)
        .groupBy(F.col("charging_month").alias("month"))
        .agg(F.sum("total_points").alias("charged"))
    )
    activated = (
        t.activation.filter(F.col("activation_year") == YEAR)
        .groupBy(F.col("activation_month").alias("month"))
        .agg(F.sum("total_points").alias("activated"))
    )
    joined = (
        t.client_master.filter(in_year(F.col("created_date"), YEAR))
        .groupBy(F.month("created_date").alias("month"))
        .agg(count().alias("joined"))
    )
    parts = [charged, activated, joined]
    return loyalty.by_month(t, WHOLE_YEAR, parts, ("charged", "activated", "joined"))


@check(
    "j10_semi_join",
    """SELECT count(*) AS n, sum(total_points) AS points FROM charging
       WHERE client_id IN (SELECT client_id FROM redemption WHERE source = 'NOVA')""",
    money="points",
)
def _(t):
    redeemers = t.redemption.filter(F.col("source") == fixed.VOUCHER_SOURCE).select("client_id")
    return joins.semi(t.charging, redeemers, "client_id").agg(
        count().alias("n"), F.sum("total_points").alias("points")
    )


@check(
    "j11_exists_under_or",
    """SELECT employee_id FROM employee WHERE trim(state_description) = 'Working'
       OR employee_id IN (SELECT employee_id FROM termination WHERE termination_state = 20 AND year(termination_date) = 2000)""",
)
def _(t):
    return hr.current_or_leaving(t, YEAR).select("employee_id")


@check(
    "j12_manager_name",
    """SELECT a.employee_id, (SELECT x.full_name FROM employee_master x WHERE x.employee_id = a.report_to) AS reporting_to
       FROM employee a""",
)
def _(t):
    named = joins.lookup(
        t.employee, "report_to", t.employee_master, "employee_id", "full_name", "reporting_to"
    )
    return named.select("employee_id", "reporting_to")


@check(
    "j13_scalar_sum",
    """SELECT a.employee_id, coalesce((SELECT sum(x.salary_amount) FROM employee_salary x
         WHERE x.employee_id = a.employee_id), 0) AS salary FROM employee a""",
    money="salary",
)
def _(t):
    return joins.with_scalar_sum(
        t.employee.select("employee_id"),
        t.employee_salary,
        ["employee_id"],
        F.col("salary_amount"),
        "salary",
    )


@check(
    "j14_scalar_attached",
    """SELECT account, sum(debit_book - credit_book) AS total_amount,
         (SELECT sum(total_taxable_amount * exchange_rate) FROM sales_header WHERE year(invoice_date) = 2000) AS sales
       FROM journal_line WHERE year(journal_date) = 2000 GROUP BY account""",
    money="total_amount sales",
)
def _(t):
    accounts = (
        t.journal_line.filter(in_year(F.col("journal_date"), YEAR))
        .groupBy("account")
        .agg(F.sum(ledger.book_balance()).alias("total_amount"))
    )
    of_year = t.sales_header.filter(in_year(F.col("invoice_date"), YEAR))
    return joins.attach_scalar(accounts, of_year.agg(F.sum(sales.taxable_amount())), "sales")


# --- aggregates ------------------------------------------------------------


@check(
    "a1_global_sum",
    "SELECT sum((total_lines_amount - total_discount) * invoice_exchange_rate) AS amount FROM purchase_header",
    money="amount",
)
def _(t):
    return t.purchase_header.agg(F.sum(purchasing.net_amount()).alias("amount"))


@check(
    "a2_filtered_sums",
    """SELECT (SELECT sum(total_taxable_amount * exchange_rate) FROM sales_header
          WHERE invoice_year = 2000 AND month(invoice_date) IN (4, 5, 6)) AS total_sales_amount,
        (SELECT sum(total_taxable_amount * exchange_rate) FROM sales_header
          WHERE invoice_year = 2000 AND month(invoice_date) IN (4, 5, 6) AND sales_person_number LIKE '1%') AS white_sales,
        (SELECT sum(total_taxable_amount * exchange_rate) FROM sales_header
          WHERE invoice_year = 2000 AND month(invoice_date) IN (4, 5, 6) AND customer_number LIKE '6%') AS export_sales,
        (SELECT sum(total_taxable_amount * exchange_rate) FROM sales_header
          WHERE year(invoice_date) = 1999 AND invoice_date <= DATE '1999-06-15') AS sales_ytd_prior""",
    money="total_sales_amount white_sales export_sales sales_ytd_prior",
)
def _(t):
    return sales.header_metrics(t.sales_header, SECOND_QUARTER, AS_OF).select(
        "total_sales_amount", "white_sales", "export_sales", "sales_ytd_prior"
    )


@check(
    "a3_case_sums",
    """SELECT line_currency,
         sum(CASE WHEN line_currency = 'EGP' THEN debit_book ELSE debit_txn END) AS debit,
         sum(CASE WHEN line_currency = 'EGP' THEN credit_book ELSE credit_txn END) AS credit,
         sum(CASE WHEN year(journal_date) = 2000 THEN debit_book ELSE 0 END) AS debit_of_year
       FROM journal_line GROUP BY 1""",
    money="debit credit debit_of_year",
)
def _(t):
    return t.journal_line.groupBy("line_currency").agg(
        F.sum(ledger.native_debit(fixed.BASE_CURRENCY)).alias("debit"),
        F.sum(ledger.native_credit(fixed.BASE_CURRENCY)).alias("credit"),
        numbers.sum_if(in_year(F.col("journal_date"), YEAR), F.col("debit_book")).alias(
            "debit_of_year"
        ),
    )


@check(
    "a4_account_groups",
    """SELECT left(account, 3) AS account_group, sum(debit_book - credit_book) AS balance FROM journal_line GROUP BY 1""",
    money="balance",
)
def _(t):
    return ledger.by_account_group(t.journal_line, ledger.book_balance(), "balance")


DETAIL = """SELECT a.account, b.account_description, a.segment9, s1.value_description AS segment_description,
      s1.parent_value, s2.value_description AS parent_description, sum(debit_book - credit_book) AS total_amount
    FROM journal_line a LEFT JOIN accounts_master b ON a.account = b.account_number
    LEFT JOIN segments_master s1 ON s1.segment_value = a.segment9 AND s1.segment_id = 9
    LEFT JOIN segments_master s2 ON s2.segment_value = s1.parent_value AND s2.segment_id = 9
    WHERE a.account IN ('4211', '4212', '4221', '4231') AND year(journal_date) = 2000
      AND month(journal_date) IN (4, 5, 6) GROUP BY 1, 2, 3, 4, 5, 6"""


@check("a5_hierarchy_keys", DETAIL, money="total_amount")
def _(t):
    return expenses.expense_detail(expenses.expense_base(t.journal_line, SECOND_QUARTER), t)


@check(
    "a6_two_level_totals",
    f"SELECT parent_description, sum(total_amount) AS total_amount FROM ({DETAIL}) GROUP BY 1",
    money="total_amount",
)
def _(t):
    return expenses.expenses_period(t, SECOND_QUARTER)["parents"]


@check(
    "a7_monthly_counts_and_distincts",
    """SELECT charging_month AS month, sum(total_cards) AS cards, count(DISTINCT client_id) AS clients
       FROM charging WHERE charging_year = 2000 GROUP BY 1""",
    ints="month",
    longs="cards",
)
def _(t):
    return (
        loyalty.charging_clients(t.charging, YEAR, "charging_month")
        .filter(F.col("charging_year") == YEAR)
        .groupBy(F.col("charging_month").alias("month"))
        .agg(F.sum("total_cards").alias("cards"), F.count("client_id").alias("clients"))
    )


@check(
    "a8_distinct_clients",
    "SELECT charging_year AS year, count(DISTINCT client_id) AS clients FROM charging GROUP BY 1",
    ints="year",
)
def _(t):
    counted = agg.distinct_count(t.charging, ["charging_year"], "client_id", "clients")
    return counted.withColumnRenamed("charging_year", "year")


@check(
    "a9_row_counts",
    "SELECT year(termination_date) AS year, count(*) AS n FROM termination WHERE termination_state = 20 GROUP BY 1",
    ints="year",
)
def _(t):
    rows = hr.confirmed_terminations(t.termination)
    return rows.groupBy(F.year("termination_date").alias("year")).agg(count().alias("n"))


@check(
    "a10_max_with_default",
    """SELECT customer_no, coalesce(max(customer_name), 'Unknown Customer') AS customer_name
       FROM customer_monthly_summary GROUP BY 1""",
)
def _(t):
    return t.customer_monthly_summary.groupBy("customer_no").agg(
        numbers.max_or(F.col("customer_name"), "Unknown Customer").alias("customer_name")
    )


@check(
    "a11_first_and_last_month",
    """SELECT event_id, list_min([CAST(x AS INT) FOR x IN string_split(months, ',')]) AS first_month,
         list_max([CAST(x AS INT) FOR x IN string_split(months, ',')]) AS last_month
       FROM request WHERE event_id % 10 <> 9 AND coalesce(months, '') <> ''""",
)
def _(t):
    typed = requests(t.request_documents, "document").filter(filters.non_empty(F.col("months")))
    listed = with_month_list(typed)
    return listed.select(
        "event_id",
        F.array_min("month_list").alias("first_month"),
        F.array_max("month_list").alias("last_month"),
    )


@check(
    "a12_bank_list",
    """SELECT DISTINCT a.bank, b.bank_account_name, a.line_currency FROM journal_line a
       LEFT JOIN bank_accounts_master b ON a.bank = b.bank_account_number
       WHERE a.account LIKE '127%' AND a.bank <> ''""",
)
def _(t):
    return cash.bank_list(t.journal_line, t.bank_accounts_master)


@check(
    "a13_year_over_year_columns",
    """SELECT redemption_month AS month, coalesce(sum(CASE WHEN redemption_year = 2000 THEN gift_point END), 0) AS cy_points,
         coalesce(sum(CASE WHEN redemption_year = 1999 THEN gift_point END), 0) AS py_points
       FROM redemption WHERE redemption_year IN (1999, 2000) GROUP BY 1""",
    money="cy_points py_points",
    ints="month",
)
def _(t):
    year = F.col("redemption_year")
    return (
        t.redemption.filter(loyalty.two_years(year, YEAR))
        .groupBy(F.col("redemption_month").alias("month"))
        .agg(*loyalty.cy_py(year, YEAR, {"points": F.col("gift_point")}))
    )


@check(
    "a14_count_share",
    """SELECT name, count, total_amount, round(count / (SELECT count(*) FROM employee) * 100, 1) AS pct FROM
       (SELECT coalesce(e.branch_name, 'Unknown') AS name, count(DISTINCT e.employee_id) AS count,
          coalesce(sum(s.salary_amount), 0) AS total_amount
        FROM employee e LEFT JOIN employee_salary s ON e.employee_id = s.employee_id GROUP BY 1)""",
    money="total_amount",
)
def _(t):
    return hr.distribution(hr.profiles(t, t.employee))["branches"]


@check(
    "a15_category_spine",
    """SELECT g.position, g.name AS dept_group, count(e.employee_id) AS count,
         coalesce(sum(s.amount), 0) AS total_salary
       FROM (SELECT unnest(range(0, 11)) AS position, unnest(['Sales & Marketing', 'Operations & Production', 'Warehousing',
          'Logistics & Procurement', 'Corporate Services & HR', 'Security', 'Services', 'Finance', 'IT',
          'Projects & Construction', 'HSE (Safety & Health)']) AS name) g
       LEFT JOIN (SELECT employee_id, CASE employee_id % 12 WHEN 0 THEN 'Sales & Marketing' WHEN 1 THEN 'Operations & Production'
            WHEN 2 THEN 'Warehousing' WHEN 3 THEN 'Logistics & Procurement' WHEN 4 THEN 'Finance' WHEN 5 THEN 'Security'
            WHEN 6 THEN 'Corporate Services & HR' WHEN 7 THEN 'IT' WHEN 8 THEN 'Projects & Construction'
            WHEN 9 THEN 'HSE (Safety & Health)' WHEN 10 THEN 'Services' ELSE 'Corporate Services & HR' END AS own,
            department_name FROM employee) e
         ON g.name = CASE WHEN e.department_name IS NULL THEN 'Corporate Services & HR' ELSE e.own END
       LEFT JOIN (SELECT employee_id, sum(salary_amount) AS amount FROM employee_salary GROUP BY 1) s
         ON s.employee_id = e.employee_id GROUP BY 1, 2""",
    money="total_salary",
    ints="position",
)
def _(t):
    return hr.dept_group_cards(hr.profiles(t, t.employee))


@check(
    "a16_stock_kpis",
    f"""SELECT count(*) AS items, sum(CASE item_type WHEN 'R' THEN 1 ELSE 0 END) AS raw_count,
         sum(CASE item_type WHEN 'P' THEN 1 ELSE 0 END) AS pack_count,
         sum(CASE WHEN item_type IN ('R', 'P') THEN 0 ELSE 1 END) AS others_count,
         sum(CASE WHEN last_price = 0 THEN 1 ELSE 0 END) AS items_without_price,
         sum(greatest(item_balance, 0)) AS positive_stock, sum(least(item_balance, 0)) AS negative_stock,
         sum(CASE item_type WHEN 'R' THEN item_amount_base ELSE 0 END) AS raw_value,
         sum(CASE item_type WHEN 'P' THEN item_amount_base ELSE 0 END) AS pack_value,
         sum(CASE WHEN item_type IN ('R', 'P') THEN 0 ELSE item_amount_base END) AS others_value FROM ({STOCK})""",
    money="positive_stock negative_stock raw_value pack_value others_value",
    longs="raw_count pack_count others_count items_without_price",
)
def _(t):
    return stock.stock_kpis(stock.stock_valuation(t))


SAFETY_KPIS = """SELECT count(*) AS records, sum(safety_stock) AS total_quantity,
      count(*) FILTER (WHERE upper(item_type) = 'R') AS raw_count,
      count(*) FILTER (WHERE upper(item_type) = 'P') AS pack_count,
      count(*) FILTER (WHERE upper(coalesce(item_type, '')) NOT IN ('R', 'P')) AS others_count,
      (SELECT count(DISTINCT w) FROM (SELECT purchasing_warehouse AS w FROM safety_stock
         UNION ALL SELECT production_warehouse FROM safety_stock) WHERE w <> '') AS warehouses FROM safety_stock"""


@check("a17_safety_kpis", SAFETY_KPIS, money="total_quantity")
def _(t):
    return stock.safety_kpis(t.safety_stock)


@check(
    "a18_footer_totals",
    """SELECT sum(total_requests) AS total_requests, sum(total_points) AS total_points, sum(total_amount) AS total_amount FROM
       (SELECT redemption_month, count(*) AS total_requests, sum(gift_point) AS total_points, sum(offer_value) AS total_amount
        FROM redemption WHERE redemption_year = 2000 AND source = 'NOVA' AND redemption_month IN (4, 5, 6) GROUP BY 1)""",
    money="total_points total_amount",
    longs="total_requests",
)
def _(t):
    rows = loyalty.redemptions(t, SECOND_QUARTER, fixed.VOUCHER_SOURCE)
    return agg.footer_totals(rows, ["total_requests", "total_points", "total_amount"])


def leaders(who: str) -> str:
    """The 25 customers of a kind with the highest amounts from January to June 2000, beside 1999."""
    sums = ", ".join(
        f"coalesce(sum(total_{what}) FILTER (summary_year = {year} AND summary_month <= 6), 0) AS {what}_ytd{suffix}"
        for what in ("amount", "weight", "volume")
        for year, suffix in ((2000, ""), (1999, "_prior"))
    )
    return f"""SELECT customer_no AS customer_number, coalesce(max(customer_name), 'Unknown Customer') AS customer_name, {sums}
      FROM customer_monthly_summary
      WHERE summary_year IN (1999, 2000) AND customer_no IN (SELECT customer_no FROM customer_master WHERE {who})
      GROUP BY customer_no ORDER BY amount_ytd DESC, customer_number LIMIT 25"""


LEADERS = leaders("starts_with(customer_sales_person, '1') AND NOT starts_with(customer_no, '6')")


@check(
    "a19_leaderboard_totals",
    f"""SELECT count(*) AS customers, sum(amount_ytd) AS total_amount, sum(amount_ytd_prior) AS total_amount_prior,
          sum(weight_ytd) AS total_quantity, sum(weight_ytd_prior) AS total_quantity_prior,
          round(CAST(sum(amount_ytd) AS DOUBLE) / count(*), 2) AS average_amount,
          round(CAST(sum(amount_ytd_prior) AS DOUBLE) / count(*), 2) AS average_amount_prior FROM ({LEADERS})""",
    money="total_amount total_amount_prior total_quantity total_quantity_prior",
)
def _(t):
    leaders = sales.customer_breakdown(t, CUSTOMER_TYPE, YEAR, AS_OF)
    totals = sales.leaderboard_totals(leaders, CUSTOMER_TYPE)
    averages = ("average_amount", "average_amount_prior")
    return totals.withColumns({c: F.round(c, 2) for c in averages})


# --- windows ---------------------------------------------------------------


@check(
    "w1_last_price",
    """SELECT item_code, price AS last_price, invoice_currency AS last_currency, invoice_date AS last_invoice_date,
         invoice_exchange_rate AS last_exchange_rate FROM
       (SELECT l.item_code, l.price, h.invoice_currency, h.invoice_date, h.invoice_exchange_rate,
          row_number() OVER (PARTITION BY l.item_code ORDER BY h.invoice_date DESC, h.internal_id DESC, l.price DESC) AS rn
        FROM purchase_header h JOIN purchase_line l ON h.internal_id = l.int_id WHERE coalesce(l.item_code, '') <> '')
       WHERE rn = 1""",
    money="last_price last_exchange_rate",
    dates="last_invoice_date",
)
def _(t):
    return stock.last_price(t.purchase_header, t.purchase_line)


@check(
    "w2_share_of_maximum",
    """SELECT gift_name, points, round(CAST(points AS DOUBLE) / (max(CAST(points AS DOUBLE)) OVER ()) * 100, 6) AS bar_pct
       FROM (SELECT gift_name, sum(gift_point) AS points FROM redemption GROUP BY 1)""",
    money="points",
)
def _(t):
    totals = t.redemption.groupBy("gift_name").agg(F.sum("gift_point").alias("points"))
    shares = agg.share_of_max(totals, F.col("points"), "bar_pct", F.col("points"))
    return shares.withColumn("bar_pct", F.round("bar_pct", 6))


@check(
    "w3_share_of_parent",
    """SELECT account, segment9, amount, CASE WHEN amount <> 0 AND whole <> 0
         THEN round(CAST(amount AS DOUBLE) / CAST(whole AS DOUBLE) * 100, 1) END AS share_pct FROM
       (SELECT account, segment9, sum(debit_book) AS amount, sum(sum(debit_book)) OVER (PARTITION BY account) AS whole
        FROM journal_line GROUP BY 1, 2)""",
    money="amount",
)
def _(t):
    rows = t.journal_line.groupBy("account", "segment9").agg(F.sum("debit_book").alias("amount"))
    return agg.share_of_parent(rows, "amount", ["account"], "share_pct")


# --- order, limits, sets ---------------------------------------------------


@check(
    "t1_top_ten",
    """SELECT vendor_number, sum((total_lines_amount - total_discount) * invoice_exchange_rate) AS amount
       FROM purchase_header GROUP BY 1 ORDER BY amount DESC, vendor_number LIMIT 10""",
    money="amount",
)
def _(t):
    totals = t.purchase_header.groupBy("vendor_number").agg(
        F.sum(purchasing.net_amount()).alias("amount")
    )
    return agg.top_k(totals, 10, [F.col("amount").desc(), F.col("vendor_number").asc()])


@check("t2_top_25_customers", LEADERS, money="amount_ytd amount_ytd_prior weight_ytd weight_ytd_prior volume_ytd volume_ytd_prior")
def _(t):
    return sales.customer_breakdown(t, CUSTOMER_TYPE, YEAR, AS_OF)


EVALUATIONS = """SELECT employee_id, evaluation_year, evaluation_quarter, kpi_description, target_score, achieved_score,
      evaluate_by FROM (SELECT a.*, b.kpi_description, row_number() OVER (PARTITION BY a.employee_id
        ORDER BY a.evaluation_year DESC, a.evaluation_quarter DESC, a.kpi_id, a.target_score DESC, a.achieved_score DESC) AS rn
      FROM kpi_evaluation a LEFT JOIN kpi_master b ON a.kpi_id = b.kpi_id WHERE a.record_state = 30) WHERE rn <= 4"""


@check(
    "t3_latest_four_evaluations",
    EVALUATIONS,
    money="target_score achieved_score",
    ints="evaluation_year evaluation_quarter",
)
def _(t):
    return hr.evaluations(t, None).drop("score_pct", "score_band")


@check(
    "t4_multi_key_sort",
    """SELECT charging_year, charging_month, card_type, sum(total_points) AS points FROM charging
       GROUP BY 1, 2, 3 ORDER BY 1 DESC, 2 DESC, 3""",
    money="points",
    ints="charging_year charging_month",
)
def _(t):
    keys = ["charging_year", "charging_month", "card_type"]
    grouped = t.charging.groupBy(*keys).agg(F.sum("total_points").alias("points"))
    return grouped.orderBy(
        F.col("charging_year").desc(), F.col("charging_month").desc(), F.col("card_type").asc()
    )


@check(
    "t5_sort_by_expression",
    """SELECT bank, line_currency, sum(debit_book - credit_book) AS balance FROM journal_line
       GROUP BY 1, 2 ORDER BY abs(balance) DESC""",
    money="balance",
)
def _(t):
    grouped = t.journal_line.groupBy("bank", "line_currency").agg(
        F.sum(ledger.book_balance()).alias("balance")
    )
    return grouped.orderBy(F.abs("balance").desc(), "bank", F.col("line_currency").asc_nulls_first())


@check(
    "t6_chosen_sort",
    """SELECT id, item_type FROM safety_stock ORDER BY lower(coalesce(item_type, '')) DESC, id""",
)
def _(t):
    shown = agg.sort_by(t.safety_stock, "item_type", ascending=False, tie="id")
    return shown.select("id", "item_type")


@check(
    "t7_manager_sort",
    """SELECT employee_id, manager_id, full_name FROM employee
       ORDER BY coalesce(manager_id, 0), CASE WHEN is_manager = 1 THEN 0 ELSE 1 END, lower(full_name)""",
)
def _(t):
    return hierarchy.manager_sort(t.employee).select("employee_id", "manager_id", "full_name")


@check(
    "t8_preview",
    """SELECT governorate_id, count(*) AS clients FROM client_master GROUP BY 1
       ORDER BY clients DESC, governorate_id LIMIT 10""",
)
def _(t):
    counted = t.client_master.groupBy("governorate_id").agg(count().alias("clients"))
    return agg.preview(
        counted, fixed.PREVIEW_SIZE, [F.col("clients").desc(), F.col("governorate_id").asc()]
    )


@check(
    "u1_client_union",
    """SELECT client_id FROM charging WHERE charging_year = 2000 AND charging_month IN (4, 5, 6)
       UNION SELECT client_id FROM redemption WHERE redemption_year = 2000 AND redemption_month IN (4, 5, 6)""",
)
def _(t):
    return loyalty.active_client_ids(t, SECOND_QUARTER)


@check(
    "u2_union_all",
    """SELECT source, sum(points) AS points FROM (SELECT 'charged' AS source, total_points AS points FROM charging
       UNION ALL SELECT 'activated', total_points FROM activation
       UNION ALL SELECT 'redeemed', gift_point FROM redemption) GROUP BY 1""",
    money="points",
)
def _(t):
    def part(name, df, column):
        return df.select(F.lit(name).alias("source"), F.col(column).alias("points"))

    stacked = (
        part("charged", t.charging, "total_points")
        .unionByName(part("activated", t.activation, "total_points"))
        .unionByName(part("redeemed", t.redemption, "gift_point"))
    )
    return stacked.groupBy("source").agg(F.sum("points").alias("points"))
