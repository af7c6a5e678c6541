"""Scalar functions, classification and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizpanel.checks.registry import check, count
from bizpanel.checks.settings import AS_OF, SECOND_QUARTER, YEAR
from bizpanel.functions import classify, fixed_values as fixed, numbers, text
from bizpanel.operators import hierarchy
from bizpanel.operators.period import ytd, ytd_prior
from bizpanel.plans import cash, expenses, hr, ledger, loyalty, sales
from bizpanel.sources import requests


@check(
    "c1_null_default",
    "SELECT glcid, coalesce(is_painter, -1) AS painter, coalesce(name, '') AS name FROM client_master",
)
def _(t):
    return t.client_master.select(
        "glcid",
        numbers.or_default(F.col("is_painter"), -1).alias("painter"),
        numbers.or_default(F.col("name"), "").alias("name"),
    )


@check(
    "c2_nullif",
    """SELECT employee_id, round(CAST(sum(achieved_score) AS DOUBLE) / nullif(sum(target_score), 0), 6) AS score
       FROM kpi_evaluation GROUP BY 1""",
)
def _(t):
    totals = t.kpi_evaluation.groupBy("employee_id").agg(
        F.sum("achieved_score").alias("achieved"), F.sum("target_score").alias("target")
    )
    target = F.nullif(F.col("target"), F.lit(0)).cast("double")
    return totals.select(
        "employee_id", F.round(F.col("achieved").cast("double") / target, 6).alias("score")
    )


@check(
    "c3_case",
    """SELECT CASE left(account, 3) WHEN '126' THEN 'Treasury' WHEN '127' THEN 'Bank' ELSE 'Other' END AS group_name,
         CASE WHEN credit_book > debit_book THEN 'Inflow' WHEN debit_book > credit_book THEN 'Outflow'
           ELSE 'Neutral' END AS state, count(*) AS n FROM journal_line GROUP BY 1, 2""",
)
def _(t):
    group = classify.account_group_name(classify.account_group(F.col("account")))
    state = classify.cash_state(F.col("debit_book"), F.col("credit_book"))
    return t.journal_line.groupBy(group.alias("group_name"), state.alias("state")).agg(count().alias("n"))


@check(
    "c4_left_right_substring",
    """SELECT left(account, 3) AS account_group, right('0' || month(journal_date), 2) AS month,
         substring(journal_no, 1, 2) AS kind, count(*) AS n FROM journal_line GROUP BY 1, 2, 3""",
)
def _(t):
    return t.journal_line.groupBy(
        classify.account_group(F.col("account")).alias("account_group"),
        F.lpad(F.month("journal_date").cast("string"), 2, "0").alias("month"),
        F.substring("journal_no", 1, 2).alias("kind"),
    ).agg(count().alias("n"))


@check(
    "c5_lower_trim",
    "SELECT lower(trim(state_description)) AS state, count(*) AS n FROM employee GROUP BY 1",
)
def _(t):
    state = F.lower(F.trim("state_description")).alias("state")
    return t.employee.groupBy(state).agg(count().alias("n"))


@check(
    "c6_replace",
    "SELECT replace(bank, 'BK', 'Bank ') AS bank, count(*) AS n FROM journal_line GROUP BY 1",
)
def _(t):
    bank = F.replace(F.col("bank"), F.lit("BK"), F.lit("Bank ")).alias("bank")
    return t.journal_line.groupBy(bank).agg(count().alias("n"))


@check(
    "c7_concat_and_cast",
    "SELECT 'Client #' || CAST(client_id AS VARCHAR) AS client, count(*) AS n FROM charging GROUP BY 1",
)
def _(t):
    client = F.concat(F.lit("Client #"), F.col("client_id").cast("string")).alias("client")
    return t.charging.groupBy(client).agg(count().alias("n"))


@check(
    "c8_date_parts",
    """SELECT year(journal_date) AS year, month(journal_date) AS month, day(journal_date) AS day, count(*) AS n
       FROM journal_line GROUP BY 1, 2, 3""",
    ints="year month day",
)
def _(t):
    date = F.col("journal_date")
    return t.journal_line.groupBy(
        F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day")
    ).agg(count().alias("n"))


@check(
    "c9_month_end_and_year_back",
    """SELECT invoice_date, last_day(invoice_date) AS month_end,
         CAST(invoice_date - INTERVAL 1 YEAR AS DATE) AS year_before, count(*) AS n FROM sales_header GROUP BY 1, 2, 3""",
    dates="invoice_date month_end year_before",
)
def _(t):
    date = F.col("invoice_date")
    return t.sales_header.groupBy(
        date,
        F.last_day(date).alias("month_end"),
        F.add_months(date, -12).alias("year_before"),
    ).agg(count().alias("n"))


@check(
    "c10_casts",
    """SELECT client_id, CAST(sum(total_cards) AS BIGINT) AS cards, CAST(sum(total_points) AS DOUBLE) AS points,
         CAST(sum(total_points) / 1000 AS INT) AS thousands FROM charging GROUP BY 1""",
    money="points",
)
def _(t):
    return t.charging.groupBy("client_id").agg(
        F.sum(loyalty.cards()).alias("cards"),
        F.sum(loyalty.points()).alias("points"),
        F.round(F.sum(loyalty.points()) / 1000, 0).cast("int").alias("thousands"),
    )


@check(
    "c11_json_and_try_cast",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k,
         TRY_CAST(json_extract_string(props, '$.missing') AS INT) AS missing FROM events""",
)
def _(t):
    return t.request_documents.select(
        "event_id",
        requests.json_int(F.col("props"), "$.k").alias("k"),
        requests.json_int(F.col("props"), "$.missing").alias("missing"),
    )


@check(
    "c12_string_split",
    """SELECT trim(part) AS part, count(*) AS n FROM
       (SELECT unnest(string_split(full_name, '#')) AS part FROM employee) GROUP BY 1""",
)
def _(t):
    parts = t.employee.select(F.explode(F.split("full_name", "#")).alias("part"))
    return parts.groupBy(F.trim("part").alias("part")).agg(count().alias("n"))


@check(
    "c13_absolute",
    """SELECT account, abs(sum(debit_book - credit_book)) AS size FROM journal_line GROUP BY 1""",
    money="size",
)
def _(t):
    return t.journal_line.groupBy("account").agg(F.abs(F.sum(ledger.book_balance())).alias("size"))


@check(
    "c14_date_only",
    """SELECT CAST(last_maint_date AS DATE) AS day, count(*) AS n FROM safety_stock
       WHERE CAST(last_maint_date AS DATE) <= DATE '2000-06-15' GROUP BY 1""",
    dates="day",
)
def _(t):
    date = F.to_date("last_maint_date")
    rows = t.safety_stock.filter(date <= F.lit(AS_OF))
    return rows.groupBy(date.alias("day")).agg(count().alias("n"))


@check(
    "c15_clamp",
    """SELECT account, greatest(0, sum(debit_book - credit_book)) AS surplus FROM journal_line GROUP BY 1""",
    money="surplus",
)
def _(t):
    totals = t.journal_line.groupBy("account").agg(F.sum(ledger.book_balance()).alias("b"))
    return totals.select("account", numbers.clamp_zero(F.col("b")).alias("surplus"))


@check(
    "c16_ratio",
    """SELECT customer_no, CASE WHEN amount <> 0 AND weight <> 0
         THEN round(CAST(weight AS DOUBLE) / CAST(amount AS DOUBLE) * 100, 1) END AS ratio FROM
       (SELECT customer_no, sum(total_amount) AS amount, sum(total_weight) AS weight FROM customer_monthly_summary GROUP BY 1)""",
)
def _(t):
    totals = t.customer_monthly_summary.groupBy("customer_no").agg(
        F.sum("total_amount").alias("amount"), F.sum("total_weight").alias("weight")
    )
    return totals.select(
        "customer_no", numbers.ratio_pct(F.col("weight"), F.col("amount")).alias("ratio")
    )


YEARS = """SELECT customer_number, sum(CASE WHEN year(invoice_date) = 2000 AND invoice_date <= DATE '2000-06-15'
      THEN total_taxable_amount ELSE 0 END) AS cy, sum(CASE WHEN year(invoice_date) = 1999 AND invoice_date <= DATE '1999-06-15'
      THEN total_taxable_amount ELSE 0 END) AS py FROM sales_header GROUP BY 1"""


def _years(t):
    date, amount = F.col("invoice_date"), F.col("total_taxable_amount")
    return t.sales_header.groupBy("customer_number").agg(
        numbers.sum_if(ytd(date, YEAR, AS_OF), amount).alias("cy"),
        numbers.sum_if(ytd_prior(date, YEAR, AS_OF), amount).alias("py"),
    )


@check(
    "c17_growth",
    f"""SELECT customer_number, CASE WHEN py <> 0 AND cy <> 0
          THEN round(CAST(cy - py AS DOUBLE) / CAST(py AS DOUBLE) * 100, 1) END AS growth FROM ({YEARS})""",
)
def _(t):
    growth = numbers.growth_pct(F.col("py"), F.col("cy"))
    return _years(t).select("customer_number", F.round(growth, 1).alias("growth"))


YOY = """CASE WHEN py = 0 THEN CASE WHEN cy > 0 THEN {full} ELSE {none} END ELSE {value} END"""


@check(
    "c18_loyalty_year_on_year",
    f"""SELECT customer_number,
          {YOY.format(full="100.0", none="0.0", value="round(CAST(cy - py AS DOUBLE) / CAST(py AS DOUBLE) * 100, 1)")} AS yoy,
          {YOY.format(full="'+100%'", none="'0%'", value="CASE WHEN cy >= py THEN '+' ELSE '' END || format('{:.1f}', round(CAST(cy - py AS DOUBLE) / CAST(py AS DOUBLE) * 100, 1)) || '%'")} AS yoy_text
        FROM ({YEARS})""",
)
def _(t):
    cy, py = F.col("cy"), F.col("py")
    return _years(t).select(
        "customer_number",
        numbers.yoy_pct_loyalty(cy, py).alias("yoy"),
        text.yoy_text_loyalty(cy, py).alias("yoy_text"),
    )


def _abbrev_sql(digits: int, strip: str, small: int) -> str:
    def scaled(unit: str, mark: str) -> str:
        number = f"format('{{:.{digits}f}}', round(abs(x) / {unit}, {digits}))"
        return f"CASE WHEN x < 0 THEN '-' ELSE '' END || regexp_replace({number}, '{strip}', '') || '{mark}'"

    return f"""CASE WHEN x IS NULL THEN '—' WHEN abs(x) >= 1e9 THEN {scaled("1e9", "B")}
        WHEN abs(x) >= 1e6 THEN {scaled("1e6", "M")} WHEN abs(x) >= 1e3 THEN {scaled("1e3", "K")}
        ELSE format('{{:.{small}f}}', round(x, {small})) END"""


@check(
    "c19_abbreviated_numbers",
    rf"""SELECT c_custkey, {_abbrev_sql(1, r"\.0$", 2)} AS amount_text, {_abbrev_sql(1, r"\.0$", 0)} AS count_text,
           {_abbrev_sql(2, r"\.00$", 2)} AS stock_text,
           CASE WHEN x IS NULL THEN '—' WHEN x >= 1e6 THEN regexp_replace(format('{{:.2f}}', round(x / 1e6, 2)), '\.?0+$', '') || 'M EGP'
             WHEN x >= 1e3 THEN regexp_replace(format('{{:.1f}}', round(x / 1e3, 1)), '\.?0+$', '') || 'K EGP'
             ELSE rtrim(rtrim(format('{{:.2f}}', x), '0'), '.') || ' EGP' END AS salary_text
         FROM (SELECT c.c_custkey, round(CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2)))
                 * CASE c.c_custkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 1000 ELSE 1 END AS DOUBLE), 2) + c.c_custkey % 1000 AS x
               FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1)""",
)
def _(t):
    spent = t.sales_header.groupBy("customer_number").agg(
        F.sum("total_taxable_amount").alias("spent")
    )
    key = F.col("customer_no").cast("bigint")
    factor = F.when(key % 3 == 0, -1).when(key % 3 == 1, 1000).otherwise(1)
    joined = t.customer_master.join(
        spent, F.col("customer_no") == F.col("customer_number"), "left"
    )
    amount = F.round((F.col("spent") * factor).cast("double"), 2) + key % 1000
    rows = joined.select(key.alias("c_custkey"), amount.alias("x"))
    x = F.col("x")
    return rows.select(
        "c_custkey",
        text.abbrev_number(x, "amount").alias("amount_text"),
        text.abbrev_number(x, "count").alias("count_text"),
        text.abbrev_number(x, "stock").alias("stock_text"),
        text.abbrev_salary(x, "EGP").alias("salary_text"),
    )


@check(
    "c20_date_text",
    """SELECT employee_id, coalesce(strftime(leaving_date, '%b %-d, %Y'), '—') AS leaving_text,
         strftime(joining_date, '%m/%d/%Y') AS joining_text, strftime(joining_date, '%Y-%m-%d') AS joining_iso FROM employee""",
)
def _(t):
    return t.employee.select(
        "employee_id",
        text.date_text(F.col("leaving_date")).alias("leaving_text"),
        text.date_text(F.col("joining_date"), "numeric").alias("joining_text"),
        text.date_text(F.col("joining_date"), "iso").alias("joining_iso"),
    )


@check(
    "c21_clean_text",
    r"""SELECT regexp_replace(regexp_replace(trim(department_name), '[\x00-\x1F]', '', 'g'), '\s+', ' ', 'g') AS department,
         count(*) AS n FROM employee GROUP BY 1""",
)
def _(t):
    name = text.clean_text(F.col("department_name")).alias("department")
    return t.employee.groupBy(name).agg(count().alias("n"))


@check(
    "c22_badges",
    f"""SELECT customer_number, CASE WHEN r >= 80 THEN 'On Track' WHEN r < 80 THEN 'Below Target' END AS target,
          CASE WHEN r > 100 THEN 'Over Paid' WHEN r >= 80 THEN 'On Track' WHEN r < 80 THEN 'Below Target' END AS payment,
          CASE WHEN r <= 15 THEN 'Within Limit' WHEN r > 15 THEN 'Over Limit' END AS expense
        FROM (SELECT customer_number, CASE WHEN cy <> 0 AND py <> 0
                THEN round(CAST(cy AS DOUBLE) / CAST(py AS DOUBLE) * 100, 1) END AS r FROM ({YEARS}))""",
)
def _(t):
    ratio = numbers.ratio_pct(F.col("cy"), F.col("py"))
    rows = _years(t).select("customer_number", ratio.alias("r"))
    return rows.select(
        "customer_number",
        classify.target_badge(F.col("r")).alias("target"),
        classify.payment_badge(F.col("r")).alias("payment"),
        classify.expense_badge(F.col("r")).alias("expense"),
    )


@check(
    "c23_bands",
    """SELECT CASE WHEN p >= 90 THEN 'green' WHEN p >= 75 THEN 'blue' WHEN p >= 50 THEN 'orange' WHEN p > 0 THEN 'red'
         ELSE 'gray' END AS score, CASE WHEN b <= 0 THEN 'red' WHEN b <= 3 THEN 'orange' WHEN b > 15 THEN 'green'
         ELSE 'blue' END AS leave, count(*) AS n FROM
       (SELECT CASE WHEN e.target_score > 0 THEN round(CAST(e.achieved_score AS DOUBLE) / CAST(e.target_score AS DOUBLE) * 100) ELSE 0 END AS p,
          l.open_balance - l.issued - l.approve_needed + l.adjustments AS b
        FROM kpi_evaluation e JOIN leave_balance l ON e.employee_id = l.employee_id) GROUP BY 1, 2""",
)
def _(t):
    balances = t.leave_balance.select("employee_id", hr.leave_days().alias("b"))
    percent = classify.score_pct(F.col("target_score"), F.col("achieved_score"))
    rows = t.kpi_evaluation.join(balances, "employee_id")
    return rows.groupBy(
        classify.score_band(percent).alias("score"), classify.leave_band(F.col("b")).alias("leave")
    ).agg(count().alias("n"))


@check(
    "c24_url_from_id",
    """SELECT employee_id, 'https://images.example.org/hr/' || image_id || '-0.jpg' AS photo FROM employee""",
)
def _(t):
    return t.employee.select(
        "employee_id", text.photo_url(fixed.PHOTO_BASE_URL, F.col("image_id")).alias("photo")
    )


@check(
    "c25_price_and_unit_text",
    rf"""SELECT item_id, coalesce(CASE WHEN x <> 0 THEN format('{{:,.2f}}', x) || ' EGP' END, '—') AS price_text,
           CASE WHEN x IS NULL THEN '—' ELSE {_abbrev_sql(1, r"\.0$", 2)} || ' kg' END AS weight_text
         FROM (SELECT m.item_id, round(CAST(sum(l.line_weight) * 25 AS DOUBLE), 2) AS x
               FROM item_master m LEFT JOIN sales_line l ON l.item_id = m.item_id GROUP BY 1)""",
)
def _(t):
    sold = t.sales_line.groupBy("item_id").agg(F.sum("line_weight").alias("w"))
    rows = t.item_master.select("item_id").join(sold, "item_id", "left")
    amount = F.round((F.col("w") * 25).cast("double"), 2)
    return rows.select(
        "item_id",
        text.price_text(amount, F.lit("EGP")).alias("price_text"),
        text.unit_text(amount, "kg").alias("weight_text"),
    )


# --- classification and hierarchy -----------------------------------------


@check(
    "k1_sales_channels",
    """SELECT CASE WHEN customer_no LIKE '6%' THEN 'Export' WHEN customer_sales_person LIKE '1%' THEN 'White Customers'
         WHEN customer_sales_person LIKE '2%' THEN 'Color Centers' WHEN customer_sales_person LIKE '3%' THEN 'Projects'
         WHEN customer_sales_person IS NOT NULL THEN 'Other' END AS channel, count(*) AS n FROM customer_master GROUP BY 1""",
)
def _(t):
    channel = classify.sales_channel(F.col("customer_sales_person"), F.col("customer_no"))
    return t.customer_master.groupBy(channel.alias("channel")).agg(count().alias("n"))


@check(
    "k1_channel_amounts",
    """SELECT left(sales_person_number, 1) AS channel,
         coalesce(sum(CASE WHEN year(invoice_date) = 2000 AND month(invoice_date) IN (4, 5, 6) THEN a END), 0) AS amount_period,
         coalesce(sum(CASE WHEN year(invoice_date) = 1999 AND month(invoice_date) IN (4, 5, 6) THEN a END), 0) AS amount_prior,
         coalesce(sum(CASE WHEN year(invoice_date) = 2000 AND invoice_date <= DATE '2000-06-15' THEN a END), 0) AS amount_ytd,
         coalesce(sum(CASE WHEN year(invoice_date) = 1999 AND invoice_date <= DATE '1999-06-15' THEN a END), 0) AS amount_ytd_prior
       FROM (SELECT *, total_taxable_amount * exchange_rate AS a FROM sales_header)
       WHERE year(invoice_date) IN (1999, 2000) GROUP BY 1""",
    money="amount_period amount_prior amount_ytd amount_ytd_prior",
)
def _(t):
    return sales.sales_channels(t.sales_header, SECOND_QUARTER, AS_OF)


@check(
    "k2_account_group_names",
    """SELECT account, CASE left(account, 3) WHEN '126' THEN 'Treasury' WHEN '127' THEN 'Bank' ELSE 'Other' END AS group_name,
         count(*) AS n FROM journal_line GROUP BY 1, 2""",
)
def _(t):
    counted = t.journal_line.groupBy("account").agg(count().alias("n"))
    name = classify.account_group_name(classify.account_group(F.col("account")))
    return counted.select("account", name.alias("group_name"), "n")


@check(
    "k3_department_groups",
    """SELECT dept_group, count(*) AS n FROM (SELECT CASE WHEN department_name IS NULL THEN 'Corporate Services & HR'
         ELSE CASE employee_id % 12 WHEN 0 THEN 'Sales & Marketing' WHEN 1 THEN 'Operations & Production'
           WHEN 2 THEN 'Warehousing' WHEN 3 THEN 'Logistics & Procurement' WHEN 4 THEN 'Finance' WHEN 5 THEN 'Security'
           WHEN 6 THEN 'Corporate Services & HR' WHEN 7 THEN 'IT' WHEN 8 THEN 'Projects & Construction'
           WHEN 9 THEN 'HSE (Safety & Health)' WHEN 10 THEN 'Services' ELSE 'Corporate Services & HR' END END AS dept_group
         FROM employee) GROUP BY 1""",
)
def _(t):
    group = classify.dept_group(F.col("department_name")).alias("dept_group")
    return t.employee.groupBy(group).agg(count().alias("n"))


BANK_CURRENCY = """CASE WHEN contains(upper(bank), 'EG') OR contains(lower(coalesce(bank_account_name, '')), 'egp') THEN 'EGP'
      WHEN contains(upper(bank), 'SD') OR contains(lower(coalesce(bank_account_name, '')), 'usd')
        OR contains(lower(coalesce(bank_account_name, '')), 'dollar') THEN 'USD'
      WHEN contains(upper(bank), 'EU') OR contains(lower(coalesce(bank_account_name, '')), 'eur') THEN 'EUR'
      ELSE line_currency END"""


@check(
    "k4_bank_currency",
    f"""SELECT bank, line_currency, {BANK_CURRENCY} AS currency FROM (SELECT DISTINCT a.bank, b.bank_account_name, a.line_currency
          FROM journal_line a LEFT JOIN bank_accounts_master b ON a.bank = b.bank_account_number
          WHERE a.account LIKE '127%' AND a.bank <> '')""",
)
def _(t):
    banks = cash.bank_list(t.journal_line, t.bank_accounts_master)
    currency = classify.bank_currency(
        F.col("bank"), F.col("bank_account_name"), F.col("line_currency")
    )
    return banks.select("bank", "line_currency", currency.alias("currency"))


@check(
    "k5_staff_group_labels",
    """SELECT CASE WHEN rtrim(group_code) = 'W' THEN 'Worker' WHEN rtrim(group_code) = 'N' THEN 'Normal Employee' ELSE group_code END AS label,
         count(*) AS n FROM employee GROUP BY 1""",
)
def _(t):
    label = classify.staff_group_label(F.col("group_code")).alias("label")
    return t.employee.groupBy(label).agg(count().alias("n"))


@check(
    "k6_cash_states",
    """SELECT bank, CASE WHEN sum(credit_book) > sum(debit_book) THEN 'Inflow' WHEN sum(debit_book) > sum(credit_book) THEN 'Outflow'
         ELSE 'Neutral' END AS state FROM journal_line GROUP BY 1""",
)
def _(t):
    totals = t.journal_line.groupBy("bank").agg(
        F.sum("debit_book").alias("d"), F.sum("credit_book").alias("c")
    )
    return totals.select("bank", classify.cash_state(F.col("d"), F.col("c")).alias("state"))


@check(
    "k7_org_tree",
    """WITH RECURSIVE node AS (SELECT employee_id, CASE WHEN manager_id = 0 THEN NULL ELSE manager_id END AS parent_id,
          CASE WHEN is_manager = 1 THEN '0' ELSE '1' END || lower(full_name) || chr(2) || lpad(CAST(employee_id AS VARCHAR), 20, '0') AS k
          FROM employee),
        tree AS (SELECT employee_id AS root_id, employee_id, 0 AS level, CAST(employee_id AS VARCHAR) AS path, k AS sort_path
          FROM node WHERE parent_id IS NULL OR parent_id NOT IN (SELECT employee_id FROM node)
          UNION ALL SELECT t.root_id, n.employee_id, t.level + 1, t.path || '/' || n.employee_id, t.sort_path || chr(1) || n.k
          FROM node n JOIN tree t ON n.parent_id = t.employee_id)
       SELECT * FROM tree""",
)
def _(t):
    return hierarchy.org_tree(t.employee)


@check(
    "k8_expense_drill",
    """SELECT account, coalesce(s2.value_description, 'Other') AS parent, sum(debit_book - credit_book) AS group_total,
         count(DISTINCT segment9) AS segments FROM journal_line a
       LEFT JOIN segments_master s1 ON s1.segment_value = a.segment9 AND s1.segment_id = 9
       LEFT JOIN segments_master s2 ON s2.segment_value = s1.parent_value AND s2.segment_id = 9
       WHERE account IN ('4211', '4212', '4221', '4231') AND year(journal_date) = 2000 AND month(journal_date) IN (4, 5, 6)
       GROUP BY 1, 2""",
    money="group_total",
)
def _(t):
    return expenses.expense_drill(expenses.expenses_period(t, SECOND_QUARTER)["detail"])
