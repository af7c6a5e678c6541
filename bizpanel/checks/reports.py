"""Reports, derived figures, access policy and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bizpanel.checks.registry import CHECKS, check
from bizpanel.checks.relational import DETAIL, EVALUATIONS, LEADERS, SAFETY_KPIS, leaders
from bizpanel.checks.scalars import BANK_CURRENCY
from bizpanel.checks.settings import AS_OF, CUSTOMER_TYPE, GAP, SECOND_QUARTER, WHOLE_YEAR, YEAR
from bizpanel.checks.sources import STOCK
from bizpanel.functions import fixed_values as fixed
from bizpanel.operators import aggregates as agg
from bizpanel.operators import maintain
from bizpanel.operators.filters import search
from bizpanel.operators.lineage import ensure_checkpoint_dir
from bizpanel.operators.period import Period
from bizpanel.operators.policy import ALLOW, DENY, EMPTY, MASK, Policy
from bizpanel.plans import (
    cash,
    clients,
    control,
    expenses,
    hr,
    ledger,
    loyalty,
    purchasing,
    sales,
    stock,
    summary,
)
from bizpanel.sources import closing, versions
from bizpanel.sources.tables import Tables, write_table

Q2_HEADER = "invoice_year = 2000 AND month(invoice_date) IN (4, 5, 6)"
Q2_LEDGER = "year(journal_date) = 2000 AND month(journal_date) IN (4, 5, 6)"
MAY_HEADER = "invoice_year = 2000 AND month(invoice_date) = 5"
MAY_LEDGER = "year(journal_date) = 2000 AND month(journal_date) = 5"
SALES = "total_taxable_amount * exchange_rate"
NET = "(total_lines_amount - total_discount) * invoice_exchange_rate"


def _one(measure: str, table: str, where: str) -> str:
    return f"(SELECT {measure} FROM {table} WHERE {where})"


def _collection(where: str) -> str:
    return _one(
        "sum(credit_book)",
        "journal_line",
        "account IN ('1241', '1242') AND substring(journal_no, 1, 2) IN ('GR', 'BT', 'NR') "
        f"AND credit_book > 0 AND {where}",
    )


def _paid(where: str) -> str:
    return _one(
        "sum(debit_book)",
        "journal_line",
        "account IN ('2321', '2322') AND substring(journal_no, 1, 2) IN ('GP', 'BT', 'NP') "
        f"AND debit_book > 0 AND {where}",
    )


def _balance(accounts: str, where: str = "1 = 1") -> str:
    return _one("sum(debit_book - credit_book)", "journal_line", f"account IN ({accounts}) AND {where}")


CUSTOMERS, VENDORS = "'1241', '1242'", "'2321', '2322'"
KPIS = " ".join(control.KPI_COLUMNS)


def _control_sql(header: str, ledger_where: str, balance_where: str) -> str:
    return f"""SELECT {_one(f"sum({SALES})", "sales_header", header)} AS total_sales_amount,
        {_collection(ledger_where)} AS total_collection, {_balance(CUSTOMERS, balance_where)} AS customer_balance,
        {_one(f"sum({NET})", "purchase_header", header)} AS total_purchasing_amount,
        {_paid(ledger_where)} AS total_paid, {_balance(VENDORS, balance_where)} AS vendor_balance"""


@check("r1_control_month", _control_sql(MAY_HEADER, MAY_LEDGER, "1 = 1"), money=KPIS)
def _(t):
    return control.control_month(t, YEAR, 5)


CONTROL_Q2 = _control_sql(Q2_HEADER, Q2_LEDGER, "journal_date <= DATE '2000-06-30'")


@check("r2_control_kpis", CONTROL_Q2, money=KPIS)
def _(t):
    return control.control_period(t, SECOND_QUARTER)["kpis"]


@check(
    "r2_control_kpis_yearly",
    _control_sql("invoice_year = 2000", "year(journal_date) = 2000", "journal_date <= DATE '2000-12-31'"),
    money=KPIS,
)
def _(t):
    return control.control_period(t, WHOLE_YEAR)["kpis"]


EXPENSE_ACCOUNTS = f"""SELECT account, b.account_description, sum(debit_book - credit_book) AS total_amount
    FROM journal_line a LEFT JOIN accounts_master b ON a.account = b.account_number
    WHERE a.account IN ('4211', '4212', '4221', '4231') AND {Q2_LEDGER} GROUP BY 1, 2"""


@check("r2_control_expenses", EXPENSE_ACCOUNTS, money="total_amount")
def _(t):
    return control.control_period(t, SECOND_QUARTER)["expenses"]


CASH_ROWS = "(account LIKE '126%' OR account LIKE '127%') AND account NOT IN ('1278', '1279', '1270')"
CONTROL_CASH = f"""SELECT c.account_group, CASE c.account_group WHEN '126' THEN 'Treasury' WHEN '127' THEN 'Bank' END AS group_name,
      coalesce(o.b, 0) AS opening_balance, c.b AS current_balance, c.b - coalesce(o.b, 0) AS difference
    FROM (SELECT left(account, 3) AS account_group, sum(debit_book - credit_book) AS b FROM journal_line
          WHERE {CASH_ROWS} AND journal_date <= DATE '2000-06-30' GROUP BY 1) c
    LEFT JOIN (SELECT left(account, 3) AS account_group, sum(debit_book - credit_book) AS b FROM journal_line
          WHERE {CASH_ROWS} AND journal_date < DATE '2000-01-01' GROUP BY 1) o ON c.account_group = o.account_group"""


@check("r2_control_cash", CONTROL_CASH, money="opening_balance current_balance difference")
def _(t):
    return control.control_period(t, SECOND_QUARTER)["cash"]


def _purchasing_sql(header: str, line: str, ledger_where: str) -> str:
    raw = _one(
        "sum((line_amount - line_discount) * invoice_exchange_rate)",
        "purchase_line a LEFT JOIN purchase_header b ON a.int_id = b.internal_id",
        f"item_type IN ('R', 'P') AND {line}",
    )
    total = _one(f"sum({NET})", "purchase_header", header)
    local = _one(f"sum({NET})", "purchase_header", f"{header} AND vendor_type LIKE 'N%'")
    return f"""SELECT total_purchasing_amount, local_purchasing, raw_purchasing, total_paid, vendor_balance,
          total_purchasing_amount - local_purchasing AS import_purchasing,
          total_purchasing_amount - raw_purchasing AS other_purchasing FROM
        (SELECT {total} AS total_purchasing_amount, {local} AS local_purchasing, {raw} AS raw_purchasing,
          {_paid(ledger_where)} AS total_paid, {_balance(VENDORS)} AS vendor_balance)"""


PURCHASING_KPIS = (
    "total_purchasing_amount local_purchasing raw_purchasing total_paid vendor_balance "
    "import_purchasing other_purchasing"
)


@check(
    "r3_purchasing_month",
    _purchasing_sql(MAY_HEADER, "inv_year = 2000 AND month(invoice_date) = 5", MAY_LEDGER),
    money=PURCHASING_KPIS,
)
def _(t):
    return purchasing.purchasing_month(t, YEAR, 5)["kpis"]


PURCHASING_Q2 = _purchasing_sql(
    Q2_HEADER, "inv_year = 2000 AND month(b.invoice_date) IN (4, 5, 6)", Q2_LEDGER
)


@check("r4_purchasing_period", PURCHASING_Q2, money=PURCHASING_KPIS)
def _(t):
    return purchasing.purchasing_period(t, SECOND_QUARTER)["kpis"]


TOP_VENDORS = f"""SELECT a.vendor_number, vendor_extra_name AS vendor_name, sum({NET}) AS total_amount
    FROM purchase_header a LEFT JOIN vendor_master b ON a.vendor_number = b.vendor_number
    WHERE {Q2_HEADER} GROUP BY 1, 2 ORDER BY total_amount DESC, 1, 2 LIMIT 10"""


@check("r4_top_vendors", TOP_VENDORS, money="total_amount")
def _(t):
    return purchasing.purchasing_period(t, SECOND_QUARTER)["vendors"]


LOW_BALANCES = """SELECT b.vendor_extra_name AS vendor_name, sum(debit_book - credit_book) AS vendor_balance
    FROM journal_line a LEFT JOIN vendor_master b ON a.vendor = b.vendor_number
    WHERE account IN ('2321', '2322') GROUP BY 1 ORDER BY vendor_balance, vendor_name NULLS FIRST LIMIT 10"""


@check("r4_lowest_balances", LOW_BALANCES, money="vendor_balance")
def _(t):
    return purchasing.purchasing_period(t, SECOND_QUARTER)["balances"]


CURRENT = "year(invoice_date) = 2000 AND invoice_date <= DATE '2000-06-15'"
BEFORE = "year(invoice_date) = 1999 AND invoice_date <= DATE '1999-06-15'"
PERSONS = {
    "white": "sales_person_number LIKE '1%'",
    "color_center": "sales_person_number LIKE '2%'",
    "project": "sales_person_number LIKE '3%'",
    "export": "customer_number LIKE '6%'",
}


def _header_columns(header: str) -> dict[str, str]:
    total = f"sum({SALES})"
    columns = {"total_sales_amount": _one(total, "sales_header", header)}
    for channel, test in PERSONS.items():
        columns[f"{channel}_sales"] = _one(total, "sales_header", f"{header} AND {test}")
    columns["sales_ytd"] = _one(total, "sales_header", CURRENT)
    columns["sales_ytd_prior"] = _one(total, "sales_header", BEFORE)
    columns["export_ytd"] = "coalesce(" + _one(total, "sales_header", f"{CURRENT} AND {PERSONS['export']}") + ", 0)"
    columns["export_ytd_prior"] = _one(total, "sales_header", f"{BEFORE} AND {PERSONS['export']}")
    return columns


def _row_sql(columns: dict[str, str]) -> str:
    return "SELECT " + ",\n".join(f"{sql} AS {name}" for name, sql in columns.items())


MONTH_COLUMNS = _header_columns(MAY_HEADER) | {
    "total_collection": _collection(MAY_LEDGER),
    "customer_balance": _balance(CUSTOMERS),
}


@check("r5_sales_month", _row_sql(MONTH_COLUMNS), money=" ".join(MONTH_COLUMNS))
def _(t):
    return sales.sales_month(t, YEAR, 5, AS_OF)


def _line_columns() -> dict[str, str]:
    windows = {
        "period": "year(a.invoice_date) = 2000 AND month(a.invoice_date) IN (4, 5, 6)",
        "prior": "year(a.invoice_date) = 1999 AND month(a.invoice_date) IN (4, 5, 6)",
        "ytd": "year(a.invoice_date) = 2000 AND a.invoice_date <= DATE '2000-06-15'",
        "ytd_prior": "year(a.invoice_date) = 1999 AND a.invoice_date <= DATE '1999-06-15'",
    }
    joined = "sales_line a LEFT JOIN sales_header b ON a.int_id = b.internal_id"
    with_items = f"{joined} LEFT JOIN item_master i ON a.item_id = i.item_id"
    columns = {}
    for window, where in windows.items():
        weight = "coalesce(sum(a.line_weight), 0)"
        columns[f"total_weight_{window}"] = _one(weight, "sales_line a", where)
        for channel, test in PERSONS.items():
            columns[f"{channel}_weight_{window}"] = _one(weight, joined, f"{where} AND b.{test}")
        columns[f"color_center_volume_{window}"] = _one(
            "coalesce(sum(a.invoiced_quantity * i.volume), 0)",
            with_items,
            f"{where} AND b.{PERSONS['color_center']}",
        )
    return columns


PERIOD_COLUMNS = (
    _header_columns(Q2_HEADER)
    | {"total_final_amount": "coalesce(" + _one("sum(total_final_amount_base)", "sales_header", Q2_HEADER) + ", 0)"}
    | _line_columns()
    | {"total_collection": _collection(Q2_LEDGER), "customer_balance": _balance(CUSTOMERS)}
)
SALES_Q2 = _row_sql(PERIOD_COLUMNS)


@check("r6_sales_period", SALES_Q2, money=" ".join(PERIOD_COLUMNS))
def _(t):
    return sales.sales_period(t, SECOND_QUARTER, AS_OF)


NATIVE = "CASE WHEN line_currency = 'EGP' THEN debit_book - credit_book ELSE debit_txn - credit_txn END"
NATIVE_DEBIT = "CASE WHEN line_currency = 'EGP' THEN debit_book ELSE debit_txn END"
NATIVE_CREDIT = "CASE WHEN line_currency = 'EGP' THEN credit_book ELSE credit_txn END"
# The gap period: months 1 and 3, which cash reads as January to March.
OPENING, IN_RANGE, UNTIL_END = (
    "journal_date < DATE '2000-01-01'",
    "journal_date >= DATE '2000-01-01' AND journal_date <= DATE '2000-03-31'",
    "journal_date <= DATE '2000-03-31'",
)


GROUP_NAMES = "coalesce(MAP {{'126': 'Treasury', '127': 'Bank'}}[{}], 'Other')"


def _summary_sql(until: str) -> str:
    """Each cash line counts once for each of the two dates it lies before; an unknown currency keeps them apart."""
    return f"""SELECT account_group, {GROUP_NAMES.format("account_group")} AS group_name, line_currency,
        coalesce(sum(native) FILTER (side = 'now'), 0) AS balance, coalesce(sum(native) FILTER (side = 'then'), 0) AS opening_balance,
        coalesce(sum(book) FILTER (side = 'now'), 0) AS balance_book, coalesce(sum(book) FILTER (side = 'then'), 0) AS opening_balance_book
      FROM (SELECT left(account, 3) AS account_group, line_currency, {NATIVE} AS native, debit_book - credit_book AS book,
              journal_date, unnest(['now', 'then']) AS side FROM journal_line WHERE {CASH_ROWS})
      WHERE CASE side WHEN 'now' THEN {until} ELSE {OPENING} END
      GROUP BY account_group, line_currency, CASE WHEN line_currency IS NULL THEN side END"""


SUMMARY_MONEY = "balance opening_balance balance_book opening_balance_book"


@check("r7_cash_summary", _summary_sql(UNTIL_END), money=SUMMARY_MONEY)
def _(t):
    return cash.cash_period(t, GAP)["summary"]


STATE = "CASE sign(total_credit - total_debit) WHEN 1 THEN 'Inflow' WHEN -1 THEN 'Outflow' ELSE 'Neutral' END"


def _accounts_sql(openings: str) -> str:
    """Accounts with lines in March 2000. ``openings``: the list of openings that a row p of the totals stands beside."""
    return f"""WITH totals AS (SELECT account, line_currency, sum({NATIVE}) FILTER (NOT in_march) AS opening,
          bool_or(NOT in_march) AS opened, bool_or(in_march) AS moved, sum({NATIVE_DEBIT}) FILTER (in_march) AS total_debit,
          sum({NATIVE_CREDIT}) FILTER (in_march) AS total_credit, sum({NATIVE}) FILTER (in_march) AS movement
        FROM (SELECT *, journal_date >= DATE '2000-03-01' AS in_march FROM journal_line
              WHERE {CASH_ROWS} AND journal_date <= DATE '2000-03-31')
        GROUP BY account, line_currency),
      opened AS (SELECT account, list(opening) AS all_openings FROM totals WHERE opened GROUP BY account),
      rows AS (SELECT p.*, unnest({openings}) AS beside FROM totals p LEFT JOIN opened USING (account) WHERE moved)
      SELECT account, (SELECT any_value(account_description) FROM accounts_master WHERE account_number = account) AS account_description,
        left(account, 3) AS account_group, {GROUP_NAMES.format("left(account, 3)")} AS group_name, line_currency,
        coalesce(beside, 0) AS opening_balance, total_debit, total_credit, movement,
        coalesce(beside, 0) + movement AS closing_balance, {STATE} AS cash_state FROM rows"""


ACCOUNT_MONEY = "opening_balance total_debit total_credit movement closing_balance"
MARCH = Period.monthly(YEAR, [3])


@check(
    "r7_cash_accounts",
    _accounts_sql("[CASE WHEN p.line_currency IS NOT NULL THEN p.opening END]"),
    money=ACCOUNT_MONEY,
)
def _(t):
    return cash.cash_period(t, MARCH)["accounts"]


@check(
    "j6_cash_accounts_strict_parity",
    _accounts_sql("CASE WHEN p.line_currency IS NULL OR all_openings IS NULL THEN [NULL] ELSE all_openings END"),
    money=ACCOUNT_MONEY,
)
def _(t):
    return cash.cash_period(t, MARCH, strict_parity=True)["accounts"]


def _banks_sql(opening: str, in_range: str) -> str:
    """Every bank and currency of the ledger; figures of an unknown currency stay 0."""
    def total(what: str, when: str) -> str:
        return f"coalesce(sum(CASE WHEN line_currency IS NOT NULL THEN {what} END) FILTER ({when}), 0)"

    return f"""SELECT bank, bank_account_name, line_currency, opening_balance, total_debit, total_credit, movement,
        opening_balance + movement AS closing_balance, {STATE} AS cash_state
      FROM (SELECT bank, line_currency, {total(NATIVE, opening)} AS opening_balance, {total(NATIVE_DEBIT, in_range)} AS total_debit,
              {total(NATIVE_CREDIT, in_range)} AS total_credit, {total(NATIVE, in_range)} AS movement
            FROM journal_line WHERE starts_with(account, '127') AND bank <> '' GROUP BY ALL)
      LEFT JOIN bank_accounts_master ON bank_account_number = bank"""


BANKS = _banks_sql(OPENING, IN_RANGE)


@check("r7_bank_balances", BANKS, money=ACCOUNT_MONEY)
def _(t):
    return cash.cash_period(t, GAP)["banks"]


@check(
    "r7_cash_summary_yearly_compacted_ledger",
    _summary_sql("journal_date <= DATE '2000-12-31'"),
    money=SUMMARY_MONEY,
)
def _(t):
    compacted = ledger.compact_years(t.journal_line)
    short = ledger.with_compacted_years(t.journal_line, compacted, YEAR)
    return cash.cash_period(t.replace(journal_line=short), WHOLE_YEAR)["summary"]


PERIOD_SALES = _one(f"coalesce(sum({SALES}), 0)", "sales_header", "year(invoice_date) = 2000 AND month(invoice_date) IN (4, 5, 6)")
EXPENSE_LIST = f"SELECT *, {PERIOD_SALES} AS total_sales_amount FROM ({EXPENSE_ACCOUNTS})"


@check("r8_expense_accounts", EXPENSE_LIST, money="total_amount total_sales_amount")
def _(t):
    return expenses.expenses_period(t, SECOND_QUARTER)["accounts"]


@check(
    "r8_expense_parents",
    f"SELECT parent_description, sum(total_amount) AS total_amount FROM ({DETAIL}) GROUP BY 1",
    money="total_amount",
)
def _(t):
    return expenses.expenses_period(t, SECOND_QUARTER)["parents"]


@check("r8_expense_detail", DETAIL, money="total_amount")
def _(t):
    return expenses.expenses_period(t, SECOND_QUARTER)["detail"]


LEADER_MONEY = "amount_ytd amount_ytd_prior weight_ytd weight_ytd_prior volume_ytd volume_ytd_prior"


@check(
    "r9_customer_breakdown_other",
    leaders("left(customer_sales_person, 1) NOT IN ('1', '2', '3') AND NOT starts_with(customer_no, '6')"),
    money=LEADER_MONEY,
)
def _(t):
    return sales.customer_breakdown(t, "Other", YEAR, AS_OF)


@check(
    "r9_customer_breakdown_export",
    leaders("starts_with(customer_no, '6')"),
    money=LEADER_MONEY,
)
def _(t):
    return sales.customer_breakdown(t, "Export", YEAR, AS_OF)


@check(
    "r9b_customer_monthly_summary",
    f"""SELECT customer_no, summary_year, summary_month, sum(a) AS total_amount, sum(w) AS total_weight, sum(v) AS total_volume,
          CAST(NULL AS VARCHAR) AS customer_name FROM
        (SELECT customer_number AS customer_no, year(invoice_date) AS summary_year, month(invoice_date) AS summary_month,
           {SALES} AS a, 0 AS w, 0 AS v FROM sales_header
         UNION ALL SELECT h.customer_number, year(l.invoice_date), month(l.invoice_date), 0, coalesce(l.line_weight, 0),
           coalesce(l.invoiced_quantity * i.volume, 0) FROM sales_line l JOIN sales_header h ON l.int_id = h.internal_id
           LEFT JOIN item_master i ON l.item_id = i.item_id) GROUP BY 1, 2, 3""",
    money="total_amount total_weight total_volume",
    ints="summary_year summary_month",
)
def _(t):
    return sales.customer_monthly_summary(t)


STOCK_MONEY = "item_balance last_price item_amount last_exchange_rate item_amount_base"


@check("r10_stock_valuation", STOCK, money=STOCK_MONEY, dates="last_invoice_date")
def _(t):
    return stock.stock_valuation(t)


@check("j9_stock_with_last_price", f"SELECT item_code, last_price, last_currency FROM ({STOCK})", money="last_price")
def _(t):
    items = stock.item_stock(t.item_balance, t.item_master)
    priced = stock.with_last_price(items, stock.last_price(t.purchase_header, t.purchase_line))
    return priced.select("item_code", "last_price", "last_currency")


LOYALTY_CONTROL = """SELECT (SELECT coalesce(sum(total_cards), 0) FROM charging WHERE charging_year = 2000) AS total_charging_cards,
      (SELECT coalesce(sum(total_points), 0) FROM charging WHERE charging_year = 2000) AS total_charging_points,
      (SELECT coalesce(sum(total_cards), 0) FROM activation WHERE activation_year = 2000) AS total_active_cards,
      (SELECT coalesce(sum(total_points), 0) FROM activation WHERE activation_year = 2000) AS total_active_points"""


@check(
    "r11_loyalty_control",
    LOYALTY_CONTROL,
    money="total_charging_points total_active_points",
    longs="total_charging_cards total_active_cards",
)
def _(t):
    return loyalty.loyalty_control(t, YEAR)


def _summary_columns() -> dict[str, str]:
    columns = {}
    for side, year in (("cy", 2000), ("py", 1999)):
        charged, active = f"charging_year = {year}", f"activation_year = {year}"
        redeemed = f"redemption_year = {year}"
        columns |= {
            f"{side}_charging_cards": _one("coalesce(sum(total_cards), 0)", "charging", charged),
            f"{side}_charging_points": _one("coalesce(sum(total_points), 0)", "charging", charged),
            f"{side}_active_cards": _one("coalesce(sum(total_cards), 0)", "activation", active),
            f"{side}_active_points": _one("coalesce(sum(total_points), 0)", "activation", active),
            f"{side}_redeem_requests": _one("count(*)", "redemption", redeemed),
            f"{side}_redeem_points": _one("coalesce(sum(gift_point), 0)", "redemption", redeemed),
            f"{side}_redeem_amount": _one("coalesce(sum(offer_value), 0)", "redemption", redeemed),
            f"{side}_year_charging_cards": _one("coalesce(sum(total_cards), 0)", "charging", charged),
            f"{side}_year_active_cards": _one("coalesce(sum(total_cards), 0)", "activation", active),
            f"{side}_active_clients": _one("count(DISTINCT client_id)", "charging", charged),
        }
    return columns


SUMMARY = _row_sql(_summary_columns())
SUMMARY_POINTS = [c for c in _summary_columns() if c.endswith(("points", "amount"))]
SUMMARY_COUNTS = [c for c in _summary_columns() if c not in SUMMARY_POINTS]


@check("r12_loyalty_summary", SUMMARY, money=" ".join(SUMMARY_POINTS), longs=" ".join(SUMMARY_COUNTS))
def _(t):
    return loyalty.summary(t, YEAR)


def _trend_sql(months: str) -> str:
    parts, columns = [], []
    for side, year in (("cy", 2000), ("py", 1999)):
        parts.append(
            f"""LEFT JOIN (SELECT charging_month AS k, sum(total_cards) AS cards, sum(total_points) AS points,
              count(DISTINCT client_id) AS clients FROM charging WHERE charging_year = {year} GROUP BY 1) c{side} ON c{side}.k = m.month
            LEFT JOIN (SELECT activation_month AS k, sum(total_cards) AS cards, sum(total_points) AS points
              FROM activation WHERE activation_year = {year} GROUP BY 1) a{side} ON a{side}.k = m.month
            LEFT JOIN (SELECT month(created_date) AS k, count(*) AS n FROM client_master
              WHERE year(created_date) = {year} GROUP BY 1) j{side} ON j{side}.k = m.month"""
        )
        columns += [
            f"coalesce(c{side}.cards, 0) AS {side}_charging_cards",
            f"coalesce(c{side}.points, 0) AS {side}_charging_points",
            f"coalesce(a{side}.cards, 0) AS {side}_active_cards",
            f"coalesce(a{side}.points, 0) AS {side}_active_points",
            f"coalesce(c{side}.clients, 0) AS {side}_active_clients",
            f"coalesce(j{side}.n, 0) AS {side}_joined_clients",
        ]
    return f"SELECT m.month, {', '.join(columns)} FROM range(1, 13) m(month) {' '.join(parts)} WHERE {months}"


TREND_MONEY = [m for m in loyalty.TREND_MEASURES if m.endswith("points")]
TREND_LONGS = [m for m in loyalty.TREND_MEASURES if not m.endswith("points")]
TREND_Q2 = _trend_sql("m.month IN (4, 5, 6)")


@check(
    "r13_loyalty_trend", TREND_Q2, money=" ".join(TREND_MONEY), longs=" ".join(TREND_LONGS), ints="month"
)
def _(t):
    return loyalty.trend(t, SECOND_QUARTER)


QUARTERS = f"""SELECT CAST(ceil(month / 3.0) AS INT) AS quarter, {", ".join(f"sum({m}) AS {m}" for m in loyalty.TREND_MEASURES)}
    FROM ({_trend_sql("1 = 1")}) GROUP BY 1"""


@check("p13_quarterly_trend", QUARTERS, money=" ".join(TREND_MONEY), longs=" ".join(TREND_LONGS))
def _(t):
    return loyalty.quarterly_trend(loyalty.trend(t, WHOLE_YEAR))


CLIENTS_OF_QUARTERS = """SELECT CAST(ceil(charging_month / 3.0) AS INT) AS quarter,
      count(DISTINCT CASE WHEN charging_year = 2000 THEN client_id END) AS cy_active_clients,
      count(DISTINCT CASE WHEN charging_year = 1999 THEN client_id END) AS py_active_clients
    FROM charging WHERE charging_year IN (1999, 2000) GROUP BY 1"""


@check("p13_distinct_clients_by_quarter", CLIENTS_OF_QUARTERS)
def _(t):
    return loyalty.distinct_clients_by_quarter(t, YEAR)


@check(
    "r14_gift_leaderboard",
    """SELECT gift_name, sum(offer_value) AS total_gift_amount, count(*) AS total_requests, sum(gift_point) AS total_points
       FROM redemption WHERE redemption_year = 2000 GROUP BY 1 ORDER BY total_points DESC, gift_name LIMIT 25""",
    money="total_gift_amount total_points",
)
def _(t):
    return loyalty.gifts(t, WHOLE_YEAR)


CARD_TYPES = """SELECT coalesce(c.card_type, a.card_type) AS card_type, coalesce(c.cards, 0) AS total_cards_charged,
      coalesce(c.points, 0) AS total_points_charged, coalesce(a.cards, 0) AS total_cards_activated,
      coalesce(a.points, 0) AS total_points_activated
    FROM (SELECT card_type, sum(total_cards) AS cards, sum(total_points) AS points FROM charging
          WHERE charging_year = 2000 AND charging_month IN (4, 5, 6) GROUP BY 1) c
    FULL JOIN (SELECT card_type, sum(total_cards) AS cards, sum(total_points) AS points FROM activation
          WHERE activation_year = 2000 AND activation_month IN (4, 5, 6) GROUP BY 1) a ON c.card_type = a.card_type"""


@check(
    "r15_card_types",
    CARD_TYPES,
    money="total_points_charged total_points_activated",
    longs="total_cards_charged total_cards_activated",
)
def _(t):
    return loyalty.card_types(t, SECOND_QUARTER)


CLIENT_LIST = """SELECT client_id FROM charging WHERE charging_year = 2000 AND charging_month IN (4, 5, 6)
    UNION SELECT client_id FROM redemption WHERE redemption_year = 2000 AND redemption_month IN (4, 5, 6)"""


@check(
    "r16_client_leaderboard",
    """WITH acts AS (SELECT client_id, charging_year AS y, charging_month AS m, coalesce(total_points, 0) AS charged,
            coalesce(total_cards, 0) AS cards, 0 AS redeemed, 0 AS requests FROM charging
          UNION ALL SELECT client_id, redemption_year, redemption_month, 0, 0, coalesce(gift_point, 0), 1 FROM redemption),
        active AS (SELECT client_id, sum(charged) AS total_charged_points, sum(cards) AS total_charged_cards,
            sum(redeemed) AS total_redeemed_points, sum(requests) AS total_redeem_requests
          FROM acts WHERE y = 2000 AND m BETWEEN 4 AND 6 GROUP BY client_id)
        SELECT active.*, coalesce(name, 'Client #' || client_id) AS client_name FROM active LEFT JOIN client_master ON glcid = client_id
        ORDER BY total_charged_points DESC, client_id, client_name LIMIT 25""",
    money="total_charged_points total_redeemed_points",
    longs="total_charged_cards total_redeem_requests",
)
def _(t):
    return loyalty.clients(t, SECOND_QUARTER)


GOVERNORATES = f"""WITH homes AS (SELECT glcid AS client_id, is_painter, g.name FROM client_master LEFT JOIN governorate g USING (governorate_id))
    SELECT coalesce(name, 'Other') AS governorate, count(DISTINCT client_id) AS total_clients, count(*) FILTER (is_painter = 1) AS total_painters,
      count(*) FILTER (is_painter = 0) AS total_non_painters
    FROM ({CLIENT_LIST}) LEFT JOIN homes USING (client_id) GROUP BY name"""


@check("r17_governorates", GOVERNORATES, longs="total_painters total_non_painters")
def _(t):
    return loyalty.governorates(t, SECOND_QUARTER)


def _redemption_sql(source: str) -> str:
    return f"""SELECT m.month, coalesce(r.n, 0) AS total_requests, coalesce(r.points, 0) AS total_points,
        coalesce(r.amount, 0) AS total_amount FROM range(1, 13) m(month)
      LEFT JOIN (SELECT redemption_month, count(*) AS n, sum(gift_point) AS points, sum(offer_value) AS amount
        FROM redemption WHERE redemption_year = 2000 AND source = '{source}' GROUP BY 1) r ON m.month = r.redemption_month"""


@check("r18_voucher_redemptions", _redemption_sql("NOVA"), money="total_points total_amount", ints="month")
def _(t):
    return loyalty.redemptions(t, WHOLE_YEAR, fixed.VOUCHER_SOURCE)


@check(
    "r18_cash_call_redemptions",
    _redemption_sql("CCALL") + " WHERE m.month IN (4, 5, 6)",
    money="total_points total_amount",
    ints="month",
)
def _(t):
    return loyalty.redemptions(t, SECOND_QUARTER, fixed.CASH_CALL_SOURCE)


@check(
    "r19_client_charging",
    """SELECT charging_year, charging_month, card_type, total_cards, total_points FROM charging WHERE client_id = 85""",
    money="total_points",
    ints="charging_year charging_month total_cards",
)
def _(t):
    return loyalty.client_detail(t, 85)["charging"]


@check(
    "r19_client_redemptions",
    """SELECT redemption_year, redemption_month, gift_name, sum(offer_value) AS gift_amount, count(*) AS total_request,
         sum(gift_point) AS total_point FROM redemption WHERE client_id = 85 GROUP BY 1, 2, 3""",
    money="gift_amount total_point",
    ints="redemption_year redemption_month",
)
def _(t):
    return loyalty.client_detail(t, 85)["redemption"]


PROFILE = """SELECT a.employee_id, a.full_name, a.branch_name, a.department_name, a.division_name, a.job_name,
      (SELECT x.full_name FROM employee_master x WHERE x.employee_id = a.report_to) AS reporting_to, a.joining_date, a.address,
      a.contract_date, a.contract_expired_date, a.state_description AS current_status, a.leaving_date, a.termination_notes,
      CASE WHEN rtrim(a.group_code) = 'W' THEN 'Worker' WHEN rtrim(a.group_code) = 'N' THEN 'Normal Employee' ELSE a.group_code END AS group_code,
      a.education, a.is_manager, a.manager_id,
      coalesce((SELECT sum(x.salary_amount) FROM employee_salary x WHERE x.employee_id = a.employee_id), 0) AS salary_amount,
      'https://images.example.org/hr/' || a.image_id || '-0.jpg' AS photo, a.birthdate, a.tel, a.mob FROM employee a"""
LISTED = f"""{PROFILE} WHERE trim(a.state_description) = 'Working' OR a.employee_id IN
    (SELECT employee_id FROM termination WHERE termination_state = 20 AND year(termination_date) = 2000)"""
PROFILE_DATES = "joining_date contract_date contract_expired_date leaving_date birthdate"


@check("r20_employee_list", LISTED, money="salary_amount", dates=PROFILE_DATES)
def _(t):
    return hr.employee_list(t, AS_OF)


ABSENT = """FROM leave_history a LEFT JOIN leave_master b ON a.leave_id = b.leave_id
    JOIN employee c ON a.employee_id = c.employee_id
    WHERE a.leave_date = DATE '2000-06-15' AND b.leave_type = 2 AND trim(c.group_code) IN ('W', 'N')"""


@check(
    "r21_hr_kpis",
    f"""SELECT active_staff, terminations_this_year, total_salary, joined_this_year, leaves_today, missions_today,
          coalesce(round(CAST(terminations_this_year AS DOUBLE) / nullif(active_staff, 0) * 100, 2), 0) AS turnover_rate FROM
        (SELECT (SELECT count(*) FROM employee WHERE trim(state_description) = 'Working' AND trim(group_code) IN ('W', 'N')) AS active_staff,
          (SELECT count(*) FROM termination WHERE termination_state = 20 AND year(termination_date) = 2000) AS terminations_this_year,
          (SELECT count(*) FROM employee WHERE year(joining_date) = 2000) AS joined_this_year,
          (SELECT coalesce(sum(a.salary_amount), 0) FROM employee_salary a JOIN employee b ON a.employee_id = b.employee_id
             WHERE trim(b.state_description) = 'Working') AS total_salary,
          (SELECT count(DISTINCT a.employee_id) {ABSENT} AND coalesce(b.is_business_leave, 0) <> 1) AS leaves_today,
          (SELECT count(DISTINCT a.employee_id) {ABSENT} AND coalesce(b.is_business_leave, 0) = 1) AS missions_today)""",
    money="total_salary",
)
def _(t):
    return hr.hr_kpis(t, AS_OF)


@check(
    "r22_employee_profiles",
    f"""SELECT p.*, CASE WHEN x.employee_id IS NOT NULL THEN x.termination_date ELSE p.leaving_date END AS termination_date,
          CASE WHEN x.employee_id IS NOT NULL THEN x.termination_note ELSE p.termination_notes END AS termination_note
        FROM ({PROFILE}) p LEFT JOIN (SELECT * FROM termination WHERE termination_state = 20) x ON p.employee_id = x.employee_id""",
    money="salary_amount",
    dates=PROFILE_DATES + " termination_date",
)
def _(t):
    return hr.employee_detail(t, YEAR)["profile"]


@check(
    "r24_termination_override",
    f"""SELECT p.employee_id, CASE WHEN x.employee_id IS NOT NULL THEN x.termination_date ELSE p.leaving_date END AS termination_date
        FROM employee p LEFT JOIN (SELECT * FROM termination WHERE termination_state = 20) x ON p.employee_id = x.employee_id""",
    dates="termination_date",
)
def _(t):
    merged = hr.with_termination(t.employee, hr.confirmed_terminations(t.termination))
    return merged.select("employee_id", "termination_date")


@check(
    "r22_terminations",
    "SELECT employee_id, termination_date, termination_note FROM termination WHERE termination_state = 20",
    dates="termination_date",
)
def _(t):
    return hr.employee_detail(t, YEAR)["terminations"]


@check(
    "r22_salaries",
    """SELECT a.employee_id, a.salary_amount, b.salary_name FROM employee_salary a
       LEFT JOIN salary_master b ON a.salary_id = b.salary_id""",
    money="salary_amount",
)
def _(t):
    return hr.employee_detail(t, YEAR)["salaries"]


SCORED = f"""SELECT *, CASE WHEN target_score > 0 THEN round(CAST(achieved_score AS DOUBLE) / CAST(target_score AS DOUBLE) * 100, 0)
    ELSE 0.0 END AS score_pct FROM ({EVALUATIONS})"""


@check(
    "r22_evaluations",
    f"""SELECT *, CASE WHEN score_pct >= 90 THEN 'green' WHEN score_pct >= 75 THEN 'blue' WHEN score_pct >= 50 THEN 'orange'
          WHEN score_pct > 0 THEN 'red' ELSE 'gray' END AS score_band FROM ({SCORED})""",
    money="target_score achieved_score score_pct",
    ints="evaluation_year evaluation_quarter",
)
def _(t):
    return hr.employee_detail(t, YEAR)["evaluations"]


@check(
    "r22_leave_balances",
    """SELECT employee_id, balance_year, leave_name, balance, CASE WHEN balance <= 0 THEN 'red' WHEN balance <= 3 THEN 'orange'
         WHEN balance > 15 THEN 'green' ELSE 'blue' END AS band FROM
       (SELECT a.employee_id, a.balance_year, b.leave_name, a.open_balance - a.issued - a.approve_needed + a.adjustments AS balance
        FROM leave_balance a LEFT JOIN leave_master b ON a.leave_master_id = b.leave_id WHERE a.balance_year = 2000)""",
    money="balance",
)
def _(t):
    return hr.employee_detail(t, YEAR)["leave_balances"]


@check(
    "r23_leaves_on_date",
    """SELECT a.employee_id, c.full_name, c.department_name, c.branch_name, c.job_name, b.leave_name,
         coalesce(b.is_business_leave, 0) AS is_business_leave,
         'https://images.example.org/hr/' || c.image_id || '-0.jpg' AS photo,
         coalesce((SELECT sum(lb.open_balance - lb.issued - lb.approve_needed + lb.adjustments) FROM leave_balance lb
           WHERE lb.employee_id = a.employee_id AND lb.leave_master_id = b.leave_id AND lb.balance_year = 2000), 0) AS leave_balance_left
       """.replace("leave_balance_left", "leave_days")
    + ABSENT,
    money="leave_days",
)
def _(t):
    return hr.leaves_on(t, AS_OF).withColumnRenamed("leave_balance", "leave_days")


# --- derived figures -------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> 0 AND {b} <> 0 THEN round(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100, 1) END"


def _badge(ratio: str) -> str:
    return f"CASE WHEN {ratio} >= 80 THEN 'On Track' WHEN {ratio} < 80 THEN 'Below Target' END"


@check(
    "r25_control_ratios",
    f"""SELECT *, {_badge("collection_ratio")} AS collection_badge,
          CASE WHEN payment_ratio > 100 THEN 'Over Paid' ELSE {_badge("payment_ratio")} END AS payment_badge FROM
        (SELECT {_ratio("total_collection", "total_sales_amount")} AS collection_ratio,
          {_ratio("total_paid", "total_purchasing_amount")} AS payment_ratio,
          {_ratio("total_active_cards", "total_charging_cards")} AS activation_ratio,
          round(CAST(total_charging_points AS DOUBLE) / total_charging_cards, 1) AS charging_average,
          round(CAST(total_active_points AS DOUBLE) / total_active_cards, 1) AS activation_average,
          round(CAST(total_expenses AS DOUBLE), 2) AS total_expenses,
          round(CAST(total_expenses AS DOUBLE) / CAST(total_sales_amount AS DOUBLE) * 100, 1) AS expense_sales_pct,
          CASE WHEN total_expenses / total_sales_amount * 100 <= 15 THEN 'Within Limit' ELSE 'Over Limit' END AS expense_badge,
          round(CAST(treasury AS DOUBLE), 2) AS treasury_balance, round(CAST(bank_total AS DOUBLE), 2) AS bank_balance,
          round(CAST(treasury + bank_total AS DOUBLE), 2) AS total_cash, round(CAST(moved AS DOUBLE), 2) AS net_movement
         FROM ({CONTROL_Q2}), ({LOYALTY_CONTROL}), (SELECT sum(total_amount) AS total_expenses FROM ({EXPENSE_ACCOUNTS})),
          (SELECT sum(CASE WHEN account_group = '126' THEN current_balance END) AS treasury,
             sum(CASE WHEN account_group = '127' THEN current_balance END) AS bank_total, sum(difference) AS moved
           FROM ({CONTROL_CASH})))""",
)
def _(t):
    report = control.control_period(t, SECOND_QUARTER)
    return control.control_ratios(report, loyalty.loyalty_control(t, YEAR))


def _growth(a: str, b: str) -> str:
    return f"CASE WHEN {a} <> 0 AND {b} <> 0 THEN round(CAST({b} - {a} AS DOUBLE) / CAST({a} AS DOUBLE) * 100, 1) END"


MIX_MONEY = (
    "total_sales total_collection total_final export_sales local_sales white_sales color_center_sales project_sales "
    "ytd_total ytd_total_prior ytd_local ytd_local_prior ytd_export ytd_export_prior other_sales"
)


@check(
    "r26_sales_mix",
    f"""SELECT *, {_badge("collection_ratio")} AS collection_badge FROM (SELECT *,
          round(CAST(total_collection AS DOUBLE) / CAST(total_final AS DOUBLE) * 100, 1) AS collection_ratio,
          {_ratio("local_sales", "total_sales")} AS local_pct, {_ratio("export_sales", "total_sales")} AS export_pct,
          {_ratio("white_sales", "local_sales")} AS white_pct, {_ratio("color_center_sales", "local_sales")} AS color_center_pct,
          {_ratio("project_sales", "local_sales")} AS project_pct, {_ratio("other_sales", "local_sales")} AS other_pct,
          {_growth("ytd_total_prior", "ytd_total")} AS ytd_growth, {_growth("ytd_local_prior", "ytd_local")} AS ytd_local_growth,
          {_growth("ytd_export_prior", "ytd_export")} AS ytd_export_growth
        FROM (SELECT *, greatest(0, local_sales - (white_sales + color_center_sales + project_sales)) AS other_sales FROM
          (SELECT total_sales_amount AS total_sales, total_collection, total_final_amount AS total_final, export_sales,
             total_sales_amount - export_sales AS local_sales, white_sales, color_center_sales, project_sales,
             sales_ytd AS ytd_total, sales_ytd_prior AS ytd_total_prior, sales_ytd - export_ytd AS ytd_local,
             sales_ytd_prior - export_ytd_prior AS ytd_local_prior, export_ytd AS ytd_export,
             export_ytd_prior AS ytd_export_prior FROM ({SALES_Q2}))))""",
    money=MIX_MONEY,
)
def _(t):
    return sales.sales_mix(sales.sales_period(t, SECOND_QUARTER, AS_OF))


def _comparison_sql(current: str, prior: str, total: str) -> str:
    def other(w: str) -> str:
        local = f"greatest(0, total_weight_{w} - export_weight_{w})"
        return f"greatest(0, {local} - (white_weight_{w} + color_center_weight_{w} + project_weight_{w}))"

    rows = [
        (label, f"{c}_weight_{prior}", f"{c}_weight_{current}") for c, label in sales.LABELS.items()
    ]
    rows += [("Other", other(prior), other(current))]
    rows += [(total, f"total_weight_{prior}", f"total_weight_{current}")]
    union = " UNION ALL ".join(
        f"SELECT {i} AS position, '{label}' AS label, CAST({a} AS DOUBLE) AS prior_weight, "
        f"CAST({b} AS DOUBLE) AS current_weight FROM f"
        for i, (label, a, b) in enumerate(rows, 1)
    )
    return f"""WITH f AS ({SALES_Q2}) SELECT *, {_growth("prior_weight", "current_weight")} AS growth_pct FROM ({union})"""


@check("r26_weight_comparison_period", _comparison_sql("period", "prior", "Total Weight"))
def _(t):
    return sales.weight_comparison(sales.sales_period(t, SECOND_QUARTER, AS_OF))


@check("r26_weight_comparison_ytd", _comparison_sql("ytd", "ytd_prior", "Total YTD Weight"))
def _(t):
    return sales.weight_comparison(sales.sales_period(t, SECOND_QUARTER, AS_OF), "ytd")


MIX_PARTS = ("local", "import", "raw", "other")


@check(
    "r27_purchasing_mix",
    f"""SELECT *, CASE WHEN payment_ratio > 100 THEN 'Over Paid' ELSE {_badge("payment_ratio")} END AS payment_badge FROM
        (SELECT total_purchasing_amount AS total_purchasing, {", ".join(f"{p}_purchasing" for p in MIX_PARTS)},
          {", ".join(_ratio(f"{p}_purchasing", "total_purchasing_amount") + f" AS {p}_pct" for p in MIX_PARTS)},
          {_ratio("total_paid", "total_purchasing_amount")} AS payment_ratio FROM ({PURCHASING_Q2}))""",
    money="total_purchasing " + " ".join(f"{p}_purchasing" for p in MIX_PARTS),
)
def _(t):
    return purchasing.purchasing_mix(purchasing.purchasing_period(t, SECOND_QUARTER))["mix"]


@check(
    "r27_vendor_share",
    f"""SELECT vendor_number, vendor_name, total_amount,
          round(CAST(total_amount AS DOUBLE) / max(CAST(total_amount AS DOUBLE)) OVER () * 100, 6) AS bar_pct,
          round(CAST(total_amount AS DOUBLE) / CAST({_one(f"sum({NET})", "purchase_header", Q2_HEADER)} AS DOUBLE) * 100, 1) AS share_pct
        FROM ({TOP_VENDORS})""",
    money="total_amount",
)
def _(t):
    report = purchasing.purchasing_period(t, SECOND_QUARTER)
    shares = purchasing.purchasing_mix(report)["vendors"]
    return shares.withColumn("bar_pct", F.round("bar_pct", 6))


@check(
    "r27_balance_share",
    f"""SELECT vendor_name, vendor_balance,
          round(abs(CAST(vendor_balance AS DOUBLE)) / max(CAST(vendor_balance AS DOUBLE)) OVER () * 100, 6) AS bar_pct,
          round(abs(CAST(vendor_balance AS DOUBLE)) / CAST({_balance(VENDORS)} AS DOUBLE) * 100, 1) AS share_pct
        FROM ({LOW_BALANCES})""",
    money="vendor_balance",
)
def _(t):
    report = purchasing.purchasing_period(t, SECOND_QUARTER)
    shares = purchasing.purchasing_mix(report)["balances"]
    return shares.withColumn("bar_pct", F.round("bar_pct", 6))


@check(
    "r28_expense_parent_share",
    f"""SELECT account, parent, group_total, segments, CASE WHEN group_total <> 0 AND whole <> 0
          THEN round(CAST(group_total AS DOUBLE) / CAST(whole AS DOUBLE) * 100, 1) END AS share_pct FROM
        (SELECT account, coalesce(parent_description, 'Other') AS parent, sum(total_amount) AS group_total, count(*) AS segments,
           sum(sum(total_amount)) OVER (PARTITION BY account) AS whole FROM ({DETAIL}) GROUP BY 1, 2)""",
    money="group_total",
)
def _(t):
    return expenses.expense_share(expenses.expenses_period(t, SECOND_QUARTER))["parents"]


@check(
    "r28_expense_segment_share",
    f"""SELECT account, coalesce(parent_description, 'Other') AS parent, segment9, segment_description, total_amount,
          round(CAST(total_amount AS DOUBLE) / CAST(sum(total_amount) OVER (PARTITION BY account, coalesce(parent_description, 'Other')) AS DOUBLE) * 100, 1) AS share_pct
        FROM ({DETAIL})""",
    money="total_amount",
)
def _(t):
    return expenses.expense_share(expenses.expenses_period(t, SECOND_QUARTER))["segments"]


@check(
    "r28_expense_sales_ratio",
    f"""SELECT *, CASE WHEN expense_sales_pct <= 15 THEN 'Within Limit' ELSE 'Over Limit' END AS badge FROM
        (SELECT *, round(CAST(total_amount AS DOUBLE) / CAST(total_sales_amount AS DOUBLE) * 100, 1) AS expense_sales_pct FROM
          (SELECT * FROM ({EXPENSE_LIST}) UNION ALL SELECT 'Total', 'Total Expenses', sum(total_amount), max(total_sales_amount)
           FROM ({EXPENSE_LIST})))""",
    money="total_amount total_sales_amount",
)
def _(t):
    return expenses.expense_share(expenses.expenses_period(t, SECOND_QUARTER))["accounts"]


@check(
    "r29_cash_cards",
    f"""SELECT account_group, group_name, sum(abs(opening_balance)) AS opening, sum(abs(balance)) AS current,
          sum(abs(balance)) - sum(abs(opening_balance)) AS difference FROM ({_summary_sql(UNTIL_END)})
        WHERE line_currency = 'EGP' OR coalesce(line_currency, '') = '' GROUP BY 1, 2""",
    money="opening current difference",
)
def _(t):
    return cash.cash_cards(cash.cash_period(t, GAP)["summary"], fixed.BASE_CURRENCY)


@check(
    "r29_cash_totals",
    f"""SELECT sum(CASE WHEN account_group = '126' THEN balance END) AS total_treasury,
          sum(CASE WHEN account_group = '127' THEN balance END) AS total_bank, sum(balance) AS grand_total
        FROM ({_summary_sql(UNTIL_END)})""",
    money="total_treasury total_bank grand_total",
)
def _(t):
    return cash.cash_totals(cash.cash_period(t, GAP)["summary"])


@check(
    "r29_bank_totals",
    f"""SELECT line_currency AS currency, count(*) AS banks, sum(abs(closing_balance)) AS total FROM ({BANKS})
        WHERE line_currency = {BANK_CURRENCY} GROUP BY 1""",
    money="total",
)
def _(t):
    return cash.bank_totals(cash.cash_period(t, GAP)["banks"])


@check(
    "r29_active_banks",
    f"""SELECT bank, closing_balance FROM ({BANKS}) WHERE line_currency = 'USD' AND line_currency = {BANK_CURRENCY}
          AND (contains(lower(bank), 'bk') OR contains(lower(coalesce(bank_account_name, '')), 'bk'))""",
    money="closing_balance",
)
def _(t):
    shown = cash.active_banks(cash.cash_period(t, GAP)["banks"], "USD")
    return search(shown, "BK", ["bank", "bank_account_name"]).select("bank", "closing_balance")


def _yoy(kind: str) -> str:
    cy, py = f"cy_{kind}", f"py_{kind}"
    return (
        f"CASE WHEN {py} = 0 THEN CASE WHEN {cy} > 0 THEN 100.0 ELSE 0.0 END "
        f"ELSE round(CAST({cy} - {py} AS DOUBLE) / CAST({py} AS DOUBLE) * 100, 1) END"
    )


def _average(side: str, kind: str) -> str:
    points, cards = f"{side}_{kind}_points", f"{side}_{kind}_cards"
    return f"CASE WHEN {cards} > 0 THEN CAST({points} AS DOUBLE) / CAST({cards} AS DOUBLE) ELSE 0.0 END"


@check(
    "r30_loyalty_summary_ratios",
    f"""SELECT round({_average("cy", "charging")}, 0) AS cy_charging_avg, round({_average("py", "charging")}, 0) AS py_charging_avg,
          round(CAST(cy_year_active_cards AS DOUBLE) / cy_year_charging_cards * 100, 1) AS cy_activation_pct,
          round(CAST(py_year_active_cards AS DOUBLE) / py_year_charging_cards * 100, 1) AS py_activation_pct,
          {_yoy("charging_cards")} AS charging_yoy, {_yoy("active_cards")} AS activation_yoy,
          {_yoy("redeem_amount")} AS redeem_yoy, {_yoy("active_clients")} AS clients_yoy FROM ({SUMMARY})""",
)
def _(t):
    return loyalty.summary_ratios(loyalty.summary(t, YEAR))


TREND_RATIOS = f"""{_yoy("charging_cards")} AS charging_yoy, {_yoy("active_cards")} AS activation_yoy,
    {_yoy("active_clients")} AS clients_yoy, {_yoy("joined_clients")} AS joined_yoy,
    round({_average("cy", "charging")}, 6) AS cy_charging_avg, round({_average("py", "charging")}, 6) AS py_charging_avg,
    round({_average("cy", "active")}, 6) AS cy_active_avg, round({_average("py", "active")}, 6) AS py_active_avg"""
AVERAGES = ("cy_charging_avg", "py_charging_avg", "cy_active_avg", "py_active_avg")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in AVERAGES})


@check(
    "r30_loyalty_trend_ratios",
    f"SELECT *, {TREND_RATIOS} FROM ({TREND_Q2})",
    money=" ".join(TREND_MONEY),
    longs=" ".join(TREND_LONGS),
    ints="month",
)
def _(t):
    return _rounded(loyalty.trend_ratios(loyalty.trend(t, SECOND_QUARTER)))


@check(
    "r30_loyalty_quarter_ratios",
    f"SELECT *, {TREND_RATIOS} FROM ({QUARTERS})",
    money=" ".join(TREND_MONEY),
    longs=" ".join(TREND_LONGS),
)
def _(t):
    quarters = loyalty.quarterly_trend(loyalty.trend(t, WHOLE_YEAR))
    return _rounded(loyalty.trend_ratios(quarters))


@check(
    "r30_loyalty_footer",
    f"""SELECT *, {TREND_RATIOS} FROM (SELECT {", ".join(f"sum({m}) AS {m}" for m in loyalty.TREND_MEASURES)} FROM ({TREND_Q2}))""",
    money=" ".join(TREND_MONEY),
    longs=" ".join(TREND_LONGS),
)
def _(t):
    return _rounded(loyalty.trend_footer(loyalty.trend(t, SECOND_QUARTER)))


@check(
    "r30_card_type_averages",
    f"""SELECT *, round(CASE WHEN total_cards_charged > 0 THEN CAST(total_points_charged AS DOUBLE) / CAST(total_cards_charged AS DOUBLE)
          ELSE 0.0 END, 6) AS card_average FROM ({CARD_TYPES})""",
    money="total_points_charged total_points_activated",
    longs="total_cards_charged total_cards_activated",
)
def _(t):
    averages = loyalty.card_type_averages(loyalty.card_types(t, SECOND_QUARTER))
    return averages.withColumn("card_average", F.round("card_average", 6))


@check(
    "r30_painter_ratio",
    f"""SELECT *, round(CAST(total_painters AS DOUBLE) / total_clients * 100, 1) AS painter_pct FROM ({GOVERNORATES})""",
    longs="total_painters total_non_painters",
)
def _(t):
    return loyalty.painter_ratio(loyalty.governorates(t, SECOND_QUARTER))


GROUP_OF = """CASE WHEN department_name IS NULL THEN 'Corporate Services & HR' ELSE CASE employee_id % 12
      WHEN 0 THEN 'Sales & Marketing' WHEN 1 THEN 'Operations & Production' WHEN 2 THEN 'Warehousing'
      WHEN 3 THEN 'Logistics & Procurement' WHEN 4 THEN 'Finance' WHEN 5 THEN 'Security' WHEN 6 THEN 'Corporate Services & HR'
      WHEN 7 THEN 'IT' WHEN 8 THEN 'Projects & Construction' WHEN 9 THEN 'HSE (Safety & Health)' WHEN 10 THEN 'Services'
      ELSE 'Corporate Services & HR' END END"""
GROUP_ORDER = "[" + ", ".join(f"'{g}'" for g in fixed.DEPARTMENT_GROUP_ORDER) + "]"


@check(
    "r31_department_group_table",
    f"""SELECT *, CASE WHEN sum(total_salary) OVER () > 0
            THEN round(CAST(total_salary AS DOUBLE) / CAST(sum(total_salary) OVER () AS DOUBLE) * 100, 1) ELSE 0.0 END AS salary_pct,
          CASE WHEN active_count > 0 THEN round(CAST(total_salary AS DOUBLE) / active_count, 6) END AS avg_salary FROM
        (SELECT g.position, g.name AS dept_group, count(CASE WHEN e.current_status = 'Working' THEN 1 END) AS active_count,
           count(CASE WHEN e.current_status <> 'Working' THEN 1 END) AS termination_count,
           coalesce(sum(CASE WHEN e.current_status = 'Working' THEN e.salary_amount END), 0) AS total_salary
         FROM (SELECT unnest(range(0, 11)) AS position, unnest({GROUP_ORDER}) AS name) g
         LEFT JOIN (SELECT *, {GROUP_OF} AS own FROM ({LISTED})) e ON e.own = g.name GROUP BY 1, 2)""",
    money="total_salary",
    ints="position",
)
def _(t):
    table = hr.dept_group_table(hr.employee_list(t, AS_OF))
    return table.withColumn("avg_salary", F.round("avg_salary", 6))


@check(
    "r32_drilldown_list",
    f"""SELECT employee_id, full_name, manager_id FROM ({LISTED}) WHERE {GROUP_OF} = 'Corporate Services & HR'
          AND trim(department_name) = 'TESTER1'""",
)
def _(t):
    drill = hr.dept_drilldown(hr.employee_list(t, AS_OF), "Corporate Services & HR", "TESTER1")
    return drill["list"].select("employee_id", "full_name", "manager_id")


@check(
    "r32_drilldown_stats",
    f"""SELECT count(*) AS count, coalesce(sum(salary_amount), 0) AS total_salary FROM ({LISTED}) WHERE {GROUP_OF} = 'Corporate Services & HR'""",
    money="total_salary",
)
def _(t):
    drill = hr.dept_drilldown(hr.employee_list(t, AS_OF), "Corporate Services & HR")
    return drill["stats"]


@check(
    "r32_drilldown_departments",
    f"""SELECT trim(department_name) AS department, count(*) AS count FROM ({LISTED}) WHERE {GROUP_OF} = 'Corporate Services & HR'
          AND trim(coalesce(department_name, '')) <> '' GROUP BY 1""",
)
def _(t):
    drill = hr.dept_drilldown(hr.employee_list(t, AS_OF), "Corporate Services & HR")
    return drill["departments"]


@check(
    "r32_distribution_departments",
    f"""SELECT coalesce(nullif(department_name, ''), 'Unknown') AS name, count(*) AS count,
          round(count(*) / (SELECT count(*) FROM ({LISTED})) * 100, 1) AS pct FROM ({LISTED}) GROUP BY 1""",
)
def _(t):
    return hr.distribution(hr.employee_list(t, AS_OF))["departments"]


@check(
    "r33_kpis_from_list",
    f"""SELECT active_staff, terminations_this_year, joined_this_year,
          CASE WHEN active_staff > 0 THEN round(CAST(terminations_this_year AS DOUBLE) / active_staff * 100, 1) ELSE 0.0 END AS turnover_rate,
          0 AS total_salary, 0 AS leaves_today, 0 AS missions_today FROM
        (SELECT count(*) FILTER (WHERE current_status = 'Working' AND group_code IN ('Worker', 'Normal Employee')) AS active_staff,
           count(*) FILTER (WHERE year(leaving_date) = 2000) AS terminations_this_year,
           count(*) FILTER (WHERE year(joining_date) = 2000) AS joined_this_year FROM ({LISTED}))""",
)
def _(t):
    return hr.kpis_from_list(hr.employee_list(t, AS_OF), AS_OF)


def _facet(name: str, others: str) -> str:
    return f"""SELECT '{name}' AS facet, {name} AS value, count(*) AS rows, count(*) FILTER (WHERE {others}) AS shown
        FROM listed WHERE coalesce({name}, '') <> '' GROUP BY {name}"""


@check(
    "f18_employee_facets",
    f"""WITH listed AS ({LISTED}) {_facet("branch_name", "group_code = 'Worker' AND current_status = 'Working'")}
        UNION ALL {_facet("department_name", "group_code = 'Worker' AND current_status = 'Working'")}
        UNION ALL {_facet("current_status", "group_code = 'Worker'")}
        UNION ALL {_facet("group_code", "current_status = 'Working'")}""",
)
def _(t):
    choices = {"group_code": "Worker", "current_status": "Working", "branch_name": "All"}
    return hr.employee_facets(hr.employee_list(t, AS_OF), choices=choices)


@check(
    "r33_headline_counts",
    f"""SELECT count(*) AS employees, count(*) FILTER (WHERE current_status = 'Working') AS active,
          count(DISTINCT nullif(department_name, '')) AS departments, count(DISTINCT nullif(branch_name, '')) AS branches FROM ({LISTED})""",
)
def _(t):
    return hr.headline_counts(hr.employee_list(t, AS_OF))


LEAVES = f"SELECT a.employee_id, c.department_name, coalesce(b.is_business_leave, 0) AS is_business_leave {ABSENT}"


@check(
    "r34_leaves_by_group",
    f"SELECT {GROUP_OF} AS dept_group, count(*) AS count FROM ({LEAVES}) WHERE is_business_leave <> 1 GROUP BY 1",
)
def _(t):
    return hr.leaves_by_group(hr.leaves_on(t, AS_OF), "leaves")["groups"]


@check(
    "r34_missions",
    f"SELECT employee_id, {GROUP_OF} AS dept_group FROM ({LEAVES}) WHERE is_business_leave = 1",
)
def _(t):
    missions = hr.leaves_by_group(hr.leaves_on(t, AS_OF), "missions")["list"]
    return missions.select("employee_id", "dept_group")


STOCK_KPIS = """SELECT count(*) AS items, count(*) FILTER (WHERE item_type = 'R') AS raw_count,
      count(*) FILTER (WHERE item_type = 'P') AS pack_count, count(*) FILTER (WHERE item_type NOT IN ('R', 'P')) AS others_count,
      count(*) FILTER (WHERE last_price = 0) AS items_without_price,
      coalesce(sum(CASE WHEN item_balance > 0 THEN item_balance END), 0) AS positive_stock,
      coalesce(sum(CASE WHEN item_balance < 0 THEN item_balance END), 0) AS negative_stock,
      coalesce(sum(CASE WHEN item_type = 'R' THEN item_amount_base END), 0) AS raw_value,
      coalesce(sum(CASE WHEN item_type = 'P' THEN item_amount_base END), 0) AS pack_value,
      coalesce(sum(CASE WHEN item_type NOT IN ('R', 'P') THEN item_amount_base END), 0) AS others_value"""
STOCK_SEARCH = "(contains(lower(item_code), 'red') OR contains(lower(item_extra_description), 'red'))"


@check(
    "r35_stock_view",
    f"""SELECT * FROM ({STOCK}) WHERE {STOCK_SEARCH} AND item_type NOT IN ('R', 'P')""",
    money=STOCK_MONEY,
    dates="last_invoice_date",
)
def _(t):
    return stock.stock_view(stock.stock_valuation(t), "Red", "OTHERS", "item_amount_base", False)["list"]


@check(
    "r35_stock_kpis",
    f"{STOCK_KPIS} FROM ({STOCK})",
    money="positive_stock negative_stock raw_value pack_value others_value",
)
def _(t):
    return stock.stock_view(stock.stock_valuation(t))["kpis"]


@check(
    "r36_safety_stock_view",
    """SELECT id, item_code, item_type FROM safety_stock WHERE upper(item_type) = 'R' AND
         (contains(lower(item_code), 'blue') OR contains(lower(item_description), 'blue')
          OR contains(lower(coalesce(purchasing_warehouse, '')), 'blue') OR contains(lower(coalesce(production_warehouse, '')), 'blue'))""",
)
def _(t):
    view = stock.safety_stock_view(t.safety_stock, "blue", "R", "last_maint_date", False)
    return view["list"].select("id", "item_code", "item_type")


@check("r36_safety_stock_kpis", SAFETY_KPIS, money="total_quantity")
def _(t):
    return stock.safety_stock_view(t.safety_stock)["kpis"]


# --- access policy ---------------------------------------------------------

ROLES = Policy.from_rows(
    [
        {"report": "control_period", "role": "seller", "effect": MASK,
         "targets": ("total_purchasing_amount", "total_paid", "vendor_balance")},
        {"report": "control_period", "role": "seller", "effect": EMPTY, "targets": ("expenses", "cash")},
        {"report": "stock_valuation", "role": "storekeeper", "effect": ALLOW},
        {"report": "cash_period", "role": "seller", "effect": DENY},
    ]
)


@check(
    "x1_permitted_report",
    _summary_sql(UNTIL_END),
    money=SUMMARY_MONEY,
)
def _(t):
    return ROLES.apply(cash.cash_period(t, GAP), "cash_period", "treasurer")["summary"]


@check(
    "x2_masked_kpis",
    f"""SELECT total_sales_amount, total_collection, customer_balance, 0 AS total_purchasing_amount, 0 AS total_paid,
          0 AS vendor_balance FROM ({CONTROL_Q2})""",
    money=KPIS,
)
def _(t):
    lists = control.control_period(t, SECOND_QUARTER)
    return ROLES.apply(lists, "control_period", "Seller")["kpis"]


@check(
    "x3_emptied_lists",
    f"""SELECT 'seller' AS role, account_group, current_balance FROM ({CONTROL_CASH}) WHERE 1 = 0
        UNION ALL SELECT 'owner', account_group, current_balance FROM ({CONTROL_CASH})""",
    money="current_balance",
)
def _(t):
    lists = control.control_period(t, SECOND_QUARTER)

    def seen(role):
        shown = ROLES.apply(lists, "control_period", role)["cash"]
        return shown.select(F.lit(role).alias("role"), "account_group", "current_balance")

    return seen("seller").unionByName(seen("owner"))


@check("x4_allow_listed_report", STOCK, money=STOCK_MONEY, dates="last_invoice_date")
def _(t):
    lists = {"items": stock.stock_valuation(t)}
    return ROLES.apply(lists, "stock_valuation", "storekeeper")["items"]


# --- maintenance -----------------------------------------------------------


@check(
    "d1_list_safety_stock",
    "SELECT id, item_code, item_type, safety_stock FROM safety_stock",
    money="safety_stock",
)
def _(t):
    return stock.list_safety_stock(t).select("id", "item_code", "item_type", "safety_stock")


@check(
    "d2_search_items",
    """SELECT item_id, item_extra_description FROM item_master WHERE contains(lower(coalesce(item_extra_description, '')), 'bolt')""",
)
def _(t):
    found = maintain.search_items(t.item_master, "Bolt", ["item_extra_description"])
    return found.select("item_id", "item_extra_description")


def changes(t):
    """Changes for every fifth record and new records for every tenth, some of them wrong."""
    key = F.col("id")
    base = t.safety_stock.withColumn("safety_stock", F.col("safety_stock") - 5)
    base = base.withColumn("item_code", F.when(key % 35 != 0, F.col("item_code")).otherwise(""))
    edited = base.filter(key % 5 == 0)
    added = base.filter(key % 10 == 0).withColumn("id", key + 1_000_000_000)
    return edited.unionByName(added).withColumn(
        "safety_stock", F.col("safety_stock").cast("decimal(18,5)")
    )


CHANGES = """SELECT CASE WHEN k.added THEN id + 1000000000 ELSE id END AS id,
      CASE WHEN id % 35 <> 0 THEN item_code ELSE '' END AS item_code, safety_stock - 5 AS safety_stock
    FROM safety_stock CROSS JOIN (SELECT false AS added UNION ALL SELECT true) k
    WHERE id % 5 = 0 AND (NOT k.added OR id % 10 = 0)"""


@check(
    "d3_upsert",
    f"""SELECT id, item_code, safety_stock FROM safety_stock WHERE id NOT IN
          (SELECT id FROM ({CHANGES}) WHERE item_code <> '' AND safety_stock >= 0)
        UNION ALL SELECT id, item_code, safety_stock FROM ({CHANGES}) WHERE item_code <> '' AND safety_stock >= 0""",
    money="safety_stock",
)
def _(t):
    saved, _rejected = maintain.upsert(
        t.safety_stock, changes(t), "id", maintain.safety_stock_checks()
    )
    return saved.select("id", "item_code", "safety_stock")


@check(
    "d3_rejected_changes",
    f"""SELECT id, CASE WHEN item_code = '' THEN 'item code is required' ELSE 'quantity must be 0 or greater' END AS reason
        FROM ({CHANGES}) WHERE item_code = '' OR safety_stock < 0""",
)
def _(t):
    _saved, rejected = maintain.upsert(
        t.safety_stock, changes(t), "id", maintain.safety_stock_checks()
    )
    return rejected.select("id", "reason")


@check(
    "d4_delete",
    "SELECT id, item_code FROM safety_stock WHERE id NOT IN (SELECT item_id FROM item_master WHERE item_type = 'B')",
)
def _(t):
    withdrawn = t.item_master.filter(F.col("item_type") == "B").select(F.col("item_id").alias("id"))
    return maintain.delete(t.safety_stock, withdrawn, "id").select("id", "item_code")


def _folder(t):
    """A folder of its own in the shared one."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/check-{uuid.uuid4().hex}"


@check(
    "d3_save_and_delete",
    f"""WITH saved AS (SELECT id, item_code, safety_stock FROM safety_stock WHERE id NOT IN
          (SELECT id FROM ({CHANGES}) WHERE item_code <> '' AND safety_stock >= 0)
        UNION ALL SELECT id, item_code, safety_stock FROM ({CHANGES}) WHERE item_code <> '' AND safety_stock >= 0)
        SELECT * FROM saved WHERE id NOT IN (SELECT item_id FROM item_master WHERE item_type = 'B')""",
    money="safety_stock",
)
def _(t):
    path = f"{_folder(t)}/safety_stock"
    versions.publish(t.safety_stock, path)
    maintain.save_upsert(changes(t), path, "id", maintain.safety_stock_checks())
    withdrawn = t.item_master.filter(F.col("item_type") == "B").select(F.col("item_id").alias("id"))
    maintain.save_delete(withdrawn, path, "id")
    return versions.read(t.spark, path).select("id", "item_code", "safety_stock")


@check(
    "d3_new_keys",
    """SELECT id, item_code, safety_stock FROM safety_stock UNION ALL
       SELECT (SELECT max(id) FROM safety_stock) + row_number() OVER (ORDER BY item_id), item_code, safety_stock
       FROM safety_stock WHERE id % 3 = 0""",
    money="safety_stock",
)
def _(t):
    new = t.safety_stock.filter("id % 3 = 0").withColumn("id", F.when(F.col("id") % 2 == 0, 0).cast("bigint"))
    saved, _rejected = maintain.upsert(t.safety_stock, new, "id")
    return saved.select("id", "item_code", "safety_stock")


@check(
    "r9b_refreshed_summary",
    CHECKS["r9b_customer_monthly_summary"].sql,
)
def _(t):
    root = _folder(t)
    for name in ("sales_header", "sales_line", "item_master"):
        table = t[name]
        first = table if name == "item_master" else table.filter(
            (F.year("invoice_date") != 1997) | (F.day("invoice_date") < 20)
        )
        write_table(first, root, name)
    summary.refresh_summary(t.spark, root)
    for name in ("sales_header", "sales_line"):
        write_table(t[name].filter(F.year("invoice_date") == 1997), root, name)
    summary.refresh_summary(t.spark, root)
    stored = Tables.from_parquet(t.spark, root).customer_monthly_summary
    return stored.select(
        "customer_no", "summary_year", "summary_month", "total_amount", "total_weight", "total_volume", "customer_name"
    )


def _stored_client_months(t):
    root = _folder(t)
    write_table(t.charging.filter("charging_year <> 1999 OR charging_month < 6"), root, "charging")
    clients.refresh_client_months(t.spark, root)
    write_table(t.charging.filter("charging_year = 1999"), root, "charging")
    clients.refresh_client_months(t.spark, root)
    return Tables.from_parquet(t.spark, root).client_months


@check("r4_purchasing_of_stored_books", PURCHASING_Q2, money=PURCHASING_KPIS)
def _(t):
    root = _folder(t)
    for name in ("purchase_header", "purchase_line", "journal_line"):
        write_table(t[name], root, name)
    return purchasing.purchasing_period(Tables.from_parquet(t.spark, root), SECOND_QUARTER)["kpis"]


@check("a8_clients_of_stored_quarters", CLIENTS_OF_QUARTERS)
def _(t):
    return clients.active_clients_by_quarter(_stored_client_months(t), YEAR)


@check(
    "a8_clients_of_stored_months",
    """SELECT count(DISTINCT CASE WHEN charging_year = 2000 THEN client_id END) AS cy_active_clients,
         count(DISTINCT CASE WHEN charging_year = 1999 THEN client_id END) AS py_active_clients
       FROM charging WHERE charging_month IN (1, 3)""",
)
def _(t):
    return clients.active_clients(_stored_client_months(t), GAP)


@check(
    "r13_clients_to_date",
    """SELECT CAST(m AS INT) AS month, count(DISTINCT CASE WHEN charging_year = 2000 THEN client_id END) AS cy_active_clients,
         count(DISTINCT CASE WHEN charging_year = 1999 THEN client_id END) AS py_active_clients
       FROM charging JOIN range(1, 13) AS months(m) ON charging_month <= m
       WHERE charging_year IN (1999, 2000) GROUP BY m""",
)
def _(t):
    return clients.active_clients_to_date(clients.client_months(t.charging), YEAR)


@check("r2_cash_of_closed_ledger", CONTROL_CASH, money="opening_balance current_balance difference")
def _(t):
    root = _folder(t)
    write_table(t.journal_line, root, "journal_line")
    closing.close_years(t.spark, root, 1998)
    closing.close_years(t.spark, root, 2000)
    return control.control_period(Tables.from_parquet(t.spark, root), SECOND_QUARTER)["cash"]


@check(
    "a14_division_share",
    """SELECT division_name AS name, count(*) AS count, round(count(*) / (SELECT count(*) FROM employee) * 100, 1) AS pct
       FROM employee GROUP BY 1""",
)
def _(t):
    return agg.count_share(t.employee, "division_name")


@check("r9_customer_breakdown", LEADERS, money=LEADER_MONEY)
def _(t):
    return sales.customer_breakdown(t, CUSTOMER_TYPE, YEAR, AS_OF)
