"""Reports by name: ``run("cash_period", tables, request)``.

A request is the JSON object of one report call, such as
``{"Period": "monthly", "Months": "6", "Quarter": 0, "Year": 2026}``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period
from bizpanel.operators.policy import Policy
from bizpanel.plans import cash, control, expenses, hr, loyalty, purchasing, sales, stock
from bizpanel.sources.tables import Tables

Request = Mapping[str, object]
Report = Callable[[Tables, Request, dt.date], Mapping[str, DataFrame]]


def _month(request: Request) -> tuple[int, int]:
    return int(request["Year"]), int(request["Month"])


def _single(df: DataFrame, name: str = "kpis") -> dict[str, DataFrame]:
    return {name: df}


def _employee_detail(tables: Tables, request: Request, today: dt.date) -> Lists:
    ids = tables.spark.createDataFrame([(int(request["EmployeeID"]),)], "employee_id int")
    return hr.employee_detail(tables, int(request.get("BalanceYear") or today.year), ids)


def _loyalty_period(request: Request, today: dt.date) -> Period:
    return Period.from_loyalty_request(request, today)


REPORTS: dict[str, Report] = {
    "control_month": lambda t, r, d: _single(control.control_month(t, *_month(r))),
    "control_period": lambda t, r, d: control.control_period(t, Period.from_request(r)),
    "purchasing_month": lambda t, r, d: purchasing.purchasing_month(t, *_month(r)),
    "purchasing_period": lambda t, r, d: purchasing.purchasing_period(
        t, Period.from_request(r)
    ),
    "sales_month": lambda t, r, d: _single(sales.sales_month(t, *_month(r), d)),
    "sales_period": lambda t, r, d: _single(sales.sales_period(t, Period.from_request(r), d)),
    "customer_breakdown": lambda t, r, d: _single(
        sales.customer_breakdown(t, r.get("CustomerType"), int(r.get("Year") or 0), d), "customers"
    ),
    "cash_period": lambda t, r, d: cash.cash_period(t, Period.from_request(r)),
    "expenses_period": lambda t, r, d: expenses.expenses_period(t, Period.from_request(r)),
    "stock_valuation": lambda t, r, d: _single(stock.stock_valuation(t), "items"),
    "safety_stock": lambda t, r, d: _single(stock.list_safety_stock(t), "items"),
    "loyalty_control": lambda t, r, d: _single(
        loyalty.loyalty_control(t, _loyalty_period(r, d).year)
    ),
    "loyalty_details": lambda t, r, d: loyalty.loyalty_details(t, _loyalty_period(r, d)),
    "client_detail": lambda t, r, d: loyalty.client_detail(t, int(r["ClientID"])),
    "hr_dashboard": lambda t, r, d: hr.hr_dashboard(t, d),
    "employee_detail": _employee_detail,
    "leaves_today": lambda t, r, d: _single(hr.leaves_on(t, d), "leaves"),
}


def run(
    report: str,
    tables: Tables,
    request: Request | None = None,
    role: str = "",
    policy: Policy | None = None,
    today: dt.date | None = None,
) -> Lists:
    """Lists of a report under a role's policy. Access is checked before any job starts."""
    if report not in REPORTS:
        raise KeyError(f"no report {report!r}")
    rules = policy or Policy()
    rules.check(report, role)
    lists = REPORTS[report](tables, request or {}, today or dt.date.today())
    return rules.apply(lists, report, role)
