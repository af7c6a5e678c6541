from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizpanel.functions import classify, fixed_values as fixed, numbers, text
from bizpanel.operators import filters
from bizpanel.sources.requests import is_valid_json, json_int

A = B = None


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    """Columns can be made only once a session exists."""
    global A, B
    A, B = F.col("a"), F.col("b")


def apply(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


PAIRS = [(50.0, 200.0), (0.0, 200.0), (50.0, 0.0), (None, 200.0), (50.0, None), (-10.0, 40.0)]
PAIR = "a double, b double"


def test_ratio_reads_zero_as_missing(spark):
    assert apply(spark, PAIRS, PAIR, numbers.ratio_pct(A, B)) == [25.0, None, None, None, None, -25.0]


def test_pct_of_keeps_a_zero_part(spark):
    assert apply(spark, PAIRS, PAIR, numbers.pct_of(A, B)) == [25.0, 0.0, None, 0.0, None, -25.0]


def test_share_is_zero_without_a_whole(spark):
    assert apply(spark, PAIRS, PAIR, numbers.share_pct(A, B)) == [25.0, 0.0, 0.0, 0.0, 0.0, -25.0]


def test_growth(spark):
    assert apply(spark, PAIRS, PAIR, numbers.growth_pct(A, B)) == [300.0, None, None, None, None, -500.0]


def test_loyalty_year_on_year(spark):
    rows = [(120.0, 100.0), (5.0, 0.0), (0.0, 0.0), (None, 1.0), (80.0, 100.0)]
    assert apply(spark, rows, PAIR, numbers.yoy_pct_loyalty(A, B)) == [20.0, 100.0, 0.0, None, -20.0]
    assert apply(spark, rows, PAIR, text.yoy_text_loyalty(A, B)) == [
        "+20.0%",
        "+100%",
        "0%",
        None,
        "-20.0%",
    ]


def test_clamp_and_average(spark):
    rows = [(-3.0, 2.0), (3.0, 0.0), (None, 1.0)]
    assert apply(spark, rows, PAIR, numbers.clamp_zero(A)) == [0.0, 3.0, None]
    assert apply(spark, rows, PAIR, numbers.average_or(A, B, 0.0)) == [-1.5, 0.0, None]


@pytest.mark.parametrize(
    ("style", "expected"),
    [
        ("amount", ["—", "0.00", "12.35", "1K", "1.5K", "-2.3M", "3B"]),
        ("count", ["—", "0", "12", "1K", "1.5K", "-2.3M", "3B"]),
        ("stock", ["—", "0.00", "12.35", "1K", "1.54K", "-2.35M", "3B"]),
    ],
)
def test_abbreviations(spark, style, expected):
    rows = [(None,), (0.0,), (12.345,), (1000.0,), (1544.0,), (-2345000.0,), (3e9,)]
    assert apply(spark, rows, "a double", text.abbrev_number(A, style)) == expected


def test_salary_text(spark):
    rows = [(None,), (950.0,), (1500.0,), (2000.0,), (1250000.0,), (-5000.0,)]
    assert apply(spark, rows, "a double", text.abbrev_salary(A, "EGP")) == [
        "—",
        "950 EGP",
        "1.5K EGP",
        "2K EGP",
        "1.25M EGP",
        "-5000 EGP",
    ]


def test_price_and_dates(spark):
    rows = [(1234.5, "USD"), (0.0, "USD"), (None, "USD"), (2.0, ""), (2.0, None)]
    found = apply(spark, rows, "a double, b string", text.price_text(A, B))
    assert found == ["1,234.50 USD", "—", "—", "2.00", "2.00"]
    dates = [(dt.date(2000, 6, 5),), (None,)]
    assert apply(spark, dates, "a date", text.date_text(A)) == ["Jun 5, 2000", "—"]
    assert apply(spark, dates, "a date", text.date_text(A, "iso")) == ["2000-06-05", ""]


def test_clean_text(spark):
    rows = [("  a\u0000b �  c\t\td ",), (None,)]
    assert apply(spark, rows, "a string", text.clean_text(A)) == ["ab cd", None]


def test_number_text(spark):
    rows = [(1.5,), (100.0,), (0.0,), (12345678.25,)]
    assert apply(spark, rows, "a double", text.number_text(A)) == ["1.5", "100", "0", "12345678.25"]


def test_cash_state_is_reversed(spark):
    """Credit above debit reads as inflow, the reverse of an asset account's convention."""
    rows = [(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (None, 1.0)]
    assert apply(spark, rows, PAIR, classify.cash_state(A, B)) == [
        "Inflow",
        "Outflow",
        "Neutral",
        "Neutral",
    ]


def test_native_amount_of_a_missing_currency(spark):
    rows = [("EGP", 5), ("USD", 5), (None, 5)]
    column = numbers.native_amount(A, "EGP", B, B * 10)
    assert apply(spark, rows, "a string, b int", column) == [5, 50, 50]


def test_bank_currency_precedence(spark):
    rows = [
        ("12EG", "usd account", "X"),
        ("77SD", None, "X"),
        (None, "حساب دولار", "X"),
        ("77", "Euro account", "X"),
        ("77", "main", "GBP"),
        ("77SD", "egp", "X"),
    ]
    column = classify.bank_currency(A, B, F.col("c"))
    found = apply(spark, rows, "a string, b string, c string", column)
    assert found == ["EGP", "USD", "USD", "EUR", "GBP", "EGP"]


def test_department_groups(spark):
    rows = [
        ("ادارة المبيعات",),
        ("  ادارة   الانتاج ",),
        ("ادارة\u0000 المبيعات",),
        ("ادارة اللوجيستيات المنتج التام",),
        ("قسم اللوجيستيات المنتج التام",),
        ("قسم اللوجيستيات",),
        ("قسم التخطيط",),
        ("TESTER99",),
        ("Unknown",),
        ("",),
        (None,),
    ]
    assert apply(spark, rows, "a string", classify.dept_group(A)) == [
        "Sales & Marketing",
        "Operations & Production",
        "Sales & Marketing",
        "Sales & Marketing",
        "Sales & Marketing",
        "Logistics & Procurement",
        "Operations & Production",
        "Corporate Services & HR",
        "Corporate Services & HR",
        "Corporate Services & HR",
        "Corporate Services & HR",
    ]


def test_every_listed_department_finds_a_group(spark):
    """Each listed name gives its own group; two of them hold double blanks and use words."""
    pairs = [(n, g) for g, ns in fixed.DEPARTMENT_NAMES.items() for n in ns]
    found = apply(spark, [(n,) for n, _ in pairs], "a string", classify.dept_group(A))
    assert found == [g for _, g in pairs]


def test_own_department_rules(spark):
    column = classify.dept_group(A, {"Ops": ["Plant"]}, [("Field", ["site"])], "Rest")
    assert apply(spark, [("Plant",), ("site 4",), ("x",)], "a string", column) == [
        "Ops",
        "Field",
        "Rest",
    ]


def test_bands_and_badges(spark):
    rows = [(95.0,), (80.0,), (60.0,), (10.0,), (0.0,)]
    assert apply(spark, rows, "a double", classify.score_band(A)) == [
        "green",
        "blue",
        "orange",
        "red",
        "gray",
    ]
    rows = [(-1.0,), (3.0,), (10.0,), (16.0,), (None,)]
    assert apply(spark, rows, "a double", classify.leave_band(A)) == [
        "red",
        "orange",
        "blue",
        "green",
        "red",
    ]
    rows = [(101.0,), (100.0,), (79.9,), (None,)]
    assert apply(spark, rows, "a double", classify.payment_badge(A)) == [
        "Over Paid",
        "On Track",
        "Below Target",
        None,
    ]
    assert apply(spark, [(50.0, 0.0), (0.0, 5.0)], PAIR, classify.score_pct(B, A)) == [0.0, 0.0]


def test_json_helpers(spark):
    rows = [('{"EmployeeID": 7}',), (' [{"EmployeeID": "x"}]',), ('{"EmployeeID"',), ("",), (None,), ("7",)]
    valid = [True, True, False, False, False, False]
    assert apply(spark, rows, "a string", is_valid_json(A)) == valid
    numbers_found = [7, None, None, None, None, None]
    assert apply(spark, rows, "a string", json_int(A, "$.EmployeeID")) == numbers_found


def test_blanks_behind_a_code_do_not_count(spark):
    data = [("12",), ("12 ",), ("12   ",), ("12 3",), ("12!",), ("123",), (" 12",), ("",), ("  ",), (None,)]
    codes = spark.createDataFrame(data, "code string")
    code = F.col("code")

    def kept(test):
        return [r[0] for r in codes.filter(test).collect()]

    assert kept(filters.in_list(code, ["12"])) == ["12", "12 ", "12   "]
    assert kept(filters.in_list(code, [12, "99", "12 "])) == ["12", "12 ", "12   "]
    assert kept(filters.not_in_list(code, ["12", ""])) == ["12 3", "12!", "123", " 12"]
    assert kept(filters.in_list(code, [])) == []
    assert kept(filters.non_empty(code)) == [c for c, in data[:7]]
    assert kept(filters.in_list(F.length(code), [2])) == ["12", "  "]
