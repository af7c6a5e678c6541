"""Classification Column expressions: channels, account groups, departments, bands."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.text import clean_text


def any_of(predicates: Iterable[Column]) -> Column:
    """OR of the predicates; false for an empty list."""
    tests = list(predicates)
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def all_of(predicates: Iterable[Column]) -> Column:
    """AND of the predicates; true for an empty list."""
    tests = list(predicates)
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def first_match(tests: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """CASE with one branch per test, in the given order."""
    chain = None
    for predicate, value in tests:
        chain = F.when(predicate, value) if chain is None else chain.when(predicate, value)
    return default if chain is None else chain.otherwise(default)


def label_map(value: Column, labels: Mapping[str, str], default: Column) -> Column:
    """Label for each listed value, blanks behind it aside, ``default`` for all others."""
    return first_match([(F.rtrim(value) == k, F.lit(label)) for k, label in labels.items()], default)


def account_group(account: Column) -> Column:
    """The three-character group code of an account."""
    return F.substring(account, 1, 3)


def account_group_name(group: Column) -> Column:
    return label_map(group, fixed.ACCOUNT_GROUP_NAMES, F.lit("Other"))


def staff_group_label(code: Column) -> Column:
    return label_map(code, fixed.STAFF_GROUP_LABELS, code)


def cash_state(debit: Column, credit: Column) -> Column:
    """``Inflow`` when credit exceeds debit, ``Outflow`` the other way round."""
    return (
        F.when(credit > debit, F.lit("Inflow"))
        .when(debit > credit, F.lit("Outflow"))
        .otherwise(F.lit("Neutral"))
    )


def channel_predicates(sales_person: Column, customer: Column) -> dict[str, Column]:
    """Overlapping channel tests of the period sales: export is by customer code only."""
    return {
        "white": sales_person.startswith(fixed.WHITE_PREFIX),
        "color_center": sales_person.startswith(fixed.COLOR_CENTER_PREFIX),
        "project": sales_person.startswith(fixed.PROJECT_PREFIX),
        "export": customer.startswith(fixed.EXPORT_CUSTOMER_PREFIX),
    }


def customer_type_filter(kind: str | None, sales_person: Column, customer: Column) -> Column:
    """Exclusive customer-type test; an unknown name means ``Other``.

    ``Other`` drops customers without a sales person, as NOT LIKE does on NULL.
    """
    export = customer.startswith(fixed.EXPORT_CUSTOMER_PREFIX)
    local = {
        "White Customers": fixed.WHITE_PREFIX,
        "Color Centers": fixed.COLOR_CENTER_PREFIX,
        "Projects": fixed.PROJECT_PREFIX,
    }
    if kind == "Export":
        return export
    if kind in local:
        return sales_person.startswith(local[kind]) & ~export
    return all_of(~sales_person.startswith(p) for p in local.values()) & ~export


def sales_channel(sales_person: Column, customer: Column) -> Column:
    """One exclusive channel name per customer; NULL where no test holds."""
    tests = [
        (customer_type_filter(kind, sales_person, customer), F.lit(kind))
        for kind in fixed.CUSTOMER_TYPES
    ]
    return first_match(tests, F.lit(None).cast("string"))


def bank_currency(code: Column, name: Column, fallback: Column) -> Column:
    """Currency read from marks in the bank code or name, else ``fallback``."""
    upper_code = F.upper(F.coalesce(code, F.lit("")))
    lower_name = F.lower(F.coalesce(name, F.lit("")))
    tests = []
    for currency, code_marks, name_marks in fixed.BANK_CURRENCY_MARKS:
        found = [upper_code.contains(mark) for mark in code_marks]
        found += [lower_name.contains(mark) for mark in name_marks]
        tests.append((any_of(found), F.lit(currency)))
    return first_match(tests, fallback)


def dept_group(
    department: Column,
    names: Mapping[str, Sequence[str]] = fixed.DEPARTMENT_NAMES,
    words: Sequence[tuple[str, Sequence[str]]] = fixed.DEPARTMENT_WORDS,
    default: str = fixed.DEFAULT_DEPARTMENT_GROUP,
) -> Column:
    """Executive group of a department: exact name first, then ordered words, then default.

    The cleaned name is bound by a one-element ``transform``. Written inline, it would
    be cleaned again in each of the tests, also where a filter on the group is pushed down.
    """
    def group_of(clean: Column) -> Column:
        tests = [(clean.isin(*members), F.lit(group)) for group, members in names.items()]
        tests += [
            (clean.rlike("|".join(map(re.escape, group_words))), F.lit(group))
            for group, group_words in words
        ]
        return first_match(tests, F.lit(default))

    return F.element_at(F.transform(F.array(clean_text(department)), group_of), 1)


def target_badge(ratio: Column) -> Column:
    """Collection ratio against its target; NULL ratio has no badge."""
    return F.when(ratio >= fixed.COLLECTION_TARGET_PCT, F.lit("On Track")).when(
        ratio < fixed.COLLECTION_TARGET_PCT, F.lit("Below Target")
    )


def payment_badge(ratio: Column) -> Column:
    """Payment ratio: over 100 is over-paid, 80 to 100 on track."""
    return F.when(ratio > fixed.OVER_PAID_PCT, F.lit("Over Paid")).otherwise(
        target_badge(ratio)
    )


def expense_badge(ratio: Column) -> Column:
    """Expense to sales ratio against its limit."""
    return F.when(ratio <= fixed.EXPENSE_LIMIT_PCT, F.lit("Within Limit")).when(
        ratio > fixed.EXPENSE_LIMIT_PCT, F.lit("Over Limit")
    )


def score_pct(target: Column, achieved: Column) -> Column:
    """Achieved share of the target in whole percent; 0 without a target."""
    goal, got = F.coalesce(target, F.lit(0)), F.coalesce(achieved, F.lit(0))
    return F.when(
        goal > 0, F.round(got.cast("double") / goal.cast("double") * 100, 0)
    ).otherwise(F.lit(0.0))


def score_band(percent: Column) -> Column:
    tests = [(percent >= bound, F.lit(band)) for bound, band in fixed.SCORE_BANDS]
    return first_match([*tests, (percent > 0, F.lit("red"))], F.lit("gray"))


def leave_band(balance: Column) -> Column:
    days = F.coalesce(balance, F.lit(0))
    return (
        F.when(days <= 0, F.lit("red"))
        .when(days <= 3, F.lit("orange"))
        .when(days > 15, F.lit("green"))
        .otherwise(F.lit("blue"))
    )
