from __future__ import annotations

import pytest

from bizpanel import api
from bizpanel.operators import maintain
from bizpanel.operators.policy import ALLOW, DENY, EMPTY, MASK, AccessDenied, Policy, Rule

POLICY = Policy(
    (
        Rule("control_period", "seller", MASK, ("total_paid",)),
        Rule("control_period", "seller", EMPTY, ("cash",)),
        Rule("cash_period", "seller", DENY),
        Rule("stock_valuation", "storekeeper", ALLOW),
    )
)
REQUEST = {"Period": "monthly", "Months": "4", "Quarter": 0, "Year": 2000}


def test_denied_before_any_table_is_read():
    class NoTables:
        def __getattr__(self, name):
            raise AssertionError("a table was read")

    with pytest.raises(AccessDenied):
        api.run("cash_period", NoTables(), REQUEST, "Seller", POLICY)
    with pytest.raises(AccessDenied):
        api.run("stock_valuation", NoTables(), None, "seller", POLICY)


def test_mask_and_empty(make_tables):
    tables = make_tables(
        journal_line=[
            {"account": "2321", "journal_date": "2000-04-01", "journal_no": "GP1", "debit_book": 5,
             "credit_book": 0},
            {"account": "1261", "journal_date": "2000-04-01", "debit_book": 5, "credit_book": 0},
        ]
    )
    seen = api.run("control_period", tables, REQUEST, "SELLER", POLICY)
    full = api.run("control_period", tables, REQUEST, "owner", POLICY)
    assert (seen["kpis"].first().total_paid, full["kpis"].first().total_paid) == (0, 5)
    assert seen["kpis"].first().vendor_balance == 5
    assert (seen["cash"].count(), full["cash"].count()) == (0, 1)
    assert seen["cash"].schema == full["cash"].schema
    assert seen["kpis"].schema.names == full["kpis"].schema.names


def test_every_report_runs_by_name(make_tables):
    tables = make_tables()
    request = REQUEST | {"Month": 4, "ClientID": 1, "EmployeeID": 1, "CustomerType": "Export"}
    for name in api.REPORTS:
        for listed in api.run(name, tables, request).values():
            assert listed.schema.names
    with pytest.raises(KeyError):
        api.run("no such report", tables, request)


def test_rules_from_rows():
    rows = [{"report": "r", "role": "A", "effect": "deny"}]
    with pytest.raises(AccessDenied):
        Policy.from_rows(rows).check("r", "a")
    Policy.from_rows(rows).check("r", "b")


SCHEMA = "id int, item_code string, safety_stock double"


def test_upsert_rejects_and_replaces(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], SCHEMA)
    changes = spark.createDataFrame(
        [(2, "b", 20.0), (3, "c", 0.0), (1, "", 5.0), (4, None, -1.0), (5, "e", -1.0)], SCHEMA
    )
    saved, rejected = maintain.upsert(base, changes, "id", maintain.safety_stock_checks())
    assert sorted(map(tuple, saved.collect())) == [(1, "a", 1.0), (2, "b", 20.0), (3, "c", 0.0)]
    assert sorted((r.id, r.reason) for r in rejected.collect()) == [
        (1, "item code is required"),
        (4, "item code is required"),
        (5, "quantity must be 0 or greater"),
    ]


def test_last_change_of_a_batch_counts(spark):
    base = spark.createDataFrame([(1, "a", 1.0)], SCHEMA)
    changes = spark.createDataFrame(
        [(1, "a", 5.0, 1), (1, "a", 7.0, 2), (1, "a", 6.0, 3), (2, "b", 1.0, 1)],
        SCHEMA + ", seq int",
    )
    saved, _ = maintain.upsert(base, changes, "id", sequence="seq")
    assert sorted(map(tuple, saved.collect())) == [(1, "a", 6.0), (2, "b", 1.0)]


def test_delete_and_search(spark):
    base = spark.createDataFrame([(1, "Bolt", 1.0), (2, "nut", 2.0)], SCHEMA)
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    assert [r.id for r in maintain.delete(base, ids, "id").collect()] == [1]
    assert maintain.search_items(base, "b", ["item_code"]).count() == 0
    assert [r.id for r in maintain.search_items(base, "BO", ["item_code"]).collect()] == [1]


def test_new_records_get_keys_and_repeated_ones_are_rejected(spark):
    base = spark.createDataFrame([(3, "a", 1)], "id long, item_code string, safety_stock int")
    rows = [(0, "b", 2), (None, "c", 3), (3, "a", 9), (5, "x", 1), (5, "y", 1)]
    changes = spark.createDataFrame(rows, base.schema)
    saved, rejected = maintain.upsert(base, changes, "id")
    assert sorted(map(tuple, saved.collect())) == [(3, "a", 9), (4, "b", 2), (5, "c", 3)]
    assert [r.id for r in rejected.collect()] == [5, 5]
