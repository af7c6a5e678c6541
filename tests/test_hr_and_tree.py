"""Human resources and manager trees on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from bizpanel.operators.filters import facet_counts, facet_values
from bizpanel.operators.hierarchy import manager_sort, org_tree
from bizpanel.plans import hr

TODAY = dt.date(2026, 6, 23)


def person(key, **more):
    row = {
        "employee_id": key,
        "full_name": f"Name {key}",
        "state_description": "Working",
        "group_code": "W",
        "department_name": "ادارة المبيعات",
        "is_manager": 0,
        "manager_id": 0,
    }
    return row | more


def termination(key, date="2026-02-01", state=20):
    return {
        "employee_id": key,
        "termination_date": date,
        "termination_note": f"left {key}",
        "termination_state": state,
    }


@pytest.fixture(scope="module")
def staff(make_tables):
    return make_tables(
        employee=[
            person(1, is_manager=1, joining_date="2026-01-05", image_id=11),
            person(2, state_description=" Working ", group_code="N ", report_to=1, manager_id=1),
            person(3, state_description="Resigned", leaving_date="2026-03-01", termination_notes="own"),
            person(4, state_description="Resigned", leaving_date="2020-03-01"),
            person(5, group_code="X", department_name=None),
            person(6, state_description="Resigned"),
        ],
        employee_master=[{"employee_id": 1, "full_name": "Boss"}],
        employee_salary=[
            {"employee_id": 1, "salary_id": 1, "salary_amount": 100},
            {"employee_id": 1, "salary_id": 2, "salary_amount": 20},
            {"employee_id": 3, "salary_id": 1, "salary_amount": 999},
        ],
        salary_master=[{"salary_id": 1, "salary_name": "Basic"}],
        termination=[termination(3), termination(4, "2020-03-01"), termination(6, state=10), termination(77)],
        kpi_evaluation=[
            {"employee_id": 1, "evaluation_year": 2020 + i, "evaluation_quarter": 1, "kpi_id": i,
             "target_score": 100 * (i % 2), "achieved_score": 92, "record_state": 30}
            for i in range(6)
        ],
        leave_history=[
            {"employee_id": 1, "leave_id": 1, "leave_date": "2026-06-23"},
            {"employee_id": 1, "leave_id": 2, "leave_date": "2026-06-23"},
            {"employee_id": 2, "leave_id": 3, "leave_date": "2026-06-23"},
            {"employee_id": 5, "leave_id": 1, "leave_date": "2026-06-23"},
            {"employee_id": 2, "leave_id": 1, "leave_date": "2026-06-22"},
            {"employee_id": 2, "leave_id": 4, "leave_date": "2026-06-23"},
        ],
        leave_master=[
            {"leave_id": 1, "leave_name": "Annual", "leave_type": 2},
            {"leave_id": 2, "leave_name": "Casual", "leave_type": 2, "is_business_leave": 0},
            {"leave_id": 3, "leave_name": "Mission", "leave_type": 2, "is_business_leave": 1},
            {"leave_id": 4, "leave_name": "Hours", "leave_type": 1, "is_business_leave": 1},
        ],
        leave_balance=[
            {"employee_id": 1, "leave_master_id": 1, "balance_year": 2026, "open_balance": 21,
             "issued": 5, "approve_needed": 1, "adjustments": 2},
            {"employee_id": 1, "leave_master_id": 1, "balance_year": 2025, "open_balance": 3,
             "issued": 0, "approve_needed": 0, "adjustments": 0},
        ],
    )


def test_employee_list(staff):
    rows = hr.employee_list(staff, TODAY).collect()
    assert [r.employee_id for r in rows] == [1, 3, 5, 2]
    by_id = {r.employee_id: r for r in rows}
    assert by_id[2].reporting_to == "Boss" and by_id[1].reporting_to is None
    assert (by_id[1].salary_amount, by_id[2].salary_amount) == (120, 0)
    # Blanks behind a code do not count.
    assert (by_id[1].group_code, by_id[2].group_code) == ("Worker", "Normal Employee")
    assert by_id[1].photo.endswith("/11-0.jpg") and by_id[2].photo is None


def test_kpis(staff, only):
    row = only(hr.hr_kpis(staff, TODAY))
    assert row["active_staff"] == 2
    # Terminations of people outside the employee table count too.
    assert row["terminations_this_year"] == 2
    assert row["turnover_rate"] == 100.0
    assert row["total_salary"] == 120
    assert row["joined_this_year"] == 1
    # Two leaves of one person on one day are one employee on leave.
    assert (row["leaves_today"], row["missions_today"]) == (1, 1)


def test_turnover_without_staff(make_tables, only):
    row = only(hr.hr_kpis(make_tables(termination=[termination(1)]), TODAY))
    assert (row["active_staff"], row["turnover_rate"], row["total_salary"]) == (0, 0.0, 0)
    assert (row["leaves_today"], row["missions_today"]) == (0, 0)


def test_kpis_from_the_list(staff, only):
    row = only(hr.kpis_from_list(hr.employee_list(staff, TODAY), TODAY))
    assert (row["active_staff"], row["terminations_this_year"], row["joined_this_year"]) == (1, 1, 1)
    assert row["turnover_rate"] == 100.0
    assert (row["total_salary"], row["leaves_today"], row["missions_today"]) == (0, 0, 0)


def test_facets_of_the_list_come_from_one_scan(spark):
    data = [("a", "x", "1"), ("a", "y", "1"), ("b", "x", "2"), ("b", None, "1"), (None, " ", "2"), ("a", "x", None)]
    df = spark.createDataFrame(data, "branch string, dept string, kind string")
    choices = {"branch": "a", "kind": "1", "dept": "All"}
    found = facet_counts(df, ["branch", "dept", "kind"], choices)
    assert [tuple(r) for r in found.collect()] == [
        ("branch", "a", 3, 2),
        ("branch", "b", 2, 1),
        ("dept", "x", 3, 1),
        ("dept", "y", 1, 1),
        ("kind", "1", 3, 2),
        ("kind", "2", 2, 0),
    ]
    bare = {(r.facet, r.value): (r["rows"], r.shown) for r in facet_counts(df, ["branch", "dept"]).collect()}
    assert bare == {("branch", "a"): (3, 3), ("branch", "b"): (2, 2), ("dept", "x"): (3, 3), ("dept", "y"): (1, 1)}
    text = facet_counts(df, ["branch", "dept"], choices)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan") == 1 and "Expand" in text
    for column in ("branch", "dept"):
        values = [r[0] for r in facet_values(df, column).collect()]
        assert values == [v for f, v in bare if f == column]


def test_detail_of_one_and_of_all(staff, spark):
    ids = spark.createDataFrame([(1,)], "employee_id int")
    one = hr.employee_detail(staff, 2026, ids)
    assert [r.employee_id for r in one["profile"].collect()] == [1]
    assert sorted((r.salary_name or "", int(r.salary_amount)) for r in one["salaries"].collect()) == [
        ("", 20),
        ("Basic", 100),
    ]
    scores = [(r.evaluation_year, r.score_pct, r.score_band) for r in one["evaluations"].collect()]
    assert sorted(scores, reverse=True) == [
        (2025, 92.0, "green"),
        (2024, 0.0, "gray"),
        (2023, 92.0, "green"),
        (2022, 0.0, "gray"),
    ]
    assert [(float(r.balance), r.band) for r in one["leave_balances"].collect()] == [(17.0, "green")]
    assert hr.employee_detail(staff, 2026)["profile"].count() == 6


def test_termination_row_wins_over_leaving_fields(staff):
    rows = {r.employee_id: r for r in hr.employee_detail(staff, 2026)["profile"].collect()}
    assert (rows[3].termination_date, rows[3].termination_note) == (dt.date(2026, 2, 1), "left 3")
    assert (rows[6].termination_date, rows[6].termination_note) == (None, None)
    assert rows[1].termination_note is None


def test_leaves_of_a_day(staff):
    rows = hr.leaves_on(staff, TODAY).collect()
    assert [(r.employee_id, r.leave_name, r.is_business_leave, float(r.leave_balance)) for r in rows] == [
        (1, "Annual", 0, 17.0),
        (1, "Casual", 0, 0.0),
        (2, "Mission", 1, 0.0),
    ]
    leaves = hr.leaves_on(staff, TODAY)
    assert hr.leaves_by_group(leaves, "missions")["list"].count() == 1
    assert [tuple(r) for r in hr.leaves_by_group(leaves, "leaves")["groups"].collect()] == [
        ("Sales & Marketing", 2)
    ]


def test_department_table_keeps_empty_groups(staff):
    rows = hr.dept_group_table(hr.employee_list(staff, TODAY)).collect()
    assert len(rows) == 11
    sales = rows[0]
    assert sales.dept_group == "Sales & Marketing"
    # The list shows the raw state, so " Working " is not counted as working here.
    assert (sales.active_count, sales.termination_count, sales.total_salary) == (1, 2, 120)
    assert (sales.salary_pct, sales.avg_salary) == (100.0, 120.0)
    empty = {r.dept_group: r for r in rows}["Finance"]
    assert (empty.active_count, empty.salary_pct, empty.avg_salary) == (0, 0.0, None)


def test_drilldown(staff):
    employees = hr.employee_list(staff, TODAY)
    drill = hr.dept_drilldown(employees, "Sales & Marketing")
    assert [r.employee_id for r in drill["list"].collect()] == [1, 3, 2]
    assert drill["stats"].first()["count"] == 3
    assert [tuple(r) for r in drill["departments"].collect()] == [("ادارة المبيعات", 3)]
    tree = {r.employee_id: (r.root_id, r.level) for r in hr.drilldown_tree(employees, "Sales & Marketing").collect()}
    assert tree == {1: (1, 0), 3: (3, 0), 2: (1, 1)}


def test_filters_and_distribution(staff):
    employees = hr.employee_list(staff, TODAY)
    assert hr.filter_employees(employees, "NAME 2").count() == 1
    assert hr.filter_employees(employees, "", {"group_code": "Worker", "branch_name": "All"}).count() == 2
    shares = {r["name"]: (r["count"], r.pct) for r in hr.distribution(employees)["departments"].collect()}
    assert shares == {"ادارة المبيعات": (3, 75.0), "Unknown": (1, 25.0)}
    counts = hr.headline_counts(employees).first()
    assert tuple(counts) == (4, 2, 1, 0)


# --- trees -----------------------------------------------------------------

SCHEMA = "employee_id int, manager_id int, is_manager int, full_name string"


def test_tree_roots_and_order(spark):
    rows = [
        (1, 0, 0, "zed"),
        (2, 1, 0, "Bob"),
        (3, 1, 1, "Zoe"),
        (4, 3, 0, "al"),
        (5, 99, 0, "out"),
        (6, None, 1, "amy"),
        (7, 1, 0, "bob b"),
    ]
    tree = org_tree(spark.createDataFrame(rows, SCHEMA)).orderBy("sort_path").collect()
    # Managers first, then names without case; "bob" before "bob b"; children after parents.
    assert [r.employee_id for r in tree] == [6, 5, 1, 3, 4, 2, 7]
    assert {r.employee_id: r.path for r in tree}[4] == "1/3/4"
    ordered = manager_sort(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.employee_id for r in ordered] == [6, 1, 3, 2, 7, 4, 5]


def test_cycles_are_left_out(spark):
    rows = [(1, 2, 0, "a"), (2, 1, 0, "b"), (3, 3, 0, "c"), (4, 1, 0, "d"), (5, 0, 0, "e")]
    tree = org_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.employee_id for r in tree] == [5]


def test_a_tree_may_have_any_depth(spark):
    rows = [(i, i - 1, 0, "n") for i in range(1, 71)]
    tree = org_tree(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.level for r in tree.select("level").collect()) == list(range(70))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 12), min_size=1, max_size=12))
def test_tree_against_a_walk_up(spark, parents):
    """Each node's level and root agree with walking up its managers."""
    managers = {i: p for i, p in enumerate(parents, 1)}

    def walk(node):
        seen = [node]
        while managers[seen[-1]] in managers:
            above = managers[seen[-1]]
            if above in seen:
                return None
            seen.append(above)
        return seen[-1], len(seen) - 1

    expected = {n: walk(n) for n in managers if walk(n)}
    rows = [(n, p, 0, f"n{n}") for n, p in managers.items()]
    tree = org_tree(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.employee_id: (r.root_id, r.level) for r in tree} == expected
    assert len(tree) == len(expected)
