"""Human resources: employee lists, key figures, details, leaves, department tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import (
    dept_group,
    leave_band,
    score_band,
    score_pct,
    staff_group_label,
)
from bizpanel.functions.numbers import (
    average_or,
    count_if,
    or_default,
    or_zero,
    share_pct,
    sum_if,
)
from bizpanel.functions.text import photo_url
from bizpanel.operators.aggregates import count_share, latest_k, on_category_spine
from bizpanel.operators.filters import facet_counts, facets, search, state_eq, trim_in
from bizpanel.operators.hierarchy import manager_order, org_tree
from bizpanel.operators.joins import exists_flag, left_dim, lookup, one_row, with_scalar_sum
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import in_year
from bizpanel.sources.tables import Tables

SEARCH_COLUMNS = (
    "employee_id",
    "full_name",
    "branch_name",
    "department_name",
    "job_name",
    "division_name",
)

PROFILE_COLUMNS = (
    "employee_id",
    "full_name",
    "branch_name",
    "department_name",
    "division_name",
    "job_name",
    "reporting_to",
    "joining_date",
    "address",
    "contract_date",
    "contract_expired_date",
    "current_status",
    "leaving_date",
    "termination_notes",
    "group_code",
    "education",
    "is_manager",
    "manager_id",
    "salary_amount",
    "photo",
    "birthdate",
    "tel",
    "mob",
)


#: Columns of the dashboard list that it can be narrowed by.
FACETS = ("branch_name", "department_name", "current_status", "group_code")


def is_working(state: Column) -> Column:
    return trim_in(state, [fixed.WORKING_STATE])


def confirmed_terminations(termination: DataFrame, year: int | None = None) -> DataFrame:
    rows = termination.filter(
        state_eq(F.col("termination_state"), fixed.CONFIRMED_TERMINATION)
    )
    return rows if year is None else rows.filter(in_year(F.col("termination_date"), year))


def profiles(tables: Tables, employees: DataFrame, photos: str = fixed.PHOTO_BASE_URL) -> DataFrame:
    """Employees with manager name, group label, salary total and photo address."""
    named = lookup(
        employees, "report_to", tables.employee_master, "employee_id", "full_name", "reporting_to"
    )
    paid = with_scalar_sum(
        named, tables.employee_salary, ["employee_id"], F.col("salary_amount"), "salary_amount"
    )
    return (
        paid.withColumnRenamed("state_description", "current_status")
        .withColumn("group_code", staff_group_label(F.col("group_code")))
        .withColumn("photo", photo_url(photos, F.col("image_id")))
        .select(*PROFILE_COLUMNS)
    )


def current_or_leaving(tables: Tables, year: int) -> DataFrame:
    """Employees who work now, or whose termination was confirmed in the year."""
    left = confirmed_terminations(tables.termination, year)
    flagged = exists_flag(tables.employee, left, "employee_id", "left_this_year")
    return flagged.filter(
        is_working(F.col("state_description")) | F.col("left_this_year")
    ).drop("left_this_year")


def employee_list(tables: Tables, today: dt.date) -> DataFrame:
    """The dashboard list, manager by manager."""
    return profiles(tables, current_or_leaving(tables, today.year)).orderBy(
        F.col("manager_id").asc_nulls_first(),
        F.when(F.col("is_manager") == 1, 0).otherwise(1),
        F.col("full_name").asc_nulls_first(),
        "employee_id",
    )


def absent_on(tables: Tables, day: dt.date) -> DataFrame:
    """Day leaves of worker and normal staff on a date, with leave and employee columns."""
    history = tables.leave_history.filter(F.col("leave_date") == F.lit(day))
    kinds = tables.leave_master.filter(F.col("leave_type") == fixed.DAY_LEAVE_TYPE)
    staff = tables.employee.filter(trim_in(F.col("group_code"), fixed.STAFF_GROUPS))
    return history.join(kinds, "leave_id").join(staff, "employee_id")


def hr_kpis(tables: Tables, today: dt.date) -> DataFrame:
    """Active staff, terminations, payroll, turnover, joiners, leaves and missions today.

    Terminations count every group while the active staff is workers and normal
    employees only, so turnover mixes the two as the dashboard does.
    """
    year = today.year
    working = is_working(F.col("state_description"))
    staff = tables.employee.agg(
        count_if(working & trim_in(F.col("group_code"), fixed.STAFF_GROUPS)).alias("active_staff"),
        count_if(in_year(F.col("joining_date"), year)).alias("joined_this_year"),
    )
    left = confirmed_terminations(tables.termination, year).agg(
        F.count(F.lit(1)).alias("terminations_this_year")
    )
    paid_per_employee = tables.employee_salary.groupBy("employee_id").agg(
        F.sum("salary_amount").alias("salary")
    )
    payroll = paid_per_employee.join(
        tables.employee.filter(working).select("employee_id"), "employee_id"
    ).agg(or_zero(F.sum("salary")).alias("total_salary"))
    mission = or_zero(F.col("is_business_leave")) == 1
    absent = (
        absent_on(tables, today)
        .groupBy("employee_id")
        .agg(
            F.max(F.when(mission, 1).otherwise(0)).alias("mission"),
            F.max(F.when(~mission, 1).otherwise(0)).alias("leave"),
        )
        .agg(
            or_zero(F.sum("leave")).alias("leaves_today"),
            or_zero(F.sum("mission")).alias("missions_today"),
        )
    )
    turnover = (
        F.col("terminations_this_year").cast("double")
        / F.nullif(F.col("active_staff"), F.lit(0)).cast("double")
        * F.lit(100.0)
    )
    return one_row(staff, left, payroll, absent).withColumn(
        "turnover_rate", or_zero(F.round(turnover, 2))
    )


def kpis_from_list(employees: DataFrame, today: dt.date) -> DataFrame:
    """Key figures from the dashboard list alone, when the figures are missing.

    The list tells neither the payroll nor who is away today: these figures are 0.
    """
    staff = F.col("group_code").isin(*fixed.STAFF_GROUP_LABELS.values())
    active = (F.col("current_status") == fixed.WORKING_STATE) & staff
    counts = employees.agg(
        count_if(active).alias("active_staff"),
        count_if(in_year(F.col("leaving_date"), today.year)).alias("terminations_this_year"),
        count_if(in_year(F.col("joining_date"), today.year)).alias("joined_this_year"),
    )
    return counts.select(
        "*",
        share_pct(F.col("terminations_this_year"), F.col("active_staff")).alias("turnover_rate"),
        *[F.lit(0).alias(name) for name in ("total_salary", "leaves_today", "missions_today")],
    )


def hr_dashboard(tables: Tables, today: dt.date) -> Lists:
    """The HR dashboard: ``employees`` and ``kpis``."""
    return Lists(
        {
            "employees": lambda: employee_list(tables, today),
            "kpis": lambda: hr_kpis(tables, today),
        }
    )


def _of(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    return df if ids is None else df.join(ids.select("employee_id"), "employee_id", "left_semi")


def with_termination(profile: DataFrame, terminations: DataFrame) -> DataFrame:
    """Termination date and note: the termination row if there is one, else the profile's."""
    rows = terminations.select(
        "employee_id", "termination_date", "termination_note", F.lit(True).alias("_terminated")
    )
    ended = F.col("_terminated").isNotNull()
    return (
        left_dim(profile, rows, "employee_id")
        .withColumns(
            {
                "termination_date": F.when(ended, F.col("termination_date")).otherwise(
                    F.col("leaving_date")
                ),
                "termination_note": F.when(ended, F.col("termination_note")).otherwise(
                    F.col("termination_notes")
                ),
            }
        )
        .drop("_terminated")
    )


def evaluations(tables: Tables, ids: DataFrame | None, k: int = fixed.EVALUATION_LIST_SIZE) -> DataFrame:
    """The latest approved evaluations per employee, with score and band."""
    approved = _of(tables.kpi_evaluation, ids).filter(
        F.col("record_state") == fixed.APPROVED_EVALUATION
    )
    order = [
        F.col("evaluation_year").desc(),
        F.col("evaluation_quarter").desc(),
        F.col("kpi_id").asc(),
        F.col("target_score").desc(),
        F.col("achieved_score").desc(),
    ]
    percent = score_pct(F.col("target_score"), F.col("achieved_score"))
    return (
        left_dim(latest_k(approved, k, ["employee_id"], order), tables.kpi_master, "kpi_id")
        .select(
            "employee_id",
            "evaluation_year",
            "evaluation_quarter",
            "kpi_description",
            "target_score",
            "achieved_score",
            "evaluate_by",
        )
        .withColumn("score_pct", percent)
        .withColumn("score_band", score_band(F.col("score_pct")))
    )


def leave_days() -> Column:
    return (
        F.col("open_balance") - F.col("issued") - F.col("approve_needed") + F.col("adjustments")
    )


def leave_balances(tables: Tables, year: int, ids: DataFrame | None) -> DataFrame:
    """Days left per leave of a year, with their band."""
    balances = _of(tables.leave_balance, ids).filter(F.col("balance_year") == year)
    names = tables.leave_master.select(F.col("leave_id").alias("leave_master_id"), "leave_name")
    return (
        left_dim(balances, names, "leave_master_id")
        .select("employee_id", "balance_year", "leave_name", leave_days().alias("balance"))
        .withColumn("band", leave_band(F.col("balance")))
    )


def employee_detail(tables: Tables, balance_year: int, ids: DataFrame | None = None) -> Lists:
    """Details of the employees in ``ids`` (column ``employee_id``), or of all.

    Lists: ``profile`` (with termination merged in), ``terminations``, ``salaries``,
    ``evaluations`` and ``leave_balances``.
    """

    def terminations() -> DataFrame:
        return _of(confirmed_terminations(tables.termination), ids).select(
            "employee_id", "termination_date", "termination_note"
        )

    def salaries() -> DataFrame:
        paid = _of(tables.employee_salary, ids)
        return left_dim(paid, tables.salary_master, "salary_id").select(
            "employee_id", "salary_amount", "salary_name"
        )

    return Lists(
        {
            "profile": lambda: with_termination(
                profiles(tables, _of(tables.employee, ids)), terminations()
            ),
            "terminations": terminations,
            "salaries": salaries,
            "evaluations": lambda: evaluations(tables, ids),
            "leave_balances": lambda: leave_balances(tables, balance_year, ids),
        }
    )


def leaves_on(tables: Tables, day: dt.date, photos: str = fixed.PHOTO_BASE_URL) -> DataFrame:
    """Leaves and missions of a date, with the balance left for that leave."""
    balances = tables.leave_balance.filter(F.col("balance_year") == day.year).withColumnRenamed(
        "leave_master_id", "leave_id"
    )
    absent = with_scalar_sum(
        absent_on(tables, day), balances, ["employee_id", "leave_id"], leave_days(), "leave_balance"
    )
    return absent.select(
        "employee_id",
        "full_name",
        "department_name",
        "branch_name",
        "job_name",
        "leave_name",
        or_zero(F.col("is_business_leave")).alias("is_business_leave"),
        photo_url(photos, F.col("image_id")).alias("photo"),
        "leave_balance",
    ).orderBy("is_business_leave", F.col("full_name").asc_nulls_first(), "employee_id", "leave_name")


def filter_employees(
    employees: DataFrame, query: str = "", choices: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Free-text search and facet choices on the dashboard list."""
    return facets(search(employees, query, SEARCH_COLUMNS), choices or {})


def employee_facets(
    employees: DataFrame, query: str = "", choices: Mapping[str, str | None] | None = None
) -> DataFrame:
    """The choices of branch, department, status and type, each with the rows it would show."""
    return facet_counts(search(employees, query, SEARCH_COLUMNS), FACETS, choices)


def with_group(employees: DataFrame) -> DataFrame:
    return employees.withColumn("dept_group", dept_group(F.col("department_name")))


def dept_group_cards(employees: DataFrame) -> DataFrame:
    """Head count and salary per executive group, all groups in their fixed order."""
    grouped = (
        with_group(employees)
        .groupBy("dept_group")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum(or_zero(F.col("salary_amount"))).alias("total_salary"),
        )
    )
    return on_category_spine(
        employees.sparkSession, grouped, "dept_group", fixed.DEPARTMENT_GROUP_ORDER
    )


def dept_group_table(employees: DataFrame) -> DataFrame:
    """Active and terminated staff, salary, its share and average per executive group.

    The total is a window over the eleven groups, so the employees are read once.
    """
    active = or_default(F.col("current_status") == fixed.WORKING_STATE, False)
    grouped = (
        with_group(employees)
        .groupBy("dept_group")
        .agg(
            count_if(active).alias("active_count"),
            count_if(~active).alias("termination_count"),
            sum_if(active, or_zero(F.col("salary_amount"))).alias("total_salary"),
        )
    )
    table = on_category_spine(
        employees.sparkSession, grouped, "dept_group", fixed.DEPARTMENT_GROUP_ORDER
    )
    whole = F.sum("total_salary").over(Window.partitionBy(F.lit(1)))
    return (
        table.withColumn("salary_pct", share_pct(F.col("total_salary"), whole))
        .withColumn("avg_salary", average_or(F.col("total_salary"), F.col("active_count")))
        .orderBy(F.col("total_salary").desc(), "position")
    )


def _department_name() -> Column:
    return F.trim(or_default(F.col("department_name"), ""))


def _of_department(employees: DataFrame, sub_department: str) -> DataFrame:
    if sub_department == "All":
        return employees
    return employees.filter(_department_name() == sub_department)


def dept_drilldown(employees: DataFrame, group: str, sub_department: str = "All") -> Lists:
    """One executive group: sorted ``list``, ``stats`` and head count per ``departments``."""
    of_group = with_group(employees).filter(F.col("dept_group") == group)
    shown = _of_department(of_group, sub_department)

    def stats() -> DataFrame:
        return shown.agg(
            F.count(F.lit(1)).alias("count"),
            or_zero(F.sum("salary_amount")).alias("total_salary"),
        )

    def departments() -> DataFrame:
        named = of_group.select(_department_name().alias("department"))
        return (
            named.filter(F.col("department") != "")
            .groupBy("department")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("department")
        )

    return Lists(
        {
            "list": lambda: shown.orderBy(*manager_order()),
            "stats": stats,
            "departments": departments,
        }
    )


def drilldown_tree(employees: DataFrame, group: str, sub_department: str = "All") -> DataFrame:
    """Manager tree of one executive group."""
    of_group = with_group(employees).filter(F.col("dept_group") == group)
    return org_tree(_of_department(of_group, sub_department))


def distribution(employees: DataFrame) -> Lists:
    """Head count and share per department, branch (with salaries) and division."""
    return Lists(
        {
            "departments": lambda: count_share(employees, "department_name"),
            "branches": lambda: count_share(employees, "branch_name", "salary_amount"),
            "divisions": lambda: count_share(employees, "division_name"),
        }
    )


def headline_counts(employees: DataFrame) -> DataFrame:
    """Employees, active employees, departments and branches of the whole list."""
    def named(column: str) -> Column:
        return F.when(F.col(column) != "", F.col(column))

    return employees.agg(
        F.count(F.lit(1)).alias("employees"),
        count_if(F.col("current_status") == fixed.WORKING_STATE).alias("active"),
        F.countDistinct(named("department_name")).alias("departments"),
        F.countDistinct(named("branch_name")).alias("branches"),
    )


def leaves_by_group(leaves: DataFrame, mode: str) -> dict[str, DataFrame]:
    """Leaves (``leaves``) or missions (``missions``) with counts per executive group."""
    mission = or_default(F.col("is_business_leave") == 1, False)
    chosen = with_group(leaves.filter(mission if mode == "missions" else ~mission))
    return {
        "list": chosen,
        "groups": chosen.groupBy("dept_group")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("dept_group"),
    }
