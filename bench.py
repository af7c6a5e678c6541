"""Times the headline reports and prints one JSON line.

Each query is run once to warm up and then ``BENCH_RUNS`` times; its time is the
median, from building the plan to the last row. Environment: ``BENCH_SF_DIR``,
``BENCH_CPUS``, ``BENCH_RUNS``, and ``BENCH_QUERIES`` (comma-separated names or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bizpanel.checks import all_checks
from bizpanel.session import build_session

HEADLINES = (
    "r2_control_kpis",
    "r2_control_cash",
    "r4_purchasing_period",
    "r4_top_vendors",
    "r4_lowest_balances",
    "r6_sales_period",
    "r7_cash_summary",
    "r7_cash_accounts",
    "r7_bank_balances",
    "r8_expense_detail",
    "r9_customer_breakdown",
    "r9b_customer_monthly_summary",
    "r10_stock_valuation",
    "r12_loyalty_summary",
    "r13_loyalty_trend",
    "r15_card_types",
    "r16_client_leaderboard",
    "r17_governorates",
    "r20_employee_list",
    "r21_hr_kpis",
    "r22_evaluations",
    "r31_department_group_table",
    "k7_org_tree",
    "d3_upsert",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    checks = all_checks()
    names = list(checks) if asked == "all" else asked.split(",") if asked else list(HEADLINES)
    spark = build_session(cpus, "bench", {"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            checks[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline report time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
