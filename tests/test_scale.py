"""Hot keys, table layout and plan shapes."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from bizpanel.checks import all_checks
from bizpanel.operators import aggregates, joins
from bizpanel.operators.lineage import cut, ensure_checkpoint_dir
from bizpanel.operators.period import Period
from bizpanel.plans import expenses, ledger, loyalty, sales
from bizpanel.plans.stock import last_price
from bizpanel.sources import sinks
from bizpanel.sources.tables import Tables, save_bucketed, write_table
from tests.conftest import SMALL

from bizpanel.sources.standin import standin_tables

YEAR = Period.yearly(2000)


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """20,000 facts; a third of them share one key, and some keys are NULL."""
    generator = random.Random(7)
    rows = []
    for i in range(20_000):
        key = 1 if i % 3 == 0 else generator.choice([None, *range(2, 400)])
        rows.append((i, key, generator.randrange(1, 13), generator.randrange(1000)))
    return rows, spark.createDataFrame(rows, "id int, k int, month int, v int").repartition(8)


def test_salted_join_equals_the_plain_one(spark, hot):
    rows, facts = hot
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 300)], "k int, name string")
    plain = joins.left_dim(facts, dim, "k")
    salted = joins.left_dim(facts, dim, "k", salts=7)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))
    sizes = facts.withColumn("s", F.pmod(F.xxhash64(*facts.columns), F.lit(7)))
    largest = sizes.filter("k = 1").groupBy("s").count().agg(F.max("count")).first()[0]
    assert largest < len(rows) / 3 / 5


def test_distinct_counts_of_a_hot_key(hot):
    rows, facts = hot
    expected = defaultdict(set)
    for _, k, month, _ in rows:
        if k is not None:
            expected[month].add(k)
    found = aggregates.distinct_count(facts, ["month"], "k", "n").collect()
    assert {r.month: r.n for r in found} == {m: len(s) for m, s in expected.items()}


def test_latest_rows_of_a_hot_key(hot):
    rows, facts = hot
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    best = {k: max(g, key=lambda r: (r[3], r[0]))[0] for k, g in groups.items()}
    one = aggregates.latest(facts, ["k"], ["v", "id"], ["id"]).collect()
    assert {r.k: r.id for r in one} == best
    order = [F.col("v").desc(), F.col("id").desc()]
    four = aggregates.latest_k(facts, 4, ["k"], order)
    text = plan(four)
    assert "WindowGroupLimit" in text
    found = defaultdict(list)
    for r in four.collect():
        found[r.k].append(r.id)
    for k, g in groups.items():
        top = sorted(g, key=lambda r: (-r[3], -r[0]))[:4]
        assert sorted(found[k]) == sorted(r[0] for r in top)


def test_share_of_a_hot_parent(hot):
    rows, facts = hot
    totals = defaultdict(int)
    for _, k, _, v in rows:
        totals[k] += v
    shares = aggregates.share_of_parent(facts, "v", ["k"], "pct", 6).collect()
    assert len(shares) == len(rows)
    for r in shares[:500]:
        expected = None if r.v == 0 else round(r.v / totals[r.k] * 100, 6)
        assert r.pct == pytest.approx(expected, abs=2e-6) if expected is not None else r.pct is None


def test_client_activity_of_a_hot_client(make_tables, spark, hot):
    rows, facts = hot
    charging = facts.select(
        F.col("k").alias("client_id"),
        F.lit(2000).alias("charging_year"),
        F.col("month").alias("charging_month"),
        F.lit("A").alias("card_type"),
        F.lit(1).alias("total_cards"),
        F.col("v").cast("decimal(18,2)").alias("total_points"),
    )
    tables = make_tables().replace(charging=charging)
    expected = defaultdict(int)
    for _, k, _, v in rows:
        expected[k] += 0 if k is None else v
    found = loyalty.client_activity(tables, YEAR).collect()
    assert {r.client_id: int(r.total_charged_points) for r in found} == dict(expected)
    text = plan(loyalty.clients(tables, YEAR))
    assert "ReusedExchange" in text


def test_last_price_of_a_hot_invoice_and_item(make_tables, spark):
    """A third of all lines on one invoice: they are reduced where they are read, and the prices are exact."""
    generator = random.Random(11)
    first_day = dt.date(2000, 1, 1)
    days = {key: first_day + dt.timedelta(days=generator.randrange(300)) for key in range(1, 500)}
    lines = []
    for i in range(30_000):
        key = 1 if i % 3 == 0 else generator.randrange(2, 520)
        item = "HOT" if i % 2 == 0 else f"I{generator.randrange(300)}"
        lines.append((key, item, generator.randrange(1, 10_000)))
    best = {}
    for key, item, price in lines:
        if key in days:
            best[item] = max(best.get(item, (first_day, 0, 0)), (days[key], key, price))
    header = spark.createDataFrame(
        [(k, d, "EGP", 1) for k, d in days.items()],
        "internal_id bigint, invoice_date date, invoice_currency string, invoice_exchange_rate int",
    )
    line = spark.createDataFrame(lines, "int_id bigint, item_code string, price int").repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        prices = last_price(header, line)
        found = {r.item_code: (r.last_invoice_date, r.last_price) for r in prices.collect()}
        # what reaches the join is one row of an invoice and item
        assert "partial_max(price" in prices._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == {item: (day, price) for item, (day, _, price) in best.items()}


# --- layout ----------------------------------------------------------------


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    """The test tables written the way the library lays tables out."""
    root = str(tmp_path_factory.mktemp("tables"))
    source = standin_tables(spark, SMALL)
    names = ["journal_line", "accounts_master", "segments_master", "sales_header", "sales_line"]
    names += ["item_master", "charging", "redemption", "client_master"]
    for name in names:
        write_table(source[name], root, name)
    return source, Tables.from_parquet(spark, root)


def test_written_tables_give_the_same_reports(laid_out):
    source, written = laid_out
    for build in (
        lambda t: sales.sales_period(t, YEAR, dt.date(2000, 6, 15)),
        lambda t: expenses.expenses_period(t, YEAR)["detail"],
        lambda t: loyalty.gifts(t, YEAR),
        lambda t: ledger.group_balances(t.journal_line, YEAR),
    ):
        assert sorted(map(str, build(source).collect())) == sorted(map(str, build(written).collect()))


def test_years_prune_partitions_and_filters_reach_the_scan(laid_out):
    _, written = laid_out
    text = plan(expenses.expense_base(written.journal_line, YEAR))
    partitions = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "journal_year" in partitions
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "GreaterThanOrEqual(journal_date,2000-01-01)" in pushed
    assert "In(account" in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "line_currency" not in schema and "bank" not in schema
    text = plan(loyalty.gifts(written, YEAR))
    assert "redemption_year" in re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)


def test_rewriting_one_year_keeps_the_others(laid_out, spark, tmp_path):
    source, _ = laid_out
    root = str(tmp_path)
    write_table(source.charging, root, "charging")
    before = Tables.from_parquet(spark, root).charging.groupBy("charging_year").count()
    kept = {r.charging_year: r["count"] for r in before.collect()}
    write_table(source.charging.filter("charging_year = 2000").limit(3), root, "charging")
    after = Tables.from_parquet(spark, root).charging.groupBy("charging_year").count().collect()
    assert {r.charging_year: r["count"] for r in after} == kept | {2000: 3}


def test_bucketed_tables_join_without_a_shuffle(laid_out, spark):
    source, _ = laid_out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_bucketed(source.sales_header, "bucketed_header", "internal_id", 4)
        save_bucketed(source.sales_line, "bucketed_line", "int_id", 4)
        line = spark.table("bucketed_line").groupBy("int_id").agg(F.sum("line_weight").alias("w"))
        joined = joins.header_lines(spark.table("bucketed_header"), line)
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() == joins.header_lines(
            source.sales_header, source.sales_line.groupBy("int_id").count()
        ).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_same_results_without_broadcast_joins(spark):
    """Nothing relies on a side being small: sort-merge joins give the same rows."""
    names = ["r6_sales_period", "r10_stock_valuation", "r8_expense_detail", "r17_governorates"]
    checks = all_checks()
    small = {n: sorted(map(str, checks[n].run(spark, SMALL).collect())) for n in names}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            df = checks[n].run(spark, SMALL)
            assert sorted(map(str, df.collect())) == small[n]
            assert "BroadcastHashJoin" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_sales_scan_each_fact_once(spark):
    text = plan(all_checks()["r6_sales_period"].run(spark, SMALL)).split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_", text)) == 2  # lines and ledger
    assert len(re.findall(r"FileScan parquet \[[^\]]*o_", text)) == 2  # amounts and line headers
    text = plan(all_checks()["r7_cash_summary"].run(spark, SMALL)).split("Initial Plan")[0]
    assert text.count("FileScan") == 1


def test_checkpoint_folder_follows_the_cluster(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    ensure_checkpoint_dir(spark)
    assert folder and spark.sparkContext.getCheckpointDir() == folder
    assert cut(spark.range(3)).count() == 3


def test_exports(spark, tmp_path):
    tables = standin_tables(spark, SMALL)
    sheet = sinks.safety_stock_export(tables.safety_stock)
    sinks.write_report(sheet, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sheet.columns and back.count() == sheet.count()
    sinks.write_report(sheet, str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == sheet.count()
    with pytest.raises(ValueError):
        sinks.write_report(sheet, str(tmp_path / "x"), "xls")


def test_compacted_history_of_a_partitioned_ledger(spark, tmp_path):
    """Balances agree with the plain ledger, and no partition of a closed year is read."""
    plain = standin_tables(spark, SMALL).journal_line
    write_table(plain, str(tmp_path), "journal_line")
    stored = spark.read.parquet(str(tmp_path / "journal_line"))
    assert ledger.YEAR_COLUMN in stored.columns
    year = plain.agg(F.max(F.year("journal_date"))).first()[0]
    period = Period.yearly(year)
    short = ledger.with_compacted_years(stored, ledger.compact_years(plain), year)
    lines = stored.filter(F.col("journal_date") < F.make_date(F.lit(year), F.lit(1), F.lit(1)))
    assert not lines.isEmpty()
    sums = [
        {r.account: r.s for r in f.groupBy("account").agg(F.sum("debit_book").alias("s")).collect()}
        for f in (plain, short)
    ]
    assert sums[0] == sums[1]
    wanted, got = (
        sorted(map(tuple, ledger.group_balances(f, period).collect())) for f in (plain, short)
    )
    assert wanted == got
    current = ledger.with_compacted_years(stored, ledger.compact_years(plain).limit(0), year)
    assert re.search(r"PartitionFilters: \[[^\]]*journal_year", plan(current))
