"""Snapshots, new keys, closed years and the summary kept up to date."""

from __future__ import annotations

import datetime as dt
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bizpanel import api
from bizpanel.operators import maintain
from bizpanel.operators.bitmaps import distinct_of
from bizpanel.operators.hierarchy import org_tree
from bizpanel.operators.joins import bounded_by
from bizpanel.operators.lineage import ensure_checkpoint_dir
from bizpanel.operators.numbering import number_rows
from bizpanel.operators.period import Period
from bizpanel.plans import cash, clients, control, ledger, loyalty, purchasing, sales, stock, summary
from bizpanel.sources import changes, closing, versions
from bizpanel.sources.standin import standin_tables
from bizpanel.sources.tables import ClosedYear, Tables, drop_partition, write_table
from tests.conftest import SMALL

ITEMS = "id long, item_code string, safety_stock double"


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def root(tmp_path) -> str:
    return str(tmp_path)


@pytest.fixture(scope="module")
def books(spark):
    return standin_tables(spark, SMALL)


# --- snapshots ---------------------------------------------------------------


def test_a_table_is_made_from_itself_again_and_again(spark, root):
    path = f"{root}/items"
    versions.publish(spark.createDataFrame([(i, f"i{i}", 1.0) for i in range(200)], ITEMS), path)
    for turn in range(3):
        maintain.save(spark, path, lambda t: t.withColumn("safety_stock", F.col("safety_stock") + 1))
        assert versions.read(spark, path).agg(F.sum("safety_stock")).first()[0] == 200 * (turn + 2)
    maintain.save_delete(spark.createDataFrame([(0,), (7,), (900,)], "id long"), path, "id")
    assert versions.read(spark, path).count() == 198
    assert [v.number for v in versions.versions(spark, path)] == [1, 2, 3, 4, 5]
    assert versions.read(spark, path, number=1).count() == 200
    with pytest.raises(ValueError):
        versions.read(spark, path, number=9)


def test_tables_read_the_current_snapshot(spark, root, books):
    write_table(books.safety_stock, root, "safety_stock")
    before = Tables.from_parquet(spark, root).safety_stock.count()
    write_table(Tables.from_parquet(spark, root).safety_stock.filter("id < 5"), root, "safety_stock")
    assert Tables.from_parquet(spark, root).safety_stock.count() == 5 < before
    write_table(Tables.from_parquet(spark, root).safety_stock.limit(0), root, "safety_stock")
    assert Tables.from_parquet(spark, root).safety_stock.count() == 0


def test_a_failed_write_changes_nothing(spark, root):
    path = f"{root}/items"
    versions.publish(spark.createDataFrame([(1, "a", 1.0)], ITEMS), path)
    broken = F.when(F.col("id") == 1, F.raise_error(F.lit("broken"))).otherwise(F.lit(0.0))
    with pytest.raises(Exception, match="broken"):
        maintain.save(spark, path, lambda t: t.withColumn("safety_stock", broken.cast("double")))
    assert rows(versions.read(spark, path)) == [(1, "a", 1.0)]
    assert len(versions.versions(spark, path)) == 1
    assert versions.expire(spark, path, 1) == []


def test_of_two_writers_one_is_told(spark, root):
    path = f"{root}/items"
    first = versions.publish(spark.createDataFrame([(1, "a", 1.0)], ITEMS), path)
    mine, theirs = (spark.createDataFrame([(1, c, 2.0)], ITEMS) for c in "mt")
    versions.publish(theirs, path, made_from=first.number)
    with pytest.raises(versions.WriteConflict):
        versions.publish(mine, path, made_from=first.number)
    assert rows(versions.read(spark, path)) == [(1, "t", 2.0)]


def test_old_snapshots_expire(spark, root):
    path = f"{root}/items"
    for n in range(1, 5):
        versions.publish(spark.range(n).toDF("id"), path, {"n": n})
    gone = versions.expire(spark, path, keep=2)
    assert len(gone) == 2
    assert [(v.number, v.properties["n"]) for v in versions.versions(spark, path)] == [(3, 3), (4, 4)]
    assert versions.read(spark, path).count() == 4
    with pytest.raises(ValueError):
        versions.expire(spark, path, keep=0)


def test_a_table_without_snapshots_is_read_as_it_lies(spark, root):
    spark.range(3).write.parquet(f"{root}/plain")
    assert versions.current(spark, f"{root}/plain") is None
    assert versions.read(spark, f"{root}/plain").count() == 3
    maintain.save(spark, f"{root}/plain", lambda t: t.filter("id > 0"))
    assert versions.read(spark, f"{root}/plain").count() == 2


def test_saved_upsert_returns_what_it_rejects(spark, root):
    path = f"{root}/items"
    versions.publish(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], ITEMS), path)
    batch = spark.createDataFrame([(2, "b", 9.0), (0, "c", 3.0), (1, "", 1.0)], ITEMS)
    rejected = maintain.save_upsert(batch, path, "id", maintain.safety_stock_checks())
    assert [r.reason for r in rejected.collect()] == ["item code is required"]
    assert rows(versions.read(spark, path)) == [(1, "a", 1.0), (2, "b", 9.0), (3, "c", 3.0)]


# --- numbers -----------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 200])
def test_keys_do_not_depend_on_partitions(spark, parts):
    new = [(None, f"i{n % 40:02}", float(n % 40)) for n in range(400)]
    base = spark.createDataFrame([(10, "x", 0.0)], ITEMS)
    saved, _ = maintain.upsert(base, spark.createDataFrame(new, ITEMS).repartition(parts), "id")
    assert "row_number" not in plan(saved)
    expected = [(10, "x", 0.0)] + [
        (11 + i, code, stock) for i, (code, stock) in enumerate(sorted(r[1:] for r in new))
    ]
    assert sorted(map(tuple, saved.collect())) == expected


def test_numbers_of_equal_rows_and_of_none(spark):
    frame = spark.createDataFrame([("same",)] * 300 + [("a",), (None,)], "k string").repartition(16)
    found = number_rows(frame, ["k"], "n")
    assert sorted(r.n for r in found.collect()) == list(range(1, 303))
    assert {r.k: r.n for r in found.filter("n <= 2").collect()} == {None: 1, "a": 2}
    assert found.filter("k = 'same'").agg(F.min("n"), F.max("n")).first()[:] == (3, 302)
    assert number_rows(frame.limit(0), ["k"], "n").collect() == []


def test_numbering_spreads_one_hot_key(spark):
    frame = spark.range(0, 20_000, 1, 8).select(F.lit("hot").alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = number_rows(frame, ["k"], "n").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in found.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 1 and max(sizes) < 10_000


# --- closed years ------------------------------------------------------------


@pytest.fixture(scope="module")
def closed(spark, books, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("books"))
    for name in books.names:
        if name in ("journal_line", "accounts_master", "bank_accounts_master", "sales_header", "purchase_header"):
            write_table(books[name], root, name)
    closing.close_years(spark, root, 1996)
    closing.close_years(spark, root, 1999)
    return root


@pytest.mark.parametrize("period", [Period.yearly(2000), Period.monthly(1999, [2, 5])])
def test_reports_pick_up_closed_years(spark, books, closed, period):
    tables = Tables.from_parquet(spark, closed)
    assert tables.closed_before == 1999
    for name in ("summary", "accounts", "banks"):
        assert rows(cash.cash_period(tables, period)[name]) == rows(cash.cash_period(books, period)[name])
    for name in ("kpis", "cash"):
        ours, theirs = (control.control_period(t, period)[name] for t in (tables, books))
        assert rows(ours) == rows(theirs)


def test_closed_partitions_are_not_read(spark, closed):
    tables = Tables.from_parquet(spark, closed)
    df = ledger.group_balances(tables.journal_line, Period.yearly(2000))
    df.collect()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df))
    assert any("journal_year" in f and "1999" in f for f in filters)


def test_reports_of_closed_years_raise(spark, closed):
    tables = Tables.from_parquet(spark, closed)
    request = {"Period": "yearly", "Months": "", "Quarter": 0, "Year": 1998, "Month": 3}
    for report in ("cash_period", "control_period", "control_month", "expenses_period", "sales_period", "sales_month"):
        with pytest.raises(ClosedYear):
            for listed in api.run(report, tables, request).values():
                listed.collect()
    with pytest.raises(ClosedYear):
        api.run("purchasing_period", tables, request)["kpis"].collect()
    all_lines = Tables.from_parquet(spark, closed, closed=False)
    assert cash.cash_period(all_lines, Period.yearly(1998))["summary"].count() > 0


def test_closing_again_reads_new_years_only(spark, closed, books):
    with pytest.raises(ValueError, match="closed"):
        closing.close_years(spark, closed, 1999)
    df = closing._lines(spark, closed, 1996, 1999)
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(df)).group(1)
    assert "1996" in filters and "1999" in filters
    keys = closing.KEYS
    balances = versions.read(spark, f"{closed}/{closing.BALANCES}")
    assert balances.groupBy(*keys).count().filter("count > 1").isEmpty()
    plain = books.journal_line.filter(F.year("journal_date") < 1999).agg(F.sum("debit_book")).first()[0]
    assert balances.agg(F.sum("debit_book")).first()[0] == plain


def test_lines_without_date_stay_with_the_open_ones(spark, make_tables, root):
    lines = make_tables(
        journal_line=[
            {"account": "1241", "journal_date": d, "debit_book": n, "credit_book": 0}
            for d, n in (("1997-05-01", 1), ("1999-05-01", 2), (None, 4))
        ]
    ).journal_line
    write_table(lines, root, "journal_line")
    closing.close_years(spark, root, 1999)
    assert Tables.from_parquet(spark, root).journal_line.agg(F.sum("debit_book")).first()[0] == 7


# --- the summary -------------------------------------------------------------


@pytest.fixture
def stored(spark, books, root):
    for name in ("sales_header", "sales_line", "item_master"):
        write_table(books[name], root, name)
    return root


def built(spark, root):
    tables = Tables.from_parquet(spark, root, closed=False)
    columns = ["customer_no", "summary_year", "summary_month", "total_amount", "total_weight", "total_volume"]
    whole = sales.customer_monthly_summary(tables).select(*columns)
    return rows(tables.customer_monthly_summary.select(*columns)), rows(whole)


def test_refresh_rebuilds_what_changed(spark, stored):
    every = summary.refresh_summary(spark, stored)
    assert {1996, 1997, 1998} <= every
    ours, whole = built(spark, stored)
    assert ours == whole
    assert summary.stale_years(spark, stored) == set() == summary.refresh_summary(spark, stored)

    lines = Tables.from_parquet(spark, stored).sales_line
    write_table(lines.filter("line_year = 1997 AND int_id % 3 = 0").drop("line_year"), stored, "sales_line")
    assert summary.refresh_summary(spark, stored) == {1997}
    ours, whole = built(spark, stored)
    assert ours == whole

    header = Tables.from_parquet(spark, stored).sales_header.filter("header_year = 1996").drop("header_year")
    other = header.withColumn("customer_number", F.lit("7"))
    write_table(other.filter("internal_id % 2 = 0"), stored, "sales_header")
    refreshed = summary.refresh_summary(spark, stored)
    # and the years of all lines that belong to these invoices
    assert 1996 in refreshed
    ours, whole = built(spark, stored)
    assert ours == whole


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}


def test_a_refresh_leaves_no_sums_behind(spark, stored, monkeypatch):
    monkeypatch.setattr(summary, "TURN_BYTES", 0)
    held = []
    rebuild = summary._rebuild

    def one_turn(tables, root, names, turn, years):
        held.append(set(turn))
        rebuild(tables, root, names, turn, years)

    monkeypatch.setattr(summary, "_rebuild", one_turn)
    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    sums, files = set(folder.glob("rdd-*")), shuffle_files(spark)
    years = summary.refresh_summary(spark, stored)
    assert set(folder.glob("rdd-*")) <= sums
    until = time.time() + 20
    while shuffle_files(spark) - files and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - files
    # one year at a time, each year once
    assert sorted(map(len, held)) == [1] * len(years) and set().union(*held) == years
    ours, whole = built(spark, stored)
    assert ours == whole


def test_turns_hold_a_share_of_the_bytes(monkeypatch):
    monkeypatch.setattr(summary, "TURN_BYTES", 10)
    assert summary._turns({2001: 4, None: 3, 1999: 3, 2000: 4}) == [{None, 1999, 2000}, {2001}]
    assert summary._turns({1999: 0, 2000: 50, 2001: 1}) == [{1999}, {2000}, {2001}]
    assert summary._turns({y: 80 for y in range(2000, 2016)}) == [{y, y + 1} for y in range(2000, 2016, 2)]
    assert summary._turns({}) == []


def test_repeated_ids_far_apart_count_in_every_turn(spark, make_tables, root, monkeypatch):
    monkeypatch.setattr(summary, "TURN_BYTES", 0)
    header = {"total_taxable_amount": 5, "exchange_rate": 1}
    dated = ((1, "1990-02-03", "7"), (1, "2000-02-03", "8"), (2, "2000-02-03", None), (3, None, "9"), (None, "1990-01-01", "6"))
    tables = make_tables(
        sales_header=[{"internal_id": i, "invoice_date": d, "customer_number": c, **header} for i, d, c in dated],
        sales_line=[
            {"int_id": i, "item_id": i, "invoice_date": d, "line_weight": 3, "invoiced_quantity": 2}
            for i, d in ((1, "2000-03-01"), (1, "1990-03-01"), (2, None), (3, "1995-01-01"), (None, "1990-01-01"), (4, "2000-01-01"))
        ],
        item_master=[{"item_id": 1, "volume": 4}, {"item_id": 1, "volume": 5}],
    )
    for name in ("sales_header", "sales_line", "item_master"):
        write_table(tables[name], root, name)
    assert summary.refresh_summary(spark, root) == {None, 1990, 1995, 2000}
    ours, whole = built(spark, root)
    assert ours == whole and len(ours) == 11


def test_a_year_that_goes_leaves_the_summary(spark, stored):
    summary.refresh_summary(spark, stored)
    from bizpanel.sources.tables import drop_partition

    drop_partition(spark, stored, "sales_header", "header_year", 1998)
    drop_partition(spark, stored, "sales_line", "line_year", 1998)
    assert 1998 in summary.refresh_summary(spark, stored)
    ours, whole = built(spark, stored)
    assert ours == whole


def test_a_changed_item_rebuilds_all(spark, stored, books):
    every = summary.refresh_summary(spark, stored)
    write_table(books.item_master.withColumn("volume", (F.col("volume") * 2).cast("decimal(18,5)")), stored, "item_master")
    assert summary.refresh_summary(spark, stored) == every
    ours, whole = built(spark, stored)
    assert ours == whole


def test_some_years_equal_the_whole(spark, stored, books):
    columns = ["customer_no", "summary_year", "summary_month", "total_amount", "total_weight", "total_volume"]
    tables = Tables.from_parquet(spark, stored)
    some = sales.customer_monthly_summary(tables, years={1995, 1997}).select(*columns)
    whole = sales.customer_monthly_summary(books).select(*columns)
    assert rows(some) == rows(whole.filter("summary_year IN (1995, 1997)"))
    headers = sales.of_years(tables.sales_header, sales.HEADER_YEAR, {1995})
    lines = sales.of_years(tables.sales_line, sales.LINE_YEAR, {1995})
    for df, name in ((headers, "header_year"), (lines, "line_year")):
        assert name in re.search(r"PartitionFilters: \[([^\]]*)\]", plan(df)).group(1)


def test_signatures_read_no_columns(spark, stored):
    found = changes.signatures(spark, f"{stored}/sales_line", "line", sales.LINE_YEAR)
    text = plan(found)
    assert "ReadSchema: struct<>" in text
    assert found.count() == Tables.from_parquet(spark, stored).sales_line.select("line_year").distinct().count()


def test_channels_read_two_years_of_headers(spark, stored):
    tables = Tables.from_parquet(spark, stored)
    df = sales.sales_channels(tables.sales_header, Period.yearly(1997), dt.date(1997, 6, 1))
    assert "header_year" in re.search(r"PartitionFilters: \[([^\]]*)\]", plan(df)).group(1)


# --- prices and trees ----------------------------------------------------------


def test_prices_of_parts_merge_to_the_whole(books):
    header, line = books.purchase_header, books.purchase_line
    whole = stock.last_price(header, line)

    def priced(some):
        joined = some.join(line, some["internal_id"] == line["int_id"]).filter("coalesce(item_code, '') <> ''")
        return stock.merge_prices(
            joined.select(
                "item_code",
                "internal_id",
                F.col("price").alias("last_price"),
                F.col("invoice_currency").alias("last_currency"),
                F.col("invoice_date").alias("last_invoice_date"),
                F.col("invoice_exchange_rate").alias("last_exchange_rate"),
            )
        )

    parts = priced(header.filter("internal_id % 3 = 0")).unionByName(priced(header.filter("internal_id % 3 <> 0")))
    merged = stock.merge_prices(parts).drop("internal_id")
    assert rows(merged.select(*whole.columns)) == rows(whole)


def test_lines_are_reduced_before_the_price_join(books):
    text = plan(stock.last_price(books.purchase_header, books.purchase_line)).split("Initial Plan")[-1]
    assert "functions=[partial_max(price" in text or "functions=[max(price" in text


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    from bizpanel.operators import hierarchy

    rounds = []
    plain = hierarchy.cut
    monkeypatch.setattr(hierarchy, "cut", lambda df: rounds.append(1) or plain(df))
    chain = [(i, i - 1, 0, f"n{i}") for i in range(1, 301)]
    loop = [(901, 903, 0, "x"), (902, 901, 0, "y"), (903, 902, 0, "z"), (904, 903, 0, "below"), (905, 905, 0, "self")]
    staff = spark.createDataFrame(chain + loop, "employee_id int, manager_id int, is_manager int, full_name string")
    tree = {r.employee_id: r for r in org_tree(staff).collect()}
    assert set(tree) == set(range(1, 301))
    assert [tree[i].level for i in (1, 2, 300)] == [0, 1, 299]
    assert {r.root_id for r in tree.values()} == {1}
    assert tree[300].path == "/".join(str(i) for i in range(1, 301))
    assert len(rounds) <= 11



# --- clients of stored months ------------------------------------------------

CHARGES = "client_id int, charging_year int, charging_month int"


def counted(months, year, chosen):
    return tuple(clients.active_clients(months, Period.monthly(year, chosen)).first())


def test_clients_of_any_months_count_once(spark):
    # zero, negative and distant ids, a client in every month, repeated rows, a missing id
    ids = [0, 1, -1, 32768, 32769, -32768, -32769, 2**31 - 1, -(2**31)]
    data = [(c, year, m) for i, c in enumerate(ids) for year in (1999, 2000) for m in (1 + i % 12, 12 - i % 12, 7)]
    data = data * 2 + [(None, 2000, 7), (5, 1999, 2), (6, 1998, 2)]
    charging = spark.createDataFrame(data, CHARGES)
    months = clients.client_months(charging)
    for chosen in ((1, 3), (7,), (2,), (4, 5, 6), tuple(range(1, 13))):
        want = tuple(
            len({c for c, y, m in data if c is not None and y == year and m in chosen}) for year in (2000, 1999)
        )
        assert counted(months, 2000, chosen) == want
    to_date = {r.month: tuple(r[1:]) for r in clients.active_clients_to_date(months, 2000).collect()}
    assert to_date[12] == counted(months, 2000, range(1, 13)) and to_date[2] == counted(months, 2000, (1, 2))
    assert rows(distinct_of(months, ["charging_year"], "n")) == [(1998, 1), (1999, 10), (2000, 9)]
    assert counted(months.limit(0), 2000, (1,)) == (0, 0)


def test_client_months_follow_the_history(spark, root, books):
    write_table(books.charging, root, "charging")
    every = clients.refresh_client_months(spark, root)
    assert {1999, 2000} <= every
    assert clients.refresh_client_months(spark, root) == set()
    tables = Tables.from_parquet(spark, root)
    changed = tables.charging.filter("charging_year = 1999 AND client_id % 2 = 0")
    write_table(changed, root, "charging")
    drop_partition(spark, root, "charging", "charging_year", 1998)
    assert clients.refresh_client_months(spark, root) == {1998, 1999}
    tables = Tables.from_parquet(spark, root)
    assert tables.client_months.filter("charging_year = 1998").isEmpty()
    stored = clients.active_clients_by_quarter(tables.client_months, 2000)
    assert rows(stored) == rows(loyalty.distinct_clients_by_quarter(tables, 2000))
    text = plan(clients.active_clients(tables.client_months, Period.monthly(2000, [1, 3])))
    assert "charging_year" in re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "In(charging_month" in text


# --- headers bounded by the ids of the lines ---------------------------------


def scanned(df) -> list[int]:
    """Rows that each scan of the executed plan gave."""
    df.collect()
    found = []

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_headers_beyond_the_lines_are_not_read(spark, root):
    """Of 100,000 headers in many row groups, those that lines of one year can belong to."""
    header = spark.range(100_000).select(F.col("id").alias("internal_id"), (F.col("id") % 7).alias("rate"))
    header.coalesce(1).write.option("parquet.block.size", 16_384).option("parquet.page.size", 4_096).parquet(f"{root}/h")
    line = spark.createDataFrame([(50_000, 1), (50_010, 2), (50_003, 5), (50_003, 6), (None, 1)], "int_id long, n int")
    left = bounded_by(spark.read.parquet(f"{root}/h"), "internal_id", line, "int_id")
    assert [r[0] for r in left.orderBy("internal_id").select("internal_id").collect()] == list(range(50_000, 50_011))
    assert max(scanned(left)) < 2_000
    assert bounded_by(spark.read.parquet(f"{root}/h"), "internal_id", line.limit(0), "int_id").count() == 0


def test_bounded_reports_equal_unbounded_ones(spark, stored, root, books):
    day, period = dt.date(1997, 3, 5), Period.monthly(1997, [2, 3])
    tables = Tables.from_parquet(spark, stored)
    weights = sales.line_metrics(tables, period, day)
    text = plan(weights)
    assert len(re.findall(r"internal_id#\d+L? [<>]= Subquery", text)) >= 2
    assert rows(weights) == rows(sales.line_metrics(books, period, day))
    for name in ("purchase_header", "purchase_line"):
        write_table(books[name], root, name)
    bought = Tables.from_parquet(spark, root)
    raw = purchasing.raw_purchasing(bought.purchase_header, bought.purchase_line, period, bounded=True)
    assert rows(raw) == rows(purchasing.raw_purchasing(books.purchase_header, books.purchase_line, period))
