import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martwright.operators import quality
from martwright.plans import model_tests, validation


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(1, "a", D("5"), "x"), (1, "b", D("-1"), "y"), (2, None, None, "y"), (None, "c", D("0"), "z"), (None, "a", D("1"), None)]
    return spark.createDataFrame(rows, "id int, kind string, price decimal(10,2), ref string")


def failures(check):
    row = check.first()
    assert row["passed"] == (row["failures"] == 0)
    return row["failures"]


def test_unique(broken):
    assert failures(quality.check_unique(broken, "t", "id")) == 1
    assert failures(quality.check_unique(broken, "t", "kind", "price")) == 0
    assert [tuple(r) for r in quality.duplicated(broken, ["id"]).collect()] == [(1, 2)]


def test_not_null(broken):
    got = {r.column: r.failures for r in quality.check_not_null(broken, "t", ["id", "kind", "price"]).collect()}
    assert got == {"id": 2, "kind": 1, "price": 1}


def test_accepted(broken):
    assert failures(quality.check_accepted(broken, "t", "kind", ["a"])) == 2
    assert failures(quality.check_accepted(broken, "t", "kind", ["a", "b", "c"])) == 0
    assert {r.kind for r in quality.unaccepted(broken, "kind", ["a"]).collect()} == {"b", "c"}


def test_relationships(spark, broken):
    parent = spark.createDataFrame([("x",)], "ref string")
    assert failures(quality.check_fk(broken, "t", "ref", parent, "ref")) == 3
    assert {r.key: r.rows for r in quality.unparented(broken, "ref", parent, "ref").collect()} == {"y": 2, "z": 1}


def test_rules_and_scrape(spark, broken):
    assert failures(quality.check_rule(broken, "t", "price not positive", F.col("price") <= 0)) == 2
    prices = spark.createDataFrame([(" ", "c", D("1")), ("n", "c", D("0")), ("n", "c", D("2")), ("n", "d", D("2"))], "product_name string, category string, competitor_price decimal(10,2)")
    assert [r.failures for r in quality.check_scrape(prices).collect()] == [1, 1, 1]


def test_grain(broken):
    assert tuple(quality.check_grain(broken, "id").first()) == (5, 2)


def test_null_profile_and_duplicates(broken):
    assert tuple(validation.null_profile(broken, ["id", "kind"]).first()) == (2, 1, 5)
    # Null keys count as one key here, as GROUP BY does.
    assert [tuple(r) for r in validation.duplicate_keys(broken, "id").collect()] == [(None, 2), (1, 2)]


def test_all_duplicate_ids_are_listed(spark, small):
    """More than ten ids of a table come twice, one three times, and ids are missing."""
    from types import SimpleNamespace

    from __spark_entry__ import REPORTS

    ids = spark.range(40).selectExpr("if(id = 39, null, concat('K', lpad(cast(id % 20 as string), 2, '0'))) as k")
    ids = ids.union(spark.createDataFrame([("K00",), (None,)], "k string"))
    keys = {"order_items": "order_item_id", "orders": "order_id", "customers": "customer_id", "products": "product_id"}
    raw = SimpleNamespace(**{table: ids.select(F.col("k").alias(key)) for table, key in keys.items()})
    got = [tuple(r) for r in REPORTS["duplicate_ids"](SimpleNamespace(raw=raw)).collect()]
    each = [("K00", 3), *((f"K{i:02d}", 2) for i in range(1, 19)), (None, 2)]
    assert len(got) == 80 and set(got) == {(table, key, n) for table in keys for key, n in each}
    # A first look at one column stays a first look.
    assert validation.duplicate_keys(ids, "k").count() == 10


def test_business_rules(spark):
    items = spark.createDataFrame([(0, D("0.5")), (-1, None), (1, D("1.5")), (1, D("-0.1"))], "quantity int, discount decimal(5,4)")
    assert validation.invalid_quantity(items).first()[0] == 2
    assert validation.invalid_discount(items).first()[0] == 2
    products = spark.createDataFrame([(D("1"), D("1")), (D("2"), D("1"))], "base_cost decimal(10,2), retail_price decimal(10,2)")
    assert validation.cost_exceeds_retail(products).first()[0] == 2


def test_approximate_distinct(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    exact = {r.k: r.distinct_id for r in validation.count_distinct(df, ["k"], ["id"]).collect()}
    rough = {r.k: r.distinct_id for r in validation.count_distinct(df, ["k"], ["id"], approx=True).collect()}
    assert exact == {0: 2500, 1: 2500}
    assert all(abs(rough[k] - 2500) < 250 for k in rough)


def test_all_declared_tests(small):
    rows = model_tests.model_tests(small).collect()
    assert len(rows) == 63
    assert all(r.passed for r in rows), [r for r in rows if not r.passed]


def test_relations_in_one_shuffle(spark, plan):
    child = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (3, "y"), (None, "z")], "id int, ref string")
    parent = spark.createDataFrame([("x", 1), ("w", 3), ("x", 1)], "ref string, up int")
    relations = [("child", "ref", "parent", "ref"), ("parent", "up", "child", "id"), ("child", "id", "parent", "up")]
    found = quality.check_fk_columns([(child, "child"), (parent, "parent")], relations)
    text = plan(found)
    assert {(r["table"], r["column"]): r["failures"] for r in found.collect()} == {("child", "ref"): 3, ("parent", "up"): 0, ("child", "id"): 1}
    for table, column, other, key in relations:
        frames = {"child": child, "parent": parent}
        alone = quality.check_fk(frames[table], table, column, frames[other], key).first()["failures"]
        assert alone == next(r["failures"] for r in found.collect() if (r["table"], r["column"]) == (table, column))
    # One exchange meets all keys, a second one adds up a row per relation.
    assert len(re.findall(r"Exchange hashpartitioning\(test#\d+, value", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 3


def test_row_tests_by_frame(broken):
    tests = [quality.not_null_test("t", "id"), quality.accepted_test("t", "kind", ["a"]), quality.CellTest("rule", "t", "price not positive", F.col("price") <= 0, F.col("price"))]
    found = quality.check_cells([(broken, tests), (broken.limit(0), [quality.not_null_test("empty", "id")])])
    assert [tuple(r) for r in found.orderBy("table", "check").collect()] == [("not_null", "empty", "id", 0, True), ("accepted_values", "t", "kind", 2, False), ("not_null", "t", "id", 2, False), ("rule", "t", "price not positive", 2, False)]
    cells = {(r["test"], r["value"], r["rows"]) for r in quality.failing_cells([(broken, tests)]).collect()}
    assert cells == {(0, None, 2), (1, "b", 1), (1, "c", 1), (2, "-1.00", 1), (2, "0.00", 1)}


def test_declared_row_tests_read_each_raw_table_once(small, plan):
    text = plan(model_tests.row_tests(small))
    for table in ("customer", "orders", "lineitem", "part"):
        assert len(re.findall(rf"Location: \S+ \[file:\S+/{table}\.parquet\]", text)) <= 1, table
    found = model_tests.row_tests(small).collect()
    wanted = {(t, c) for t, columns in model_tests.NOT_NULL.items() for c in columns} | {(t, c) for t, c, _ in model_tests.ACCEPTED}
    assert {(r["table"], r["column"]) for r in found} == wanted and len(found) == 36 + 7


def test_failing_values_are_kept(spark, small):
    from martwright.plans.warehouse import Warehouse
    from martwright.sources.schemas import RawTables

    orders = small.raw.orders
    tables = {name: getattr(small.raw, name) for name in ("customers", "products", "order_items", "competitor_prices")}
    odd = orders.withColumn("order_status", F.when(F.crc32("order_id") % 7 == 0, "Lost").otherwise(F.col("order_status")))
    house = Warehouse(spark, RawTables(orders=odd, **tables), small.as_of)
    frames = [f for f in model_tests._frames(house) if any(t.table == "stg_orders" for t in f[1])]
    lost = odd.where("order_status = 'Lost'").count()
    assert [(r["value"], r["rows"]) for r in quality.failing_cells(frames).collect()] == [("Lost", lost)] and lost > 0


def test_tasks_count_few_keys_each(spark, monkeypatch, plan):
    """Keys are dealt before they are counted, to the more tasks the more rows there are."""
    from martwright.operators import rows

    monkeypatch.setattr(rows, "KEYS_PER_TASK", 100)
    table = spark.range(1000).selectExpr("if(id < 5, null, cast(id % 990 as string)) as k")
    found = validation.duplicate_keys(table, "k")
    assert "REPARTITION_BY_NUM" in plan(found) and plan(found).count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in found.collect()] == [(None, 5), *((str(i), 2) for i in range(5, 10))]
    checked = quality.check_unique_columns([(table, "t", ["k"])])
    assert "REPARTITION_BY_NUM" in plan(checked) and [r.failures for r in checked.collect()] == [5]


def _pairs(spark):
    """A table beside what is staged of it: a row that is dropped, a cell that is changed, values that repeat in one or both."""
    rows = [("a", "a"), ("a", None), ("b", "b"), ("b", "b"), ("c", "x"), ("d", "x"), ("e", None), ("f", "f"), (None, None), (None, "g")]
    pairs = spark.createDataFrame(rows, "r string, s string").select(F.struct(F.col("r").alias("k")).alias("raw"), F.struct(F.col("s").alias("k")).alias("stg"))
    other = spark.range(6).select((F.col("id") % 4).alias("k"), F.col("id").alias("n"))
    frames = [(pairs, [("raw", "k", F.col("raw.k")), ("stg", "k", F.col("stg.k"))]), (other, [("other", "k", F.col("k")), ("other", "n", F.col("n"))])]
    return frames, {("raw", "k"): 2, ("stg", "k"): 2, ("other", "k"): 2, ("other", "n"): 0}


def _unique(frames):
    return {(r["table"], r["column"]): r["failures"] for r in quality.check_unique_cells(frames).collect()}


def test_unique_cells_of_shared_frames(spark, monkeypatch):
    frames, wanted = _pairs(spark)
    assert _unique(frames) == wanted
    # Values that share a digest are told apart, few or many.
    digest = quality._digest
    monkeypatch.setattr(quality, "_digest", lambda *a: F.pmod(digest(*a), F.lit(2)))
    assert _unique(frames) == wanted
    monkeypatch.setattr(quality, "HELD_DIGESTS", 0)
    assert _unique(frames) == wanted


def test_unique_values_go_as_digests(spark, monkeypatch):
    """What repeats is found from eight bytes a row, one row where raw and staged cells agree; clean tables are not read again."""
    written = []
    write = quality.write_stable
    monkeypatch.setattr(quality, "write_stable", lambda df, *a: written.append(df) or write(df, *a))
    clean = spark.range(100).select(F.struct(F.concat(F.lit("key"), F.col("id")).alias("k")).alias("raw")).withColumn("stg", F.col("raw"))
    frame = (clean, [("raw", "k", F.col("raw.k")), ("stg", "k", F.col("stg.k"))])
    digests = quality._digests([frame])[0]
    assert digests.dtypes == [("digest", "bigint")] and digests.count() == 100
    monkeypatch.setattr(quality, "_values", lambda frames: pytest.fail("read again"))
    assert _unique([frame]) == {("raw", "k"): 0, ("stg", "k"): 0} and written[0].columns == ["digest"]


def test_stored_tables_leave_no_shuffle_files(spark, small):
    """What was shuffled for a table is gone from the disk soon after the table is written."""
    import time

    env = spark._jvm.org.apache.spark.SparkEnv.get()
    blocks = lambda: {b.name() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllBlocks()) if b.name().startswith("shuffle_")}
    before = blocks()
    df = spark.range(1000).repartition(4, "id").groupBy("id").agg(F.count("*").alias("n"))
    small._stored(df, "left_behind")
    end = time.time() + 20
    while blocks() - before and time.time() < end:
        time.sleep(0.1)
    assert not blocks() - before
