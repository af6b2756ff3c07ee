import csv
import datetime as dt
import io
import json
import random
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql.types import StringType, StructField, StructType

from martwright.operators import rows
from martwright.operators.ranking import with_position
from martwright.sources import csv_records, files, schemas
from martwright.sources.tables import Versions, fingerprint, materialize, spread, write_full_refresh, write_stable

CSV = '''Order_ID,customer_id,order_date,payment_method,order_status
1,C1,2024-01-05,"Card, credit",Completed
2,C2,2024-13-01,NULL,null
3,C3,2024-02-01,NA,
4,C4,,"say ""hi""",Shipped
'''


def test_read_csv(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(CSV)
    got = [tuple(r) for r in files.read_csv(spark, str(path), schemas.ORDERS, {"Order_ID": "order_id"}).orderBy("order_id").collect()]
    assert got == [
        ("1", "C1", dt.date(2024, 1, 5), "Card, credit", "Completed"),
        ("2", "C2", None, None, None),
        ("3", "C3", dt.date(2024, 2, 1), None, None),
        ("4", "C4", None, 'say "hi"', "Shipped"),
    ]


def test_read_csv_casts_leniently(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("discount,order_item_id,order_id,product_id,quantity,unit_price\n0.1,i,o,p,two,9.99\n,j,o,p,3,NA\n")
    got = {r.order_item_id: r for r in files.read_csv(spark, str(path), schemas.ORDER_ITEMS).collect()}
    assert (got["i"].quantity, got["i"].unit_price, got["i"].discount) == (None, D("9.99"), D("0.1000"))
    assert (got["j"].quantity, got["j"].unit_price, got["j"].discount) == (3, None, None)


def test_quoted_line_break(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text('order_id,customer_id,order_date,payment_method\n1,C1,2024-01-05,"two\nlines"\n2,C1,2024-01-06,one\n')
    got = files.read_csv(spark, str(path), schemas.ORDERS, multiline=True).orderBy("order_id").collect()
    assert [r.payment_method for r in got] == ["two\nlines", "one"]


def quoted_rows(count):
    pick = random.Random(3)
    odd = ['say ""hi""', "two\nlines", '""', "a,b", "x\n\ny\r\nz", "plain", '\n""\n', "long " * 40, "\n".join("deep" * 5 for _ in range(30))]
    return [(f"{i}", f"C{i % 7}", "2024-01-05", pick.choice(odd)) for i in range(count)]


@pytest.mark.parametrize("size", ["300", "1000", "7000", "10m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_by_many_tasks(spark, tmp_path, size, end):
    """A file cut anywhere gives the records of a reader that sees it as a whole, line ends in quotes as they are."""
    rows_ = quoted_rows(400)
    text = "order_id,customer_id,order_date,payment_method" + end + "".join(f'{a},{b},{c},"{d}"{end}' for a, b, c, d in rows_)
    path = tmp_path / "orders.csv"
    path.write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = files.read_csv(spark, str(path), schemas.ORDERS, multiline=True)
        found = {r.order_id: (r.customer_id, r.payment_method) for r in got.collect()}
        tasks = csv_records.ranges_of(spark, str(path)).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {a: (b, d) for a, b, _, d in list(csv.reader(io.StringIO(text, newline="")))[1:]}
    assert len(found) == 400 and found == want
    assert tasks > 1 or size == "10m"


def test_headers_in_rows_and_odd_files(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    head = "order_id,customer_id,order_date\n"
    (folder / "a.csv").write_text("\ufeff" + head + "1,C1,2024-01-05\n" + head)
    (folder / "b.csv").write_text("")
    (folder / "c d.csv").write_text(head)
    (folder / "e.csv").write_text('"customer_id","order_id"\nC2,2\n\n"C\n3",3')
    got = files.read_csv(spark, str(folder), StructType([StructField(c, StringType()) for c in ("order_id", "customer_id", "order_date")]), multiline=True)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("1", "C1", "2024-01-05"), ("order_id", "customer_id", "order_date"), ("2", "C2", None), ("3", "C\n3", None)], key=repr)


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(count):
        folder = tmp_path / f"of{count}"
        folder.mkdir()
        for i in range(count):
            names = ["order_id", "customer_id", "order_date"][:: 1 if i % 2 else -1]
            cells = {"order_id": f"{i}", "customer_id": "C", "order_date": "2024-01-05"}
            (folder / f"{i}.csv").write_text(",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n")
        group = f"headers-{count}"
        spark.sparkContext.setJobGroup(group, group)
        frame = files.read_csv(spark, str(folder), schemas.ORDERS)
        found = {r.order_id for r in frame.collect()}
        assert found == {str(i) for i in range(count)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(4) == jobs(20) < 12


def test_optional_column_may_be_absent(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("product_name,competitor_price\nA,1.50\n")
    row = files.read_csv(spark, str(path), schemas.COMPETITOR_PRICES).first()
    assert (row.product_name, row.competitor_price, row.scraped_at) == ("A", D("1.50"), None)


def test_rename_and_coerce(spark):
    df = spark.createDataFrame([("1", "2024-02-30", "2024-02-29")], "ID string, Bad_Date string, order_date string")
    named = files.rename_columns(df, {"ID": "key"})
    assert named.columns == ["key", "bad_date", "order_date"]
    assert tuple(files.coerce_dates(named).first()) == ("1", None, dt.date(2024, 2, 29))


def test_export_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "c", dt.date(2024, 1, 1), ' padded "x", ', None)], schemas.ORDERS)
    for quote_all in (False, True):
        path = str(tmp_path / f"out{quote_all}")
        files.export_csv(df, path, quote_all)
        assert files.read_csv(spark, path, schemas.ORDERS).collect() == df.collect()


def test_export_json(spark, tmp_path):
    files.export_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in Path(tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None}


def test_records_are_complete(spark):
    assert len(rows.to_records(spark.range(2000))) == 2000
    cells = spark.createDataFrame([(1, None)], "a int, b string")
    assert rows.json_records(cells).first()[0] == '{"a":1,"b":null}'


def test_headers_of_a_folder_may_differ(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    (folder / "a.csv").write_text("order_id,customer_id,order_date\n1,C1,2024-01-05\n")
    (folder / "b.csv").write_text("customer_id,order_date,order_id,payment_method\nC2,2024-01-06,2,Card\n")
    (folder / "c.csv").write_text("order_id,customer_id,order_date\n3,C3,2024-01-07\n")
    got = files.read_csv(spark, str(folder), schemas.ORDERS).orderBy("order_id").collect()
    assert [(r.order_id, r.customer_id, r.order_date.day, r.payment_method) for r in got] == [("1", "C1", 5, None), ("2", "C2", 6, "Card"), ("3", "C3", 7, None)]


def test_dates_in_other_forms(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text('order_id,customer_id,order_date\n1,C1,01/15/2024\n2,C1,2024/01/16\n3,C1,17.01.2024\n4,C1,"Jan 18, 2024"\n5,C1,soon\n')
    got = files.read_csv(spark, str(path), schemas.ORDERS).orderBy("order_id").collect()
    assert [r.order_date and r.order_date.day for r in got] == [15, 16, 17, 18, None]


def test_expecting_no_rows(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,customer_id,order_date\n1,C1,2024-01-05\n")
    load = files.Load(str(tmp_path / "orders.csv"), str(tmp_path / "t"), schemas.ORDERS, 0)
    assert "expected 0" in files.load_all(spark, {"orders": load}).first().error


def test_load_all(spark, tmp_path):
    (tmp_path / "holes.csv").write_text(CSV.replace("Order_ID", "order_id"))
    (tmp_path / "orders.csv").write_text("order_id,customer_id,order_date\n1,C1,2024-01-05\n2,C1,2024-01-06\n")
    (tmp_path / "items.csv").write_text("order_id\n1\n")
    loads = {
        "orders": files.Load(str(tmp_path / "orders.csv"), str(tmp_path / "t/orders"), schemas.ORDERS, 5),
        "holes": files.Load(str(tmp_path / "holes.csv"), str(tmp_path / "t/holes"), schemas.ORDERS),
        "gone": files.Load(str(tmp_path / "gone.csv"), str(tmp_path / "t/gone"), schemas.ORDERS),
        "items": files.Load(str(tmp_path / "items.csv"), str(tmp_path / "t/items"), schemas.ORDER_ITEMS),
    }
    for _ in range(2):
        report = {r.table: r for r in files.load_all(spark, loads).collect()}
        assert [(report[t].status, report[t].rows) for t in ("orders", "gone", "items")] == [("SUCCESS", 2), ("FAILED", 0), ("FAILED", 0)]
        assert report["holes"].status == "FAILED" and "order_date" in report["holes"].error
        assert "expected 5" in report["orders"].error and "lacks the columns" in report["items"].error
    assert "_loaded_at" in Versions(spark, str(tmp_path / "t/orders")).read().columns
    # A load that fails its check leaves the old rows, and nothing behind.
    (tmp_path / "orders.csv").write_text("order_id,customer_id,order_date\n9,,2024-01-05\n")
    assert files.load_all(spark, {"orders": loads["orders"]}).first().status == "FAILED"
    kept = Versions(spark, str(tmp_path / "t/orders"))
    assert sorted(r.order_id for r in kept.read().collect()) == ["1", "2"] and kept.numbers() == [1, 2]
    assert len(list((tmp_path / "t/orders").glob("data-*"))) == 2


def test_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="no published"):
        table.read()
    first = table.write(spark.range(3))
    with pytest.raises(ValueError, match="no published"):
        table.read()
    table.publish(first)
    reader = table.read()
    other = Versions(spark, str(tmp_path / "v"))
    second, third = table.write(spark.range(5)), other.write(spark.range(7))
    assert reader.count() == 3 and other.read().count() == 3
    assert table.publish(second) == 2 and reader.count() == 3 and other.read().count() == 5
    other.numbers = lambda: [1]  # has not seen the second one
    with pytest.raises(ValueError, match="another writer"):
        other.publish(third)
    other.discard(third)
    assert table.read().count() == 5 and table.read(1).count() == 3
    table.publish(table.write(spark.range(1)))
    table.drop_old(1)
    assert table.read().count() == 1 and len(list((tmp_path / "v").glob("data-*"))) == 1


def test_row_counts(spark):
    got = {r.table_name: (r.row_count, r.matches) for r in files.check_row_counts({"a": spark.range(2), "b": spark.range(3), "c": spark.range(0)}, {"a": 2, "b": 4}).collect()}
    assert got == {"a": (2, True), "b": (3, False), "c": (0, True)}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        write_full_refresh(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert materialize(spark.range(2), "two_rows").count() == 2
    before = fingerprint(spark, [path])
    write_full_refresh(spark.range(6), path)
    assert fingerprint(spark, [path]) != before
    assert write_stable(spark.range(4), "four").count() == 4
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == 4


def test_limits_and_pages(spark):
    df = spark.range(501)
    assert rows.cap(df)[1] is True and rows.cap(df)[0].count() == 500
    assert rows.cap(spark.range(500))[1] is False
    assert rows.cap(spark.range(500), inclusive=True)[1] is True
    assert rows.optional_limit(df, 0).count() == 501 and rows.optional_limit(df, 3).count() == 3
    data = spark.createDataFrame([(i, i % 3 or None) for i in range(20)], "id int, v int")
    order, seen, after = [rows.By("v", True), "id"], [], None
    while True:
        part = rows.page(data, order, 6, after).collect()
        if not part:
            break
        seen += [r.id for r in part]
        after = (part[-1].v, part[-1].id)
    assert seen == [r.id for r in data.orderBy(*[rows.By("v", True).order(), "id"]).collect()]


def test_plans_name_whole_paths(spark, plan, tmp_path):
    folder = f"{tmp_path}/{'long' * 50}"
    spark.range(3).write.parquet(folder)
    assert folder in plan(spark.read.parquet(folder))


def test_filters(spark):
    df = spark.createDataFrame([("Ann", "Oslo", 3), ("Bob", None, None)], "name string, city string, n int")
    assert [r.name for r in rows.search(df, "oSl").collect()] == ["Ann"]
    assert rows.search(df, "", ["name"]).count() == 2
    assert rows.category_filter(df, "", "city").count() == 2 and rows.category_filter(df, "Os", "city").count() == 1
    assert rows.drop_null_keys(df, ["city", "n"]).count() == 1 and rows.keep_positive(df, ["n"]).count() == 1
    assert df.where(rows.in_list("name", ["Bob"])).count() == 1 and df.where(rows.out_of_range("n", 4, 5)).count() == 1
    assert rows.has_competitor(df, "n").count() == 1 and rows.having_count(df.unionByName(df), ["name"]).count() == 2
    assert [r.name for r in rows.sample_rows(df, 1, ["name"]).collect()] == ["Ann"]
    assert with_position(rows.order_for_display(df, ["name"]), [rows.By("name").order()]).columns[-1] == "position"
