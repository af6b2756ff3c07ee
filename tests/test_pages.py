from martwright.plans import pages
from martwright.plans.warehouse import Warehouse
from martwright.sources import files, schemas


def test_pages(small):
    for page in (pages.home, pages.revenue, pages.products, pages.customers):
        reports = pages.records(page(small))
        assert reports and all(reports.values())
    customers = pages.records(pages.customers(small))
    assert [r["month_num"] for r in customers["registration_trend"]] == sorted(r["month_num"] for r in customers["registration_trend"])
    assert customers["top_customers"][0]["total_revenue"] == max(r["total_revenue"] for r in customers["top_customers"])


def test_from_csv_files_to_reports(spark, small, tmp_path):
    """Loading the raw tables from files gives the same star schema."""
    for name in schemas.RAW_TABLES:
        files.export_csv(getattr(small.raw, name), f"{tmp_path}/in/{name}.csv")
    report = files.load_all(spark, files.csv_loads(f"{tmp_path}/in", f"{tmp_path}/raw")).collect()
    assert {r.status for r in report} == {"SUCCESS"} and len(report) == 5
    house = Warehouse(spark, files.loaded_tables(spark, f"{tmp_path}/raw"), small.as_of)
    assert "_loaded_at" in house.stg_orders.columns
    for name in ("dim_customer", "dim_product", "fct_sales", "customer_lifetime_value"):
        left, right = (getattr(h, name).drop("updated_at", "loaded_at") for h in (house, small))
        assert left.exceptAll(right.select(left.columns)).count() == 0 and left.count() == right.count()
