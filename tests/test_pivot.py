import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from martwright.operators import medians, pivot, ranking


@pytest.fixture(scope="module")
def sales(spark):
    pick = random.Random(4)
    rows = [(i, pick.choice(["A", "B", None]), pick.choice(["x", "y"]), D(pick.randrange(-500, 5000)) / 100, pick.randrange(1, 5)) for i in range(400)]
    return spark.createDataFrame(rows, "id int, cat string, pay string, net decimal(18,2), qty int")


def cells(frame, keys):
    return {tuple(r[k] for k in keys): r["value"] for r in frame.collect()}


def groups(sales):
    """Values per cell and total, by hand."""
    found = {}
    for r in sales.collect():
        for key in ((r.cat, r.pay), (r.cat, "Totals"), ("Totals", r.pay), ("Totals", "Totals")):
            found.setdefault(key, []).append(r)
    return found


BY_HAND = {
    "count": lambda g: len(g),
    "sum": lambda g: sum(r.net for r in g),
    "average": lambda g: float(sum(r.net for r in g)) / len(g),
    "min": lambda g: min(r.net for r in g),
    "max": lambda g: max(r.net for r in g),
    "median": lambda g: float(statistics.median(r.net for r in g)),
    "count_unique": lambda g: len({r.net for r in g}),
    "sample_variance": lambda g: statistics.variance([float(r.net) for r in g]),
    "sample_stdev": lambda g: statistics.stdev([float(r.net) for r in g]),
    "list_unique": lambda g: sorted({r.net for r in g}),
    "first": lambda g: min(g, key=lambda r: r.id).net,
    "last": lambda g: max(g, key=lambda r: r.id).net,
}


@pytest.mark.parametrize("agg", sorted(BY_HAND))
def test_aggregators(sales, agg):
    got = cells(pivot.pivot_long(sales, ["cat"], ["pay"], agg, "net", totals=True, order="id"), ["cat", "pay"])
    wanted = {k: BY_HAND[agg](g) for k, g in groups(sales).items()}
    assert set(got) == set(wanted)
    for key, value in wanted.items():
        assert got[key] == value if isinstance(value, list) else float(got[key]) == pytest.approx(float(value), abs=1e-6), key


@pytest.mark.parametrize("ranges, few", [(2, 0), (3, 5), (64, 0), (1024, 4096)])
def test_median_by_narrowing(sales, monkeypatch, ranges, few):
    """Whatever the number of ranges per round, the middle is found exactly."""
    monkeypatch.setattr(medians, "RANGES", ranges)
    monkeypatch.setattr(medians, "FEW", few)
    got = cells(pivot.pivot_long(sales, ["cat"], ["pay"], "median", "net", totals=True), ["cat", "pay"])
    assert {k: float(v) for k, v in got.items()} == {k: BY_HAND["median"](g) for k, g in groups(sales).items()}


@pytest.mark.parametrize("kind, values", [("double", [1e308, -1e308, 0.0, -0.0, 1e-300, float("nan"), None, 5.0]), ("bigint", [2**63 - 1, -(2**63), 0, 7, None, 7]), ("int", [3, 3, 3])])
def test_median_of_extreme_values(spark, monkeypatch, kind, values):
    monkeypatch.setattr(medians, "RANGES", 4)
    monkeypatch.setattr(medians, "FEW", 0)
    frame = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], f"k int, v {kind}")
    got = cells(pivot.pivot_long(frame, ["k"], [], "median", "v", totals=True), ["k"])
    for key in ("0", "1", "Totals"):
        mine = [float(v) for i, v in enumerate(values) if v is not None and v == v and key in (str(i % 2), "Totals")]
        assert float(got[(key,)]) == pytest.approx(statistics.median(mine), abs=1e-6)


def test_median_looks_at_no_group_as_a_whole(spark, monkeypatch):
    """Rows beyond the first round are a small part, even of a group that holds them all; no plan sorts values in a window."""
    written = []
    write = medians.write_stable

    def record(df, label):
        stored = write(df, label)
        written.append((label, stored.count(), df._jdf.queryExecution().executedPlan().toString()))
        return stored

    monkeypatch.setattr(medians, "write_stable", record)
    monkeypatch.setattr(medians, "FEW", 50)
    frame = spark.range(200_000).selectExpr("'one' as k", "id % 3 as c", "cast(xxhash64(id) % 1000000007 as decimal(20,2)) as v")
    got = cells(pivot.pivot_long(frame, ["k"], ["c"], "median", "v", totals=True), ["k", "c"])
    exact = {r["c"]: float(r["m"]) for r in frame.groupBy(F.col("c").cast("string").alias("c")).agg(F.expr("median(v)").alias("m")).collect()}
    assert all(float(got["one", c]) == pytest.approx(m, abs=1e-6) for c, m in exact.items())
    placed = [rows for label, rows, _ in written if label == "placed"]
    assert placed[0] == 200_000 and sum(placed[1:]) < 10_000
    assert not any("Window" in plan or "Generate" in plan for label, _, plan in written if label != "targets")


def test_median_reads_the_data_once(spark, monkeypatch):
    """One pass over the data, and ranges by generated code: neither a sketch before it nor a search per row."""
    read, plans, write = spark.sparkContext.accumulator(0), [], medians.write_stable

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(medians, "write_stable", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    frame = spark.range(20_000).selectExpr("id % 3 as k", "cast(xxhash64(id) % 100003 as decimal(18,2)) / 100 as v")
    exact = {str(r["k"]): float(r["m"]) for r in frame.groupBy("k").agg(F.expr("median(v)").alias("m")).collect()}
    got = cells(pivot.pivot_long(frame.mapInArrow(counted, frame.schema), ["k"], [], "median", "v", totals=True), ["k"])
    assert all(float(got[k,]) == pytest.approx(m, abs=1e-6) for k, m in exact.items())
    assert read.value == 20_000
    assert not any("lambdafunction" in plan for label, plan in plans if label in ("placed", "ranges"))


@pytest.mark.parametrize("kind, spread", [("decimal(20,4)", "100000000 + id % 2001"), ("double", "if(id % 2 = 0, -5, 0)"), ("int", "-1 - id % 7")])
def test_median_of_near_and_equal_values(spark, monkeypatch, kind, spread):
    """Ranges in proportion to values: near ones share the first of them, signs and zero do not mix."""
    monkeypatch.setattr(medians, "FEW", 10)
    frame = spark.range(6000).selectExpr("id % 2 as k", f"if(id % 11 = 0, null, cast({spread} as {kind})) as v")
    exact = {(str(r["k"]),): float(r["m"]) for r in frame.groupBy("k").agg(F.expr("median(v)").alias("m")).collect()}
    exact["Totals",] = float(frame.agg(F.expr("median(v)")).first()[0])
    got = cells(pivot.pivot_long(frame, ["k"], [], "median", "v", totals=True), ["k"])
    assert {k: float(v) for k, v in got.items()} == pytest.approx(exact, abs=1e-6)


def test_first_ranges_never_fall(spark):
    values = [float("-inf"), -1e308, -7.01, -7.0, -1.0, -0.3, -5e-324, -0.0, 0.0, 5e-324, 0.3, 1.0, 2.0, 2.5, 1e308, float("inf")]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(medians._first_range(F.col("v"))).collect()]
    assert found == sorted(found) and found.count(0) == 2 and len(set(found)) == len(values) - 1


def test_distinct_counts_read_the_data_once(spark, monkeypatch, tmp_path):
    frame = spark.range(5000).selectExpr("id % 7 as a", "if(id % 11 = 0, null, id % 5) as b", "if(id % 13 = 0, null, id % 977) as v")
    frame.write.parquet(f"{tmp_path}/source")
    frame, plans = spark.read.parquet(f"{tmp_path}/source"), []
    for module in (pivot, ranking):
        write = module.write_stable
        monkeypatch.setattr(module, "write_stable", lambda df, *a, write=write: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    table = pivot.pivot_long(frame, ["a"], ["b"], "count_unique", "v", totals=True)
    got = cells(table, ["a", "b"])
    plans.append(table._jdf.queryExecution().executedPlan().toString())
    assert sum(plan.count(f"{tmp_path}/source") for plan in plans) == 1
    rows = frame.collect()
    for (a, b), n in got.items():
        mine = [r for r in rows if a in (str(r["a"]), "Totals") and b in (None if r["b"] is None else str(r["b"]), "Totals")]
        assert n == len({r["v"] for r in mine} - {None})
    assert len(got) == 8 * 7


def test_distinct_counts_beyond_one_bitmap(spark):
    frame = spark.range(100_000).selectExpr("id % 2 as k", "id as v")
    assert cells(pivot.pivot_long(frame, ["k"], [], "count_unique", "v", totals=True), ["k"]) == {("0",): 50_000, ("1",): 50_000, ("Totals",): 100_000}
    nothing = spark.createDataFrame([("a", None), ("b", 1)], "k string, v int")
    assert cells(pivot.pivot_long(nothing, ["k"], [], "count_unique", "v"), ["k"]) == {("a",): 0, ("b",): 1}


def test_median_of_equal_values(spark):
    same = spark.range(9).select(F.lit("a").alias("k"), F.lit(2).alias("v"))
    assert cells(pivot.pivot_long(same, ["k"], [], "median", "v"), ["k"]) == {("a",): D("2")}


def test_ratio_and_fractions(sales):
    by_hand = groups(sales)
    total = sum(r.net for r in by_hand["Totals", "Totals"])
    got = cells(pivot.pivot_long(sales, ["cat"], ["pay"], "sum_over_sum", ("net", "qty"), True), ["cat", "pay"])
    for key, g in by_hand.items():
        assert float(got[key]) == pytest.approx(float(sum(r.net for r in g)) / sum(r.qty for r in g), abs=1e-6)
    bases = {
        "fraction_of_total": lambda k: total,
        "fraction_of_row": lambda k: sum(r.net for r in by_hand[k[0], "Totals"]),
        "fraction_of_column": lambda k: sum(r.net for r in by_hand["Totals", k[1]]),
    }
    for agg, base in bases.items():
        got = cells(pivot.pivot_long(sales, ["cat"], ["pay"], agg, "net"), ["cat", "pay"])
        for key, value in got.items():
            assert float(value) == pytest.approx(float(sum(r.net for r in by_hand[key]) / base(key)), abs=1e-6)


def test_cross_table(sales):
    by_hand = groups(sales)
    for headings in (None, ["x", "y"]):
        table = pivot.pivot_table(sales, ["cat"], ["pay"], "sum", "net", headings=headings)
        assert set(table.columns) == {"cat", "x", "y", "Totals"}
        for row in table.collect():
            for heading in ("x", "y", "Totals"):
                assert row[heading] == sum(r.net for r in by_hand[row["cat"], heading])


def test_cross_table_with_two_column_attributes(sales):
    table = pivot.pivot_table(sales, ["cat"], ["pay", "qty"], "count")
    assert {"x / 1", "y / 4", "Totals"} <= set(table.columns)
    assert sum(r["Totals"] for r in table.where("cat <> 'Totals' or cat is null").collect()) == 400


def test_headings_are_one_to_one(spark):
    rows = [("r", "x", None, 1), ("r", None, "x", 10), ("r", "a / b", "c", 5), ("r", "a", "b / c", 7), ("r", "Totals", "Totals", 3)]
    table = pivot.pivot_table(spark.createDataFrame(rows, "k string, p string, q string, v int"), ["k"], ["p", "q"], "sum", "v")
    line = next(r.asDict() for r in table.collect() if r["k"] == "r")
    assert line == {"k": "r", "x / \\N": 1, "\\N / x": 10, "a \\/ b / c": 5, "a / b \\/ c": 7, "Totals / Totals": 3, "Totals": 26}


def test_values_named_like_the_totals(spark):
    rows = [("Totals", "y", 1), ("r", "y", 10), ("r", "Totals", 4), ("r", None, 2)]
    table = pivot.pivot_table(spark.createDataFrame(rows, "k string, p string, v int"), ["k"], ["p"], "sum", "v")
    lines = sorted((r["k"], r["y"], r["\\Totals"], r["\\N"], r["Totals"]) for r in table.na.fill(0).collect())
    assert lines == [("Totals", 1, 0, 0, 1), ("Totals", 11, 4, 2, 17), ("r", 10, 4, 2, 16)]


def test_unlisted_value_is_an_error(sales):
    with pytest.raises(Exception, match="no heading for the value y"):
        pivot.pivot_table(sales, ["cat"], ["pay"], "sum", "net", headings=["x"]).collect()


def test_median_keeps_empty_cells(spark):
    frame = spark.createDataFrame([("a", None), ("b", 1), ("b", 4)], "k string, v int")
    assert cells(pivot.pivot_long(frame, ["k"], [], "median", "v", totals=True), ["k"]) == {("a",): None, ("b",): D("2.5"), ("Totals",): D("2.5")}


def test_count_fractions(sales):
    by_hand = groups(sales)
    got = cells(pivot.pivot_long(sales, ["cat"], ["pay"], "count_fraction_of_row"), ["cat", "pay"])
    assert all(float(v) == pytest.approx(len(by_hand[k]) / len(by_hand[k[0], "Totals"]), abs=1e-6) for k, v in got.items())


def test_unique_values(sales):
    listed = cells(pivot.pivot_long(sales, ["cat"], [], "list_unique", "qty"), ["cat"])
    long = pivot.unique_values(sales, ["cat"], [], "qty").collect()
    assert sorted((r["cat"] or "", r["value"]) for r in long) == sorted((k[0] or "", v) for k, vs in listed.items() for v in vs)


def test_rows_only(sales):
    got = cells(pivot.pivot_table(sales, ["cat"], [], "count"), ["cat"])
    assert got[("Totals",)] == 400 and len(got) == 4


def test_unknown_aggregator(sales):
    with pytest.raises(ValueError, match="unknown aggregator"):
        pivot.pivot_long(sales, ["cat"], [], "magic", "net")
    with pytest.raises(ValueError, match="order"):
        pivot.pivot_long(sales, ["cat"], [], "first", "net")


def test_names_are_listed():
    assert "median" in pivot.AGGREGATORS and len(pivot.AGGREGATORS) == 19
