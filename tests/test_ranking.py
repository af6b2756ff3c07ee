import random

import pytest
from pyspark.sql import Window, functions as F

from martwright.operators import ranking
from martwright.operators.ranking import By, global_ntile, global_row_number, order_statistics, rank_by, tile_ends


@pytest.fixture(autouse=True)
def small_samples(monkeypatch):
    monkeypatch.setattr(ranking, "LEAST_SAMPLED", 20)


def frame(spark, rows, ties=5, nulls=True, seed=1):
    pick = random.Random(seed)
    data = [(i, None if nulls and pick.random() < 0.1 else pick.randrange(ties), pick.choice("abcdef") * 3) for i in range(rows)]
    pick.shuffle(data)
    return spark.createDataFrame(data, "id long, amount long, name string").repartition(3)


def naive(df, order, expression):
    return {r.id: r.n for r in df.select("id", expression.over(Window.orderBy(*order)).alias("n")).collect()}


@pytest.mark.parametrize("keys", [["id"], ["amount", "id"], [By("amount", True), "id"], ["name", By("id", True)]])
@pytest.mark.parametrize("rows", [1, 7, 500])
def test_row_number(spark, rows, keys):
    df = frame(spark, rows)
    order = [k.order() if isinstance(k, By) else By(k).order() for k in keys]
    got = {r.id: r.n for r in global_row_number(df, keys, "n").collect()}
    assert got == naive(df, order, F.row_number())


def test_row_number_with_several_ranges(spark):
    """Without merged partitions the numbers span all ranges, a hot key included."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, 4000, ties=2)
        numbered = global_row_number(df, ["amount", "id"], "n")
        got = {r.id: r.n for r in numbered.collect()}
        assert got == naive(df, [By("amount").order(), By("id").order()], F.row_number())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_number_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, amount long")
    assert global_row_number(empty, ["id"], "n").collect() == []


def test_numbers_stay_the_same(spark):
    numbered = global_row_number(frame(spark, 300), [By("amount", True), "id"], "n")
    assert sorted(map(tuple, numbered.collect()), key=repr) == sorted(map(tuple, numbered.collect()), key=repr)


@pytest.mark.parametrize("rows", [1, 3, 12, 300])
@pytest.mark.parametrize("limits", [{}, {"direct_rows": 20, "sample_rows": 40}])
@pytest.mark.parametrize("descending", [False, True])
def test_ntile(spark, rows, limits, descending):
    df = frame(spark, rows, ties=3)
    keys = [By("amount", descending), By("id")]
    got = {r.id: r.n for r in global_ntile(df, 5, keys, "n", **limits).collect()}
    assert got == naive(df, [k.order() for k in keys], F.ntile(5))


def test_order_statistics(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"))
    found = order_statistics(df, ["id"], [1, 500, 1000, 2000], direct_rows=10, sample_rows=80)
    assert found == {1: (0,), 500: (499,), 1000: (999,)}


def test_keys_must_tell_rows_apart(spark):
    same = spark.range(500).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError, match="unique"):
        order_statistics(same, ["id"], [250], direct_rows=10, sample_rows=40)


def test_tile_ends():
    assert tile_ends(12, 5) == [3, 6, 8, 10]
    assert tile_ends(3, 5) == [1, 2]


def test_no_single_partition(spark, plan):
    df = frame(spark, 200)
    numbered = global_row_number(df, ["amount", "id"], "n")
    tiled = global_ntile(df, 5, ["amount", "id"], "n")
    assert "SinglePartition" not in plan(numbered) and "Window" not in plan(numbered)
    assert "SinglePartition" not in plan(tiled) and "Window" not in plan(tiled)


def test_rank_by(spark):
    df = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "k string, v int")
    assert {r.k: r.r for r in rank_by(df, "v", "r").collect()} == {"a": 1, "b": 1, "c": 3}


def test_rows_sent_to_the_driver_stay_bounded(spark, monkeypatch):
    table = spark.range(400_000).selectExpr("xxhash64(id) % 1000 as v", "id")
    sent = []
    collect = type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda frame: sent.append(rows := collect(frame)) or rows)
    found = ranking.order_statistics(table, ["v", "id"], list(range(4000, 400_000, 4000)), direct_rows=5000, sample_rows=20_000)
    monkeypatch.undo()
    assert sum(map(len, sent)) < 80_000
    ordered = table.orderBy("v", "id").collect()
    assert all(found[r] == tuple(ordered[r - 1]) for r in found) and len(found) == 99


@pytest.mark.parametrize("descending", [False, True])
def test_large_tables_are_cut_down_between_rounds(spark, monkeypatch, descending):
    """Brackets come from a sample that Spark sorts, later rounds read what is left, and few keys reach the driver."""
    written, sent = [], []
    store = ranking.write_stable
    monkeypatch.setattr(ranking, "write_stable", lambda df, label, *a: written.append((label, kept := store(df, label, *a))) or kept)
    table = spark.range(60_000).selectExpr("if(id % 9 = 0, null, xxhash64(id) % 50) as v", "md5(cast(id as string)) as id")
    collect = type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda frame: sent.append(rows := collect(frame)) or rows)
    keys = [By("v", descending), "id"]
    found = order_statistics(table, keys, [20_000, 40_000], direct_rows=100, sample_rows=300, spread_rows=10_000, least_cut=1000)
    monkeypatch.undo()
    ordered = table.orderBy(By("v", descending).order(), "id").collect()
    assert found == {r: tuple(ordered[r - 1]) for r in (20_000, 40_000)}
    cuts = [df.count() for label, df in written if label == "bracketed"]
    assert cuts and cuts == sorted(cuts, reverse=True) and cuts[0] <= 30_000
    assert sum(map(len, sent)) < 3000
