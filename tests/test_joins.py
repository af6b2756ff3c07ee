import pytest
from pyspark.sql import functions as F

from martwright.operators import joins


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key; some keys have no partner, some are null."""
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("key")
    )
    partners = spark.range(650).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("value"))
    return rows, partners.unionByName(spark.createDataFrame([("hot", -1)], "key string, value long"))


def as_set(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_hot_values(skewed):
    rows, _ = skewed
    assert joins.hot_values(rows, ["key", "id"], sample=1) == {"key": ["hot"], "id": []}
    assert joins.hot_values(rows.limit(50), ["key"], sample=1) == {"key": []}
    empty = rows.select(F.when(F.col("id") > 5000, F.col("id")).alias("id"))
    assert joins.hot_values(empty, ["id"], sample=1) == {"id": [None]}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("shuffled", [False, True])
def test_skew_join_is_the_plain_join(skewed, how, shuffled):
    rows, partners = skewed
    wanted = as_set(rows.join(partners, "key", how))
    for hot in (["hot"], ["hot", None], [None]):
        salted = joins.skew_join(rows, partners, "key", hot, ["id"], how, shuffled=shuffled)
        assert as_set(salted) == wanted


def test_skew_join_spreads_the_hot_key(spark, skewed):
    rows, partners = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.skew_join(rows, partners, "key", ["hot"], ["id"], shuffled=True)
        parts = joined.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 1500
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_left_join_spreads_rows_without_a_key(spark, skewed):
    _, partners = skewed
    rows = spark.range(8000).select("id", F.lit(None).cast("string").alias("key"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.skew_join(rows, partners, "key", [None], ["id"], "left", shuffled=True)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and sum(r["count"] for r in parts) == 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_skew_join_rejects_outer(skewed):
    rows, partners = skewed
    with pytest.raises(ValueError):
        joins.skew_join(rows, partners, "key", ["hot"], ["id"], "full")


def test_orphans(spark):
    parents = spark.createDataFrame([("a",), ("b",)], "key string")
    children = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "key string")
    assert joins.orphans(children, parents, "key", name="lost").first()["lost"] == 3
    assert joins.orphans(parents, parents, "key").first()["orphans"] == 0


def test_insert_missing(spark):
    existing = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([("new", 1), ("new", 2)], "v string, id int")
    assert as_set(joins.insert_missing(existing, new, "id")) == [(1, "old"), (2, "new")]
    again = joins.insert_missing(joins.insert_missing(existing, new, "id"), new, "id")
    assert again.count() == 2
