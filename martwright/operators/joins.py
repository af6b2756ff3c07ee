"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it holds this share of the sampled rows, or, where the shuffle is
# wide, this many times what an average task gets.
HOT_SHARE, HOT_TASKS = 0.01, 4
SAMPLE = 0.01
# Below this many sampled rows no key can weigh on a task.
FEWEST_SAMPLED = 1000
TRACKED = 4096
FEWEST_SALTS = 32


def hot_share(df: DataFrame) -> float:
    return min(HOT_SHARE, HOT_TASKS / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_values(df: DataFrame, keys: list[str], share: float | None = None, sample: float = SAMPLE, fewest: int = FEWEST_SAMPLED) -> dict[str, list]:
    """Per key column, the values (null included) that hold a large share of the rows.

    One pass over a row sample with a frequent-items sketch per column: bounded
    state, merged across tasks, at most ``1 / share`` values each. The estimate only
    steers where rows go, a join's result does not depend on it.
    """
    sampled = df.select(*keys) if sample >= 1 else df.select(*keys).sample(sample, seed=23)
    share = share or hot_share(df)
    most = int(1 / share)
    tracked = min(1_000_000, max(TRACKED, 4 * most))
    sketches = [F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias(key) for key in keys]
    row = sampled.agg(F.count("*").alias("_rows"), *sketches).first()
    if row["_rows"] < fewest:
        return {key: [] for key in keys}
    floor = max(2, share * row["_rows"])
    return {key: [i["item"] for i in row[key] if i["count"] >= floor] for key in keys}


def hot_keys(df: DataFrame, key: str) -> list:
    return hot_values(df, [key])[key]


def salt_count(df: DataFrame) -> int:
    """One salt per shuffle partition, so that a hot key can use all of them."""
    return max(FEWEST_SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    hot: list,
    spread: list[str | Column],
    how: str = "inner",
    shuffled: bool = False,
) -> DataFrame:
    """Equi-join in which the rows of hot keys are spread over all shuffle partitions.

    Rows of ``big`` with a hot key get a salt hashed from ``spread`` (columns that
    vary within a key); the matching rows of ``small`` are repeated per salt. All
    other rows carry salt 0. Without hot keys this is the plain join, and Catalyst
    picks broadcast or shuffle from the measured sizes. ``shuffled`` rules out the
    broadcast where both sides grow with the data: the size estimate of a
    compressed file can lie far below what its rows take in memory.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join keeps the rows of the left side only once: {how!r}")
    if shuffled:
        small = small.hint("merge")
    values = [value for value in hot if value is not None]
    # Rows without a key find no partner; only joins that keep them have to spread them.
    empty = None in hot and how in ("left", "left_anti")
    if not values and not empty:
        return big.join(small, on, how)
    is_hot = F.col(on).isin(*values) if values else F.lit(False)
    salts = salt_count(big)
    spread_out = F.coalesce(is_hot, F.lit(empty))
    salt = F.when(spread_out, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    joined = big.withColumn("_salt", salt).join(small.withColumn("_salt", F.explode(copies)), [on, "_salt"], how)
    return joined.drop("_salt")


def orphan_counts(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows.

    The child is reduced to its keys before the shuffle, so a hot key costs one row.
    Null keys are counted as orphans, as an outer join with a null test does.
    """
    keys = child.groupBy(F.col(child_key).alias("key")).agg(F.count("*").alias("rows"))
    parents = parent.select(F.col(parent_key).alias("key"))
    return keys.join(parents, "key", "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None, name: str = "orphans") -> DataFrame:
    """One row: how many child rows have no parent."""
    missing = orphan_counts(child, key, parent, parent_key or key)
    return missing.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias(name))


def missing_rows(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(key), key, "left_anti")


def insert_missing(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` with an unknown key."""
    return existing.unionByName(missing_rows(new, existing, key).select(*existing.columns))
