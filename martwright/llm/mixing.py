"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the words in proportion to its weight, but gives at
most ``most_epochs`` times what it has. Sources whose share is above that are clamped
and the excess goes to the others by weight, until none is above. A source's target is
then filled with whole repetitions of all its documents and one fractional repetition:
the documents that come first in a seeded order, up to the words that are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from martwright.llm.common import WORD, stored, unused
from martwright.operators.ranking import global_row_number

WEIGHTS = (5, 2, 1)
# The seeded order is an md5 in hex; each refinement looks at this many further digits.
DIGITS, LEVELS = 3, 3


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null"))))


def water_level(sources: DataFrame) -> float | None:
    """Level at which every source gets ``least(level * weight, cap)`` and all words are shared.

    Rises from the unclamped level to the fixed point; a round is one small aggregate.
    """
    over = F.lit(False)
    level, clamped = None, -1
    while True:
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("free"),
            F.sum(over.cast("int")).alias("clamped"),
        ).first()
        if not row["free"] or row["clamped"] == clamped:
            return level
        clamped, level = row["clamped"], float(row["all"] - row["taken"]) / float(row["free"])
        over = F.col("cap") <= F.lit(level) * F.col("weight")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """One row per source: source, source_size, target. Sources by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = global_row_number(sums, ["source"], "place")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    numbered = numbered.withColumn("weight", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")))
    numbered = stored(numbered.withColumn("cap", F.lit(most_epochs) * F.col("source_size")), "sources")
    level = water_level(numbered) or 0.0
    water = F.lit(level) * F.col("weight")
    return numbered.select("source", "source_size", F.least(water, F.col("cap").cast("double")).alias("target"))


def mixture(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """Per source its target, whole repetitions and where the fractional one ends.

    ``sized`` has source, size and key and should be a stored table. The end is found by
    three rounds of counting words per source and key prefix, the later ones only
    inside the prefix where it lies; each prefix is added up before the shuffle, so a
    source with a third of all rows sends 4,096 rows per task at most. Rows with equal
    keys stay together: all or none of them.
    """
    plan = targets(sized, weights, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stored(plan.withColumn("cut", F.lit("")).withColumn("start", F.lit(0).cast("long")).withColumn("held", F.lit(0).cast("long")), "mixture")
    for level in range(1, LEVELS + 1):
        inside = _with(sized, plan.select("source", "rest", "cut", "start"), "source")
        inside = inside.where(F.startswith(F.col("key"), F.col("cut")))
        sums = inside.groupBy("source", "rest", "start", F.substring("key", 1, level * DIGITS).alias("prefix")).agg(F.sum("size").alias("held"))
        order = Window.partitionBy("source").orderBy("prefix")
        ends = sums.withColumn("end", F.col("start") + F.sum("held").over(order))
        edge = ends.where(F.col("end") > F.col("rest")).groupBy("source").agg(F.min(F.struct("prefix", (F.col("end") - F.col("held")).alias("start"), "held")).alias("edge"))
        edge = edge.select("source", F.col("edge.prefix").alias("cut"), F.col("edge.start").alias("start"), F.col("edge.held").alias("held"))
        plan = stored(_with(plan.drop("cut", "start", "held"), edge, "source", "left"), "mixture")
    # An order that ends below the rest has no edge: everything is inside.
    return plan.withColumn("edge_in", F.coalesce(2 * F.col("start") + F.col("held") <= 2 * F.col("rest"), F.lit(True)))


def _with(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join in which null meets null."""
    renamed = right.withColumnRenamed(key, "_key")
    return left.join(renamed, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def repetitions(key: Column | None = None, plan: str = "") -> Column:
    """How often a row with ``key`` is taken under the plan of its source.

    A source without words has nothing to fill a target with: its rows are taken once.
    """
    of = lambda name: F.col(f"{plan}{name}")
    prefix = F.substring(F.col("key") if key is None else key, 1, DIGITS * LEVELS)
    inside = of("cut").isNull() | (prefix < of("cut")) | ((prefix == of("cut")) & of("edge_in"))
    first = F.when(of("source_size") == 0, 1).when(of("rest") <= 0, 0).when(inside, 1).otherwise(0)
    return (of("whole") + first).cast("long")


def sizes(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size and the key of the seeded order."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("key"))


def mix_digest(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, repetitions.

    Null or wordless texts have size 0 and are taken 0 words; a null source is a source
    of its own; rows with equal doc_id get the same decision; an empty table gives no
    rows; further columns of ``docs`` are not looked at.
    """
    sized = stored(sizes(docs, seed), "sized")
    plan = mixture(sized, weights, most_epochs)
    joined = _with(sized, plan, "source").withColumn("repetitions", repetitions())
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, columns unchanged.

    No document is taken more than ``most_epochs`` times. Null and empty texts are taken
    like others of their source, at no cost; a source without any word stays as it is. A
    null source is a source of its own, rows with equal doc_id get the same decision, an
    empty table stays empty, and other columns may have any name.
    """
    source, plan, copy = (unused(docs, name) for name in ("source", "plan", "copy"))
    found = mixture(stored(sizes(docs, seed), "sized"), weights, most_epochs)
    found = found.select(F.col("source").alias(source), F.struct("whole", "rest", "source_size", "cut", "edge_in").alias(plan))
    taken = repetitions(order_key(F.col("doc_id"), seed), f"{plan}.").cast("int")
    joined = docs.join(found, F.col("source").eqNullSafe(F.col(source)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), taken))).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(weights: Sequence[int] = WEIGHTS, most_epochs: int = 3, seed: int = 42) -> str:
    """DuckDB statement for ``mix_digest``."""
    rest = "(target - whole * source_size)"
    fraction = f"CASE WHEN source_size = 0 THEN 1 WHEN {rest} <= 0 THEN 0 WHEN 2 * (upto - own) + own <= 2 * {rest} THEN 1 ELSE 0 END"
    cycle = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
               md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
    sums AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cycle} END AS weight
        FROM sized GROUP BY source),
    levels AS (
        SELECT (CAST((SELECT sum(source_size) FROM sums) AS DOUBLE)
                - coalesce(CAST(sum({most_epochs} * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
               / CAST(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
        FROM sums),
    goals AS (
        SELECT source, source_size, least((SELECT max(level) FROM levels) * weight, CAST({most_epochs} * source_size AS DOUBLE)) AS target FROM sums),
    parts AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
    placed AS (
        SELECT doc_id, source, size,
               sum(size) OVER (PARTITION BY source ORDER BY key) AS upto, sum(size) OVER (PARTITION BY source, key) AS own
        FROM sized)
    SELECT doc_id, size, source_size, target,
           CAST(size * (whole + {fraction}) AS BIGINT) AS taken, CAST(whole + {fraction} AS BIGINT) AS repetitions
    FROM placed JOIN parts ON placed.source IS NOT DISTINCT FROM parts.source"""
