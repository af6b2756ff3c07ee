"""How filters of a corpus act on each other, for every order of applying them.

Documents become counts per part and vector of failed filters. Reshaped to a tensor
with one axis of two places (pass, fail) per filter, every figure of every step of
every order is one contraction: each axis is read at pass, at fail, or summed over both.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from martwright.llm.common import SPACES, WORD, stored

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text alone."""
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, failed (a bit per filter, A lowest), good, toxic.

    Filter E fails a document whose text some smaller doc_id has. The smallest doc_id
    of a text is found by an aggregate that combines before its shuffle, and handed
    back by doc_id and digest, so a group of copies never meets in one task. Texts are
    told apart by their SHA-256.
    """
    text = F.coalesce("text", F.lit(""))
    bits = reduce(Column.__add__, [failed.cast("int") * (1 << i) for i, failed in enumerate(text_filters(text).values())])
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    facts = stored(docs.select("doc_id", part, bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest")), "filters")
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = facts.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return joined.select(
        "part", (F.col("bits") + copied.cast("int") * 16).alias("failed"),
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def _contract(counts: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """Sums of a tensor for every row of ``selectors`` (rows x axes x 2)."""
    axes = counts.ndim
    operands = [selectors[:, axis, :] for axis in range(axes)]
    axis_names = "abcdefghijklmnopqr"[:axes]
    return np.einsum(f"{axis_names},{','.join('z' + a for a in axis_names)}->z", counts, *operands)


def audit_tensor(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray, names: str) -> pd.DataFrame:
    """All orders and steps of one part from its tensors of counts."""
    orders = list(permutations(range(len(names))))
    steps = [(order, step) for order in orders for step in range(len(order))]

    def selectors(choose) -> np.ndarray:
        return np.array([[choose(order.index(axis), step) for axis in range(len(names))] for order, step in steps], dtype=np.int64)

    removed = selectors(lambda place, step: PASS if place < step else FAIL if place == step else ALL)
    figures = {
        "kept": _contract(counts, selectors(lambda place, step: PASS if place <= step else ALL)),
        "removed": _contract(counts, removed),
        "failing": _contract(counts, selectors(lambda place, step: FAIL if place == step else ALL)),
        "unique_fails": _contract(counts, selectors(lambda place, step: FAIL if place == step else PASS)),
        "good_lost": _contract(good, removed),
        "toxic_lost": _contract(toxic, removed),
    }
    figures["redundant"] = figures["failing"] - figures["removed"]
    table = pd.DataFrame(figures)
    table["letter"] = [names[order[step]] for order, step in steps]
    table["filter_order"] = ["".join(names[i] for i in order) for order, _ in steps]
    table["step"] = np.array([step + 1 for _, step in steps], dtype=np.int32)
    table["shapley"] = table.groupby("letter")["removed"].transform("sum")
    return table


def audit(marked: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Figures per part, order and step from rows of part, failed, good, toxic.

    The rows are counted first, at most 4 x 2^filters per part; a task contracts whole
    parts only. Returns part, filter_order, step and the columns of ``COUNTS``.
    """
    cells = marked.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))

    def contract(part: pd.DataFrame) -> pd.DataFrame:
        def tensor(rows: pd.DataFrame) -> np.ndarray:
            flat = np.zeros(1 << len(names), dtype=np.int64)
            np.add.at(flat, rows["failed"].to_numpy(), rows["n"].to_numpy())
            # The first axis is the highest bit; filters are counted from the lowest.
            return flat.reshape((2,) * len(names)).transpose()

        found = audit_tensor(tensor(part), tensor(part[part["good"] == 1]), tensor(part[part["toxic"] == 1]), names)
        return found.assign(part=part["part"].iloc[0])[["part", "filter_order", "step", *COUNTS]]

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return cells.groupBy("part").applyInPandas(contract, schema)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interaction of the five filters A to E per language, for all 120 orders.

    A null text is empty: it fails A and, beside other empty texts of a smaller doc_id,
    E. A null lang is the part ''. Rows with the same doc_id are no copies of each
    other, and a null doc_id comes after none, so it passes E. A doc_id with several
    labels is good or toxic if one of them says so. An empty table has no parts and
    gives no rows; further columns are not looked at.
    """
    return audit(flagged(docs, labels))


def oracle() -> str:
    """DuckDB statement for ``filter_audit``: follows every document through every order."""
    letters = "ABCDE"
    fails = ", ".join(f"('{c}', fail_{c})" for c in letters)
    return f"""
    WITH words AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
               regexp_extract_all(coalesce(text, ''), '{WORD}') AS list FROM documents),
    flags AS (
        SELECT doc_id, part,
               CAST(len(list) < 100 AS INT) AS fail_A,
               CAST(100 * len(list_distinct(list)) < 80 * len(list) AS INT) AS fail_B,
               CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS INT) AS fail_C,
               CAST(regexp_matches(body, '{SYMBOLS}') AS INT) AS fail_D,
               CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), FALSE) AS INT) AS fail_E
        FROM words),
    marks AS (
        SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic
        FROM labels GROUP BY doc_id),
    cells AS (
        SELECT part, fail_A, fail_B, fail_C, fail_D, fail_E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
        FROM flags LEFT JOIN marks USING (doc_id) GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    failed AS (
        SELECT cells.*, fails.f, fails.fail, fail_A + fail_B + fail_C + fail_D + fail_E AS all_fails
        FROM cells, LATERAL (VALUES {fails}) AS fails(f, fail)),
    ends AS (
        SELECT part, filter_order, good, toxic, fail_A, fail_B, fail_C, fail_D, fail_E,
               min(CASE WHEN fail = 1 THEN strpos(filter_order, f) END) AS ends_at
        FROM failed, orders GROUP BY ALL),
    steps AS (
        SELECT part, filter_order, strpos(filter_order, f) AS step, f, n, fail, all_fails, good, toxic, ends_at
        FROM failed JOIN ends USING (part, good, toxic, fail_A, fail_B, fail_C, fail_D, fail_E)),
    figures AS (
        SELECT part, filter_order, CAST(step AS INT) AS step, any_value(f) AS f,
               coalesce(sum(n) FILTER (ends_at IS NULL OR ends_at > step), 0) AS kept,
               coalesce(sum(n) FILTER (ends_at = step), 0) AS removed,
               coalesce(sum(n) FILTER (fail = 1 AND ends_at < step), 0) AS redundant,
               coalesce(sum(n) FILTER (fail = 1 AND all_fails = 1), 0) AS unique_fails,
               coalesce(sum(n) FILTER (ends_at = step AND good = 1), 0) AS good_lost,
               coalesce(sum(n) FILTER (ends_at = step AND toxic = 1), 0) AS toxic_lost
        FROM steps GROUP BY part, filter_order, step)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM figures"""
