"""Filter audit against its statement and against following every document by hand."""

from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import filter_audit

COLUMNS = "doc_id long, text string, lang string"
MARKS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(120))


def corpus():
    texts = [LONG, "short text", "same same " * 80, "SHOUT " * 90, f"{LONG} #", None, "", LONG.upper(), "a\x0bb\x1cc" * 70, "é" * 9 + "Z"]
    docs = [(i, texts[i % len(texts)], ["en", "de", None, ""][i % 4]) for i in range(60)]
    docs += [(100 + i, LONG, "hot") for i in range(40)]
    return docs + [(None, LONG, "en"), (None, "alone", "en"), (7, "x #", "fr"), (7, "x #", "fr"), (200, "w " * 30000, "fr")]


def labels():
    return [(i, i % 3 and 1, int(i % 5 == 0)) for i in range(0, 140, 2)] + [(4, None, None), (7, 1, 1), (None, 1, 1)]


def rows_of(spark, docs, marks):
    found = filter_audit.filter_audit(spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(marks, MARKS))
    return sorted(tuple(r) for r in found.collect())


def test_equals_statement(spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", corpus())
    duck.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels())
    assert rows_of(spark, corpus(), labels()) == sorted(duck.execute(filter_audit.oracle()).fetchall())


def test_contraction_equals_following_every_document():
    pick = np.random.default_rng(3)
    counts, good, toxic = (pick.integers(0, 50, (2,) * 4) for _ in range(3))
    found = filter_audit.audit_tensor(counts, good, toxic, "WXYZ").set_index(["filter_order", "step"])
    removed_by = dict.fromkeys("WXYZ", 0)
    for order in permutations(range(4)):
        left = {cell: counts[cell] for cell in np.ndindex(counts.shape)}
        for step, axis in enumerate(order, 1):
            gone = {cell: n for cell, n in left.items() if cell[axis]}
            left = {cell: n for cell, n in left.items() if not cell[axis]}
            row = found.loc["".join("WXYZ"[i] for i in order), step]
            assert (row.removed, row.kept) == (sum(gone.values()), sum(left.values()))
            assert row.good_lost == sum(good[c] for c in gone) and row.toxic_lost == sum(toxic[c] for c in gone)
            assert row.redundant == counts.take(1, axis).sum() - row.removed
            assert row.unique_fails == counts[tuple(int(i == axis) for i in range(4))]
            removed_by["WXYZ"[axis]] += row.removed
    assert all(removed_by[r.letter] == r.shapley for r in found.itertuples())


def test_counts_beyond_a_float():
    counts = np.full((2, 2), 2**60 + 1)
    found = filter_audit.audit_tensor(counts, counts, counts, "XY")
    assert set(found["removed"]) == {2 * (2**60 + 1), 2**60 + 1}


def test_empty_tables_and_clashing_columns(spark):
    assert rows_of(spark, [], labels()) == []
    plain = rows_of(spark, corpus(), [])
    docs = spark.createDataFrame(corpus(), COLUMNS)
    for name in ("digest", "bits", "failed", "good", "toxic", "is_first", "part", "n"):
        docs = docs.withColumn(name, F.lit("mine"))
    again = filter_audit.filter_audit(docs, spark.createDataFrame([], MARKS).withColumn("text", F.lit("other")))
    assert sorted(tuple(r) for r in again.collect()) == plain
    assert sum(r[7] + r[8] for r in plain) == 0 and len(plain) == 600 * 5


@pytest.mark.parametrize("text", ["É" * 30 + "A" * 4, "\x1f", "a b"])
def test_words_and_capitals_by_ascii(spark, text):
    docs = [(1, text, "en")]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    duck.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    assert rows_of(spark, docs, []) == sorted(duck.execute(filter_audit.oracle()).fetchall())
