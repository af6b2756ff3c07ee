"""Source mixing against its statement and by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from martwright.llm import mixing

COLUMNS = "doc_id long, text string, source string"


def rows_of(spark, docs):
    frame = spark.createDataFrame(docs, COLUMNS)
    return {(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["repetitions"]) for r in mixing.mix_digest(frame).collect()}


def expected(docs):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if docs:
        duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    return {(a, b, c, round(d, 6), e, f) for a, b, c, d, e, f in duck.execute(mixing.oracle()).fetchall()}


def corpus():
    docs = [(i, "w " * (i % 13 + 1), "hot") for i in range(400)]
    docs += [(1000 + i, "x\ty\n" * (i + 1), f"s{i % 5}") for i in range(40)]
    return docs + [(2000, None, "s1"), (2001, "", None), (2002, "one", None), (None, "no id", "s2"), (7, "w w", "hot"), (7, "w w", "hot"), (3000, "long " * 30000, "z")]


def test_equals_statement(spark):
    assert rows_of(spark, corpus()) == expected(corpus())


def test_targets_and_caps(spark):
    sized = mixing.sizes(spark.createDataFrame(corpus(), COLUMNS))
    goals = mixing.targets(sized).collect()
    total = sized.agg(F.sum("size")).first()[0]
    assert sum(g["target"] for g in goals) == pytest.approx(total)
    assert all(g["target"] <= 3 * g["source_size"] for g in goals)
    free = [g for g in goals if g["target"] < 3 * g["source_size"]]
    weights = {g["source"]: w for g, w in zip(sorted(goals, key=lambda g: (g["source"] is None, g["source"] or "")), [5, 2, 1] * 9)}
    assert len({round(g["target"] / weights[g["source"]], 6) for g in free}) == 1


def test_taken_words_come_near_the_target(spark):
    docs = [(i, "w " * (i % 50 + 1), f"s{i % 4}") for i in range(2000)]
    taken = mixing.mix_digest(spark.createDataFrame(docs, COLUMNS).withColumn("size", F.lit("clash")))
    by = taken.join(spark.createDataFrame(docs, COLUMNS).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 50 for r in by.collect())


def test_mixed_corpus_repeats_rows(spark):
    frame = spark.createDataFrame(corpus(), COLUMNS).withColumn("size", F.lit("clash")).withColumn("key", F.lit(1))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    words = mixed.select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert words == mixing.mix_digest(frame).agg(F.sum("taken")).first()[0]


def test_empty_tables(spark):
    assert rows_of(spark, []) == set()
    assert mixing.mix(spark.createDataFrame([], COLUMNS)).count() == 0
    assert rows_of(spark, [(1, None, "a"), (2, " ", "b")]) == expected([(1, None, "a"), (2, " ", "b")])


def test_no_document_is_taken_more_often_than_allowed(spark):
    """A source at its cap has no rest, so wordless documents get no repetition more."""
    docs = [(i, "" if i % 2 else None, "small") for i in range(28)] + [(100, "one two", "small")] + [(1000 + i, "w " * 50, "large") for i in range(30)]
    docs += [(2000 + i, None, "empty") for i in range(3)]
    assert rows_of(spark, docs) == expected(docs)
    by_id = {r["doc_id"]: r["repetitions"] for r in mixing.mix_digest(spark.createDataFrame(docs, COLUMNS)).collect()}
    assert max(by_id.values()) == 3 and by_id[100] == 3 and by_id[2000] == 1
    mixed = mixing.mix(spark.createDataFrame(docs, COLUMNS)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {i: n for i, n in by_id.items() if n}


def test_other_columns_may_have_any_name(spark):
    frame = spark.createDataFrame(corpus(), COLUMNS)
    names = ["_source", "_plan", "_copies", "_copy", "__COPY", "whole", "cut", "a.b"]
    for name in names:
        frame = frame.withColumn(name, F.lit("mine"))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.where("_source <> 'mine' or _plan <> 'mine' or `a.b` <> 'mine'").count() == 0
    assert mixed.count() == mixing.mix(spark.createDataFrame(corpus(), COLUMNS)).count()
