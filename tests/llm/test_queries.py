"""Registered queries of the subpackage and the pipeline."""

import collections
import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, differences
from martwright.llm import mixing, pieces, pii, queries
from tests.conftest import SMALL
from tests.llm.test_pii import redacted

STATEMENTS = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_equal(spark, name):
    assert differences(spark, connect(SMALL), SMALL, queries.queries()[name], STATEMENTS[name]) is None


def test_registered():
    import __spark_entry__

    named = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in named) for i in range(1, 14)] == [1] * 13 and "pipeline" in named


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(900, None, "en", "s", None), (901, "123 !?", "en", None, 6), (902, "mail a@b.co the of and thet", None, "s", 27), (None, "the of and thet ontion", "en", "src0", 22)]
    now = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept.append(now)
    named, alone, clean, mixed = kept
    assert named.count() == docs.count() + 2
    assert alone.count() == alone.select("doc_id").distinct().count() <= named.count()
    assert clean.where("text like '%a@b.co%'").count() == 0 and clean.where("text like 'mail <EMAIL> the%'").count() == 1
    assert clean.count() == alone.count()
    words = mixed.select(F.sum(mixing.words(F.col("text")))).first()[0]
    assert words == mixing.mix_digest(clean).agg(F.sum("taken")).first()[0]
    encoded = corpus_pipeline.STAGES[-1][1](spark, mixed, SMALL)
    assert encoded.where("sample = 1").count() == mixed.count()


def test_language_stage_without_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(900, None, None, "s", None), (901, "123 !?", None, "s", 6), (902, "", None, "s", 0), (903, "\u00e9 1", None, "s", 3)]
    blank = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame(odd, docs.schema))
    # Labels only on rows that are held out teach nothing either.
    held = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.col("lang"))).unionByName(spark.createDataFrame(odd, docs.schema))
    for table in (blank, held):
        kept = corpus_pipeline.identify_language(spark, table, SMALL)
        want = [r["doc_id"] for r in table.collect() if r["text"] and any(c.isalpha() for c in r["text"])]
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and 903 in want and len(want) > 190


def _simhash_kept(docs):
    """One document of every group, by all pairs of fingerprints: the smallest doc_id."""
    prints = {}
    for doc, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        prints[doc] = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    root = {doc: doc for doc in prints}

    def top(doc):
        while root[doc] != doc:
            doc = root[doc]
        return doc

    for x, y in itertools.combinations(sorted(prints), 2):
        if (prints[x] ^ prints[y]).bit_count() <= 3:
            low, high = sorted((top(x), top(y)))
            root[high] = low
    return {doc for doc in root if root[doc] == doc}


def test_run_against_the_stages_by_hand(spark):
    """The pipeline's rows from plain Python and DuckDB; only the classifier's spans come from the operator itself."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    named = {r["doc_id"]: r["text"] for r in rows if r["text"] and any(c.isalpha() for c in r["text"])}
    alone = {doc: named[doc] for doc in _simhash_kept(named)}
    found = pii.find(spark.createDataFrame(list(alone.items()), "doc_id long, text string")).collect()
    clean = {r["doc_id"]: redacted(alone[r["doc_id"]], r["spans"]) for r in found}
    assert clean != alone and len(alone) < len(named)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    source = {r["doc_id"]: r["source"] for r in rows}
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(doc, text, source[doc]) for doc, text in clean.items()])
    copies = {doc: n for doc, n in duck.execute(f"SELECT doc_id, repetitions FROM ({mixing.oracle()})").fetchall()}
    want = collections.Counter({(doc, sample, text): copies[doc] for doc, text in clean.items() for sample in (1, 2) if copies[doc]})
    trie = pieces.Trie(pieces.load())
    got, drawn = collections.Counter(), {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r["doc_id"], r["sample"], trie.text(np.array(r["ids"]))[1:].decode()] += 1
        drawn.setdefault(r["doc_id"], set()).add(tuple(r["ids"]))
    # A text of one segmentation has no second sample.
    single = {doc for doc, ids in drawn.items() if len(ids) == 1}
    assert got == collections.Counter({k: n for k, n in want.items() if k[1] == 1 or k[0] not in single})
    assert all(len(clean[doc]) < 3 for doc in single)
