"""Differencing and the laws of the shards."""

import zlib

import numpy as np

from martwright.llm import sharding

COLUMNS = "doc_id long, text string"


def test_difference_keeps_every_sum():
    rng = np.random.default_rng(0)
    tuples = np.zeros((300, 4), np.int64)
    tuples[:, -1] = rng.integers(1, 1000, 300)
    placed = sharding.difference(tuples)
    assert all(sorted(row) == [0, 1, 2, 3] for row in placed.tolist())
    sums = np.bincount(placed[:, -1], weights=tuples[:, -1], minlength=4)
    assert sums.sum() == tuples.sum() and sums.max() - sums.min() <= 2


def test_difference_beats_largest_first():
    sizes = [8, 7, 6, 5, 4]
    tuples = np.zeros((5, 2), np.int64)
    tuples[:, -1] = sizes
    sums = np.bincount(sharding.difference(tuples)[:, -1], weights=sizes)
    assert sorted(sums.tolist()) == [14, 16]


def check(rows, found, shards=16):
    assert sorted(x or -1 for x, _ in rows) == sorted(r["doc_id"] or -1 for r in found)
    by_shard, by_text = {}, {}
    texts = dict(rows)
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r)
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by_shard.values())
    return {s: sum(r["size"] for r in by_shard.get(s, [])) for s in range(shards)}


def corpus():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abé "), rng.integers(1, 400))) for _ in range(800)] + ["copy of many"] * 90 + [None, None, "", ""] + ["long" * 2000]
    return [(i, t) for i, t in enumerate(texts)]


def test_bytes_law(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS shard", "'x' AS grp", "2 AS size").repartition(3)
    sums = check(rows, sharding.shard_documents(frame).collect())
    assert max(sums.values()) - min(sums.values()) <= 4
    # Slices make up for what the large groups leave uneven.
    sums = check(rows, sharding.shard_documents(frame, slice_groups=200, most_large=50).collect())
    assert max(sums.values()) - min(sums.values()) <= 200


def test_group_above_its_share(spark):
    rows = [(i, "x" * 5000) for i in range(20)] + [(100 + i, "y" * i) for i in range(100)]
    sums = check(rows, sharding.shard_documents(spark.createDataFrame(rows, COLUMNS)).collect())
    assert sorted(sums.values())[-1] == 20 * 5001


def test_odd_rows(spark):
    assert sharding.shard_documents(spark.createDataFrame([], COLUMNS)).count() == 0
    found = sharding.shard_documents(spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], COLUMNS)).collect()
    assert len(found) == 3 and len({r["shard"] for r in found}) == 1 and sorted(r["slot"] for r in found) == [0, 1, 2]
