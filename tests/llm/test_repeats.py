"""Repeated strings against all windows."""

import collections
import hashlib

import numpy as np
import pytest

from martwright.llm import repeats

COLUMNS = "doc_id long, text string"


def brute(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def run(spark, texts, length=400):
    frame = spark.createDataFrame(list(enumerate(texts)), COLUMNS).selectExpr("*", "1 AS row", "'x' AS core", "2 AS first").repartition(3)
    found = {r["doc_id"]: r for r in repeats.remove_repeats(frame, length, with_text=True).collect()}
    return [tuple(found[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")) for i in range(len(texts))]


def random_text(rng, size, letters="abcd é"):
    return "".join(rng.choice(list(letters), size))


def corpus():
    rng = np.random.default_rng(1)
    base = random_text(rng, 3000)
    passage = base[500:1300]
    texts = ["a" * 1500, "ab" * 600, base, "x" + base[100:900] + "y" + base[100:520], base[1000:1399], base[1000:1400], None, "", "a" * 399, "é" * 450, base[2500:] + base[:450], base, base]
    texts += [random_text(rng, int(rng.integers(0, 300))) + passage[int(rng.integers(0, 300)) :] + random_text(rng, 200) for _ in range(40)]
    texts += [base[:1000] + str(i) + base[1000:] for i in range(12)] + [random_text(rng, 700) for _ in range(20)]
    return texts


def test_equals_all_windows(spark):
    texts = corpus()
    assert run(spark, texts) == brute([(t or "").encode() for t in texts], 400)


def test_other_length_and_small_chunks(spark, monkeypatch):
    texts = corpus()
    assert run(spark, texts, 150) == brute([(t or "").encode() for t in texts], 150)


def test_full_filter_changes_nothing(spark, monkeypatch):
    full = np.full(1 << (repeats.FILTER_BITS - 3), 255, np.uint8)
    monkeypatch.setattr(repeats, "_filter", lambda places: full)
    texts = corpus()
    assert run(spark, texts) == brute([(t or "").encode() for t in texts], 400)


def test_phrases_cover_every_string():
    rng = np.random.default_rng(2)
    data = random_text(rng, 5000).encode()
    first, last, trigger = repeats.parse(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert ((trigger >= last) | (trigger >= first)).all() and (trigger - first <= 400 - repeats.CORE).all()
    # The same string has its trigger at the same place, whatever is around it.
    before = random_text(rng, 77).encode()
    other = before + data[1000:2000]
    inner = {t - 1000 for f, t in zip(first, trigger) if 1000 <= f and t < 1500}
    assert inner <= {t - len(before) for t in repeats.parse(other)[2]}


def test_chunks_do_not_matter(monkeypatch):
    data = random_text(np.random.default_rng(3), 4000).encode()
    whole = repeats.parse(data)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert set(repeats.parse(data)[2].tolist()) == set(whole[2].tolist())


def test_odd_rows(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], COLUMNS)).count() == 0
    twice = random_text(np.random.default_rng(4), 500)
    found = repeats.remove_repeats(spark.createDataFrame([(None, twice), (None, twice), (1, "short")], COLUMNS)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found)[0] == (5, 0, 0)
    assert all(r["n_removed"] == r["n_bytes"] for r in found if r["doc_id"] is None)
    with pytest.raises(ValueError):
        repeats.remove_repeats(spark.createDataFrame([], COLUMNS), 10)
