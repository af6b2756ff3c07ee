"""Fingerprints and groups against plain loops."""

import random
import re

import numpy as np
import xxhash

from martwright.llm import simhash

COLUMNS = "doc_id long, text string"


def plain(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, bits=3):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


TEXTS = ["", None, "One", "one two", "A b C d", "a b c d", "É é\x0bx\ty z", "  a b c", "x " * 3000, " lead and trail "]


def test_fingerprints():
    assert all(simhash.simhash(t) == plain(t) for t in TEXTS)


def test_long_text_in_pieces(monkeypatch):
    words = " ".join(str(random.Random(i).random()) for i in range(3000))
    whole = simhash.simhash(words)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.simhash(words) == whole == plain(words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(200)) for _ in range(60)]
    texts = TEXTS + base + [b + " tail" for b in base[:40]] + [b.replace("a1 ", "a2 ", 1) for b in base] + base[:5] * 3
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], COLUMNS + ", bits int, rep string").repartition(3)
    found = {r["doc_id"]: r for r in simhash.simhash_groups(frame, leaf_rows=16).collect()}
    prints = {i: plain(t) for i, t in docs}
    want = roots(prints)
    assert {i: int(r["fingerprint"], 16) for i, r in found.items()} == prints
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i for i, r in found.items() if r["kept"]} == {i for i, w in want.items() if i == w}


def test_crowd_of_near_fingerprints(spark):
    rng = np.random.default_rng(0)
    bits = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64), rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    prints = {i: int(b) for i, b in enumerate(bits)}
    frame = spark.createDataFrame([(int(np.uint64(b).view(np.int64)), i) for i, b in prints.items()], "bits long, rep long")
    edges = simhash.link(frame, leaf_rows=20)
    found = {i: i for i in prints} | {r["vertex"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == roots(prints)


def test_routes_meet():
    """Every pair within the distance shares a leaf of the tree."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2**64, 500, dtype=np.uint64)
    bits = np.concatenate([bits, bits ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ np.uint64(5)])
    tree = simhash.grow(bits, 1000, 40, 3)
    leaves = [set() for _ in bits]
    for leaf, rows in simhash.route(bits, tree, 3):
        for row in rows:
            leaves[row].add(leaf)
    assert all(leaves[i] & leaves[i + 500] for i in range(500)) and len(set().union(*leaves)) > 5


def test_odd_rows(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], COLUMNS)).count() == 0
    found = simhash.simhash_groups(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "alone here now")], COLUMNS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_keep_first(spark):
    frame = spark.createDataFrame([(5, "a b c", 1), (2, "a b c", 2), (2, "a b c", 3), (None, "a b c", 4), (None, "other text entirely", 5)], COLUMNS + ", _row int")
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2]
