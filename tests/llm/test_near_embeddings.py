"""Embedding groups against all pairs."""

import numpy as np

from martwright.llm import near_embeddings

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    fine = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    ids = [i for i, _, _ in fine]
    root, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            (i, x, l), (j, y, m) = fine[a], fine[b]
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                p, q = top(i), top(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], top(i), top(i) == i) for i, _, _ in rows}


def vectors(count, seed, crowd=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((count, 16))
    near = base[: count // 2] + rng.standard_normal((count // 2, 16)) * rng.uniform(0, 0.3, (count // 2, 1))
    close = base[0] + rng.standard_normal((crowd, 16)) * 0.05
    return np.concatenate([base, near, close, base[:20], 3 * base[5:10]]).astype(np.float32)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS rep", "'x' AS vector", "2 AS cell").repartition(3)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings.embedding_groups(frame, **options).collect()}


def test_equals_all_pairs(spark):
    data = vectors(150, 0, crowd=60)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(data)]
    rows += [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [1.0, None] + [1.0] * 14, 0), (5003, [float("nan")] * 16, 0), (5004, data[0].tolist(), None), (5005, [1.0, 2.0], 0), (5006, [2.0, 4.0], 0), (5007, [float("inf")] * 16, 0)]
    assert run(spark, rows) == brute(rows)
    # Many cells and block pairs give the same.
    assert run(spark, rows, cell_rows=24) == brute(rows)


def test_calibrated_count():
    assert 15 <= near_embeddings.calibrated_count() < near_embeddings.PROJECTIONS


def test_empty_and_repeated(spark):
    assert run(spark, []) == {}
    frame = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], COLUMNS)
    found = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in near_embeddings.embedding_groups(frame).collect())
    assert found == [(-1, 2, 1), (1, 2, 1), (1, 2, 1)]
