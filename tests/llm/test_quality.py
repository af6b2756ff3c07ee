"""Quality from positives and unlabelled texts: held-out accuracy, the risk itself, odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import quality

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def prose(pick):
    words = ["".join(pick.choices("abcdefghijklmnop", k=pick.randrange(2, 9))) for _ in range(60)]
    return " ".join(pick.choice(words) + pick.choice(["", "", "", ",", ".\n"]) for _ in range(pick.randrange(40, 300)))


def junk(pick):
    kind, text = pick.randrange(3), prose(pick)
    return [" ".join(w + "###" for w in text.split()), text.upper().replace(" ", "!! "), "again " * pick.randrange(50, 300)][kind]


def corpus(rows=1500, share=0.7, seed=1):
    pick = random.Random(seed)
    good = [pick.random() < share for _ in range(rows)]
    docs = [(i, prose(pick) if good[i] else junk(pick), "en") for i in range(rows)]
    marks = [(i, int(good[i]), 0) for i in range(rows) if pick.random() < 0.5]
    return docs, marks, good


def test_held_out_accuracy(spark):
    docs, marks, good = corpus()
    rows = quality.quality(spark.createDataFrame(docs, DOCS), spark.createDataFrame(marks, LABELS)).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r["predicted"] == good[r["doc_id"]] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if good[r["doc_id"]]]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_labels_of_held_out_rows_and_bad_marks_change_nothing(spark):
    docs, marks, _ = corpus(400)
    frame = spark.createDataFrame(docs, DOCS)
    base = sorted(map(tuple, quality.quality(frame, spark.createDataFrame(marks, LABELS)).collect()))
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, 1) for i, q, _ in marks if q or zlib.crc32(str(i).encode()) % 3 == 1]
    other = frame.withColumns({"lang": F.lit("zz"), "form": F.lit("mine"), "score": F.lit(2), "quality": F.lit(0)})
    assert sorted(map(tuple, quality.quality(other, spark.createDataFrame(turned, LABELS)).collect())) == base


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior(prior):
    pick = np.random.default_rng(7)
    positive = pick.normal(2, 1, (3000, 2))
    real = pick.random(6000) < prior
    unlabelled = np.where(real[:, None], pick.normal(2, 1, (6000, 2)), pick.normal(-3, 1, (6000, 2)))
    model = quality.learn(positive, unlabelled)
    assert model.prior == pytest.approx(prior, abs=0.06)
    assert np.mean((model.score(unlabelled) >= 0.5) == real) > 0.97


def test_slope_is_that_of_the_risk():
    pick = np.random.default_rng(2)
    positives, rows, prior = 5, 17, 0.4
    slopes = quality.non_negative(positives, rows, prior)

    def parts(margin):
        up, down = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return prior * up[:positives].mean(), down[positives:].mean() - prior * down[:positives].mean()

    for margin in (pick.normal(0, 1, rows), np.concatenate([np.full(5, 6.0), np.full(12, -4.0)])):
        of_positives, of_negatives = parts(margin)
        got, step = slopes(margin), 1e-6
        for row in range(rows):
            moved = margin.copy()
            moved[row] += step
            p, n = parts(moved)
            want = (p - of_positives + n - of_negatives) / step if of_negatives >= -quality.TOLERANCE else -(n - of_negatives) / step
            assert got[row] == pytest.approx(want, abs=1e-5)
    assert parts(margin)[1] < -quality.TOLERANCE


def test_statistics_of_a_long_text_do_not_hang_on_chunks(monkeypatch):
    text = "Again again 漢字 x " * 500 + "\n" + "y" * 3000 + " tail."
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "CHUNK", 10)
    assert quality.statistics(text) == pytest.approx(whole)
    named = dict(zip(quality.STATISTICS, whole))
    assert len(whole) == len(quality.STATISTICS) and named["commonest"] == pytest.approx(500 / 2002)
    assert quality.statistics("") == [0.0] * len(whole)


def test_odd_rows(spark):
    docs, marks, _ = corpus(150)
    odd = [(900, None, None), (901, "", "en"), (902, " \n ", "en"), (None, "no id", None), (903, "\x00\x01 漢", "x"), (5, docs[5][1], "en"), (904, "long " * 100_000, "en")]
    frame = spark.createDataFrame(docs + odd, DOCS)
    rows = quality.quality(frame, spark.createDataFrame(marks + [(None, 1, 0), (5, None, None), (5, 1, 0)], LABELS)).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (900, 901)}) == 1
    # Nothing to learn from.
    rows = quality.quality(frame, spark.createDataFrame([], LABELS)).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}
    assert quality.quality(spark.createDataFrame([], DOCS), spark.createDataFrame(marks, LABELS)).collect() == []
