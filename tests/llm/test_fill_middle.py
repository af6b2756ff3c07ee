"""Fill-in-the-middle against plain string slices, exact round trips and its statement."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from martwright.llm import fill_middle

COLUMNS = "doc_id long, text string"


def by_slices(doc_id, text):
    """The contract with Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((one % (n + 1), two % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if four % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}")


def corpus():
    pick = random.Random(5)
    alphabet = ["a", " ", "é", "ß", "漢", "🙂", "<", ">", "P", "S", "M", "\n", "́", "<P", "S>"]
    docs = [(i, "".join(pick.choices(alphabet, k=pick.randrange(40)))) for i in range(400)]
    docs += [(1000 + i, mark * i + "text") for i, mark in enumerate(("<P>", "<S>", "<M>", "<X>"))]
    return docs + [(None, "no id 漢"), (None, None), (2000, None), (2001, ""), (7, "twice"), (7, "twice"), (3000, "é🙂x" * 400_000), (-5, "negative")]


def test_equals_slices(spark):
    found = fill_middle.fill_in_middle(spark.createDataFrame(corpus(), COLUMNS))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((by_slices(*d) for d in corpus()), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restores_from_output_and_form_alone(spark):
    moved = fill_middle.fill_in_middle(spark.createDataFrame(corpus(), COLUMNS)).select("doc_id", "form", "output")
    back = fill_middle.restore(moved).collect()
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in back) == sorted((i or -1, t or "") for i, t in corpus())


def test_digest_equals_statement(spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", corpus())
    want = sorted(duck.execute(fill_middle.oracle()).fetchall(), key=repr)
    got = fill_middle.fill_in_middle_digest(spark.createDataFrame(corpus(), COLUMNS)).collect()
    assert sorted(map(tuple, got), key=repr) == want


@pytest.mark.parametrize("window", [1, 2, 7, 64])
def test_windows_change_nothing(monkeypatch, window):
    texts = [t or "" for _, t in corpus() if t is None or len(t) < 1000]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    forms = np.array(["plain" if "<P>" in t or "<S>" in t or "<M>" in t else ("psm", "spm", "plain")[i % 3] for i, t in enumerate(texts)], dtype=object)

    def both():
        first = fill_middle.code_points_before(data, offsets)
        n = np.diff(first)
        cuts = fill_middle.byte_positions(data, (first[:-1, None] + np.stack([n // 3, n // 2], axis=1)).ravel()).reshape(-1, 2)
        out = fill_middle.scatter(data, offsets, cuts, forms)
        return n, out, fill_middle.gather(*out, forms)

    n, out, back = both()
    assert n.tolist() == [len(t) for t in texts] and back[0].tobytes() == data.tobytes() and back[1].tolist() == offsets.tolist()
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    _, again, back = both()
    assert again[0].tobytes() == out[0].tobytes() and back[0].tobytes() == data.tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aé漢🙂<>PSM", max_size=12), st.sampled_from(["psm", "spm", "plain"]), st.integers(0, 12), st.integers(0, 12)), max_size=8))
def test_any_cut_can_be_undone(rows):
    texts = [t for t, *_ in rows]
    forms = np.array(["plain" if any(m in t for m in fill_middle.MARKS) else f for t, f, *_ in rows], dtype=object)
    column = pa.array(texts, pa.string())
    data, offsets = fill_middle.texts_of(column)
    first = fill_middle.code_points_before(data, offsets)
    n = np.diff(first)
    wanted = np.sort(np.array([[a, b] for *_, a, b in rows], dtype=np.int64).reshape(-1, 2) % (n + 1)[:, None], axis=1)
    cuts = fill_middle.byte_positions(data, (first[:-1, None] + wanted).ravel()).reshape(-1, 2)
    out = fill_middle.scatter(data, offsets, cuts, forms)
    for text, form, (a, b), made in zip(texts, forms, wanted, fill_middle.strings(*out).to_pylist()):
        p, m, s = text[:a], text[a:b], text[b:]
        assert made == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    assert fill_middle.strings(*fill_middle.gather(*out, forms)).to_pylist() == texts


def test_runs_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(fill_middle, "RUN", 10)
    offsets = np.array([0, 4, 4, 9, 30, 31, 41, 42])
    found = list(fill_middle.runs(offsets))
    assert [i for r in found for i in range(r.start, r.stop)] == list(range(7))
    assert all(offsets[r.stop] - offsets[r.start] <= 10 or r.stop - r.start == 1 for r in found)


def test_an_output_without_its_markers_is_refused():
    data, offsets = fill_middle.texts_of(pa.array(["<P>ab<S>c"]))
    with pytest.raises(ValueError, match="marker"):
        fill_middle.gather(data, offsets, np.array(["psm"], dtype=object))


def test_empty_table_and_clashing_columns(spark):
    assert fill_middle.fill_in_middle_digest(spark.createDataFrame([], COLUMNS)).collect() == []
    docs = spark.createDataFrame(corpus()[:50], COLUMNS)
    plain = fill_middle.fill_in_middle_digest(docs).collect()
    for name in ("n", "form", "output", "one", "restored"):
        docs = docs.withColumn(name, F.lit("mine"))
    assert sorted(map(tuple, fill_middle.fill_in_middle_digest(docs).collect())) == sorted(map(tuple, plain))


def test_no_shuffle(spark, plan):
    assert "Exchange" not in plan(fill_middle.fill_in_middle_digest(spark.createDataFrame(corpus()[:9], COLUMNS)))
