"""Sampled segmentations against an enumeration of all of them."""

import collections
import hashlib
import math
import os

import numpy as np
import pyarrow as pa
import pytest

from martwright.llm import pieces

COLUMNS = "doc_id long, text string"
# Letters, pairs and a few longer pieces; the space is the marker of the module.
WORDS = ["a", "b", "c", "ab", "bc", "abc", "\ud800", "\ud800a", "\ud800ab", "ca", "cab"]
VOCABULARY = pieces.Vocabulary(tuple(WORDS) + (None,) * 256, len(WORDS), 0.6)
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary file here")


def segmentations(lattices, text):
    trie, known = lattices.trie, {p: i for i, p in enumerate(VOCABULARY.pieces) if p}

    def of(unit):
        if not unit:
            return [((), 0.0)]
        out = []
        for size in range(1, len(unit) + 1):
            if unit[:size] in known:
                ids, weight = (known[unit[:size]],), trie.weight[known[unit[:size]]]
            elif size == 1:
                spelled = unit[0].encode()
                ids, weight = tuple(trie.first_byte + b for b in spelled), trie.byte_weight * len(spelled)
            else:
                continue
            out += [(ids + rest, weight + more) for rest, more in of(unit[size:])]
        return out

    all_of = [((), 0.0)]
    for unit in pieces.units_of(text, trie):
        all_of = [(x + y, v + w) for x, v in all_of for y, w in of(unit)]
    total = np.logaddexp.reduce([w for _, w in all_of])
    return {x: w - total for x, w in all_of}


def sampled(lattices, text, rows, samples):
    drawn = pieces.draw(lattices, [(i, pieces.units_of(text, lattices.trie)) for i in range(rows)], samples)
    return [[(tuple(lattices.spell(e).tolist()), p, s, i) for e, p, s, i in own] for own in drawn]


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(VOCABULARY)


def test_samples_are_distinct_and_scored(lattices):
    text = "abcab é cabab"
    known = segmentations(lattices, text)
    for own in sampled(lattices, text, 50, 6):
        ids = [x for x, _, _, _ in own]
        assert len(set(ids)) == 6 and all(abs(p - known[x]) < 1e-9 for x, p, _, _ in own)
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:])) and all(i <= 0 for _, _, _, i in own)
        assert all(pieces.decode(list(x), lattices.trie.bytes) == text for x in ids)


def test_inclusion_as_in_sampling_without_replacement(lattices):
    known = segmentations(lattices, "abcab")
    share = {x: math.exp(p) for x, p in known.items()}
    rows = 20000
    own = sampled(lattices, "abcab", rows, 2)
    first = collections.Counter(o[0][0] for o in own)
    both = collections.Counter(x for o in own for x, _, _, _ in o)
    for x, p in share.items():
        second = sum(q * p / (1 - q) for y, q in share.items() if y != x)
        assert abs(first[x] / rows - p) < 0.015
        assert abs(both[x] / rows - (p + second)) < 0.015
    # Each inclusion score makes its sample count for what it stands for.
    assert np.mean([sum(math.exp(p - i) for _, p, _, i in o) for o in own]) == pytest.approx(1.0, abs=0.01)


def test_all_segmentations_when_asked_for_more(lattices):
    known = segmentations(lattices, "abc")
    own = sampled(lattices, "abc", 3, len(known) + 5)
    assert all({x for x, _, _, _ in o} == set(known) and all(i == 0 for _, _, _, i in o) for o in own)


def test_long_texts_keep_the_order(lattices):
    text = " ".join(["abcab", "cab", "bcabc"] * 700)
    for own in sampled(lattices, text, 3, 4):
        assert len({x for x, _, _, _ in own}) == 4 and all(a[2] >= b[2] for a, b in zip(own, own[1:]))


def test_independent_of_the_batch(lattices, monkeypatch):
    texts = ["abc ab", "", "cabab", "é b", "abcab " * 30]
    rows = [(i, pieces.units_of(t, lattices.trie)) for i, t in enumerate(texts)]
    together = pieces.draw(lattices, rows, 3)
    monkeypatch.setattr(pieces, "KEPT", 1)
    other = pieces.Lattices(VOCABULARY)
    for row, own in zip(rows, together):
        alone = pieces.draw(other, [row], 3)[0]
        assert [p for _, p, _, _ in own] == pytest.approx([p for _, p, _, _ in alone])
        assert [s for _, _, s, _ in own] == pytest.approx([s for _, _, s, _ in alone])


def test_units(lattices):
    trie = lattices.trie
    assert pieces.units_of(None, trie) == pieces.units_of("", trie) == []
    assert pieces.units_of("x" * 1000, trie)[0] == "\ud800" + "x" * 255 and "".join(pieces.units_of("x" * 1000, trie)) == "\ud800" + "x" * 1000


def test_units_are_cut_only_where_no_piece_crosses(lattices, monkeypatch):
    trie = lattices.trie
    monkeypatch.setattr(pieces, "UNIT", 4)
    pick = np.random.default_rng(6)
    known = [p for p in VOCABULARY.pieces if p]
    for reach in (3, 1 << 18):
        monkeypatch.setattr(pieces, "REACH", reach)
        for _ in range(60):
            word = "\ud800" + "".join(pick.choice(list("abcx"), pick.integers(5, 40)))
            crossed = {i + k for p in known for i in range(len(word)) if word.startswith(p, i) for k in range(1, len(p))}
            parts = trie.cut(word)
            edges = np.cumsum([len(p) for p in parts])[:-1].tolist()
            assert "".join(parts) == word and all(parts) and not crossed & set(edges)
            assert set(trie.free_cuts(pieces._codes(word)).tolist()) == set(range(1, len(word))) - crossed
            # A part is only as long as the pieces make it.
            for start, end in zip([0, *edges], [*edges, len(word)]):
                assert end - start <= 4 or not set(range(start + 1, start + 5)) - crossed


def test_units_of_a_batch_are_numbered_once(lattices, monkeypatch):
    """A batch asks for each of its units once, and gets the units that each text has by itself."""
    monkeypatch.setattr(pieces, "UNIT", 6)
    texts = ["skipped", "abc ab", None, "", " ", "ab  ab ", "cabxabcabxabcab ab", "é\n😀 x", "abcabc abcab abcabcab", "ab " * 500]
    asked = []
    look_up = pieces.Lattices.look_up
    monkeypatch.setattr(pieces.Lattices, "look_up", lambda self, units: asked.append(units) or look_up(self, units))
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"]).slice(1)
    own = pieces.Lattices(VOCABULARY)
    sizes, numbers = pieces._numbers(batch.column(1), own)
    named, places = dict(map(reversed, own.units.items())), np.cumsum([0, *sizes])
    for text, start, stop in zip(texts[1:], places, places[1:]):
        assert [named[n] for n in numbers[start:stop].tolist()] == pieces.units_of(text, own.trie)
    found = list(pieces._encoded(batch, pieces.Lattices(VOCABULARY), 2, 42))
    assert len(asked) == 2 and all(len(units) == len(set(units)) for units in asked)
    # And what is drawn is what every text gives alone.
    for doc, text in list(enumerate(texts))[1:]:
        alone = pieces.draw(lattices, [(doc, pieces.units_of(text, lattices.trie))], 2)[0]
        rows = [r for r in found if r[0] == doc]
        assert [r[3].tolist() for r in rows] == [lattices.spell(edges).tolist() for edges, _, _, _ in alone]
        assert [r[4:] for r in rows] == [pytest.approx(rest) for _, *rest in alone]
        assert all((r[1] or b"").decode() == (text or "") for r in rows)


def test_tasks_share_the_trie_and_nothing_else():
    one, two = pieces.Lattices(VOCABULARY), pieces.Lattices(VOCABULARY)
    one.look_up(["\ud800ab", "abc"])
    assert one.trie is two.trie and len(one.units) == 2 and not two.units and not len(two.root)


def test_trie_holds_the_pieces_and_no_more(monkeypatch):
    pick = np.random.default_rng(3)
    words = sorted({"".join(pick.choice(list("abcdé日😀"), pick.integers(1, 6))) for _ in range(900)})
    for window in (2, 1024):
        monkeypatch.setattr(pieces, "_WINDOW", window)
        trie = pieces.Trie(pieces.Vocabulary((*words, *(None,) * 256), len(words)))
        starts = {w[:n] for w in words for n in range(len(w) + 1)}
        numbers, nodes = dict(zip(words, range(len(words)))), {"": 0}
        for prefix in sorted(starts, key=len):
            for code in "abcdé日\U0001f600x\ud800\U0010ffff":
                found, child = trie.step(np.array([nodes[prefix]]), trie.rank[pieces._codes(code)])
                assert len(found) == (prefix + code in starts)
                if len(found):
                    nodes[prefix + code] = int(child[0])
                    assert trie.piece[child[0]] == numbers.get(prefix + code, -1)
        assert len(set(nodes.values())) == len(starts)


def test_draws_do_not_depend_on_the_steps_looked_at_together(lattices, monkeypatch):
    rows = [(i, pieces.units_of(t, lattices.trie)) for i, t in enumerate(["abc ab", "", "cabab", "abcab cab " * 40, "b"])]
    want = pieces.draw(lattices, rows, 5)
    for ahead in (1, 3, 1000):
        monkeypatch.setattr(pieces, "_AHEAD", ahead)
        for one, two in zip(want, pieces.draw(lattices, rows, 5)):
            assert [e.tolist() for e, _, _, _ in one] == [e.tolist() for e, _, _, _ in two]
            assert [rest for _, *rest in one] == [pytest.approx(rest) for _, *rest in two]


def test_rows_of_the_query_against_all_segmentations(spark, lattices, monkeypatch):
    """What a table gives is among all segmentations of its text, with their probabilities, best first, and decodes."""
    monkeypatch.setattr(pieces, "load", lambda path, sharpness=1.0: VOCABULARY)
    texts = ["abcab", "cab ab", "", None, "é b", "abcabcab", "b"]
    frame = spark.createDataFrame(list(enumerate(texts)), COLUMNS)
    found = pieces.sample_encode(frame, 3, digest=True).collect()
    for doc, text in enumerate(texts):
        known = segmentations(lattices, text or "")
        own = sorted((r for r in found if r["doc_id"] == doc), key=lambda r: r["sample"])
        assert [r["sample"] for r in own] == list(range(1, min(3, len(known)) + 1))
        assert len({tuple(r["ids"]) for r in own}) == len(own)
        for r in own:
            assert r["log_prob"] == pytest.approx(known[tuple(r["ids"])]) and r["n_pieces"] == len(r["ids"]) and r["decodes"]
            assert r["ids_md5"] == hashlib.md5(np.array(r["ids"], "<i4").tobytes()).hexdigest()
        assert [r["score"] for r in own] == sorted((r["score"] for r in own), reverse=True)


@needs_model
def test_decode_a_table(spark):
    texts = ["The quick brown fox.", "", None, "日本語 \U0001f600 ▁", " a  b"]
    encoded = pieces.sample_encode(spark.createDataFrame(list(enumerate(texts)), COLUMNS), 2)
    back = pieces.decode_table(encoded.selectExpr("*", "'mine' as text", "1 as `a.b`")).collect()
    assert {(r["doc_id"], r["text"], r["a.b"]) for r in back} == {(i, t or "", 1) for i, t in enumerate(texts)}
    assert pieces.decode_table(spark.createDataFrame([(None,)], "ids array<int>")).collect()[0]["text"] is None
    assert pieces.decode_table(encoded.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode_table(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()


@needs_model
def test_round_trip_and_odd_rows(spark):
    texts = [None, "", " ", "  two  spaces ", "line\nbreak\ttab", "▁ marker ퟿ \U0010ffff", "日本語 \U0001f600", "x" * 5000, "The quick brown fox."]
    frame = spark.createDataFrame([*enumerate(texts), (None, "no id"), (8, texts[8])], COLUMNS).selectExpr("*", "1 AS sample", "'x' AS ids").repartition(2)
    found = pieces.sample_encode(frame, 3).collect()
    table = pieces.Trie(pieces.load()).bytes
    assert all(pieces.decode(r["ids"], table) == ((texts[r["doc_id"]] if r["doc_id"] is not None else "no id") or "") for r in found)
    assert sorted(r["doc_id"] for r in found if r["doc_id"] in (0, 1)) == [0, 1] and len([r for r in found if r["doc_id"] == 8]) == 6
    again = pieces.sample_encode(frame, 3, digest=True)
    assert again.where("decodes").count() == len(found)
    assert pieces.sample_encode(frame.limit(0)).count() == 0
