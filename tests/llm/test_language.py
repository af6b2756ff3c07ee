"""Suffix automata and language prediction."""

import numpy as np
import pytest

from martwright.llm import language
from tests.conftest import SMALL

COLUMNS = "doc_id long, text string, lang string"


def test_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 60)
    count, edges = language.automaton(text)
    known = language.Edges(edges[:, 0] * 3 + edges[:, 1], edges[:, 2])
    assert count <= 2 * len(text) and len(edges) <= 3 * len(text)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, min(61, i + 8))}
    for word in rng.integers(0, 3, (400, 7)):
        state = 0
        for length, symbol in enumerate(word.tolist(), 1):
            state = int(known.find(np.array([state * 3 + symbol]))[0])
            assert (state >= 0) == (tuple(word[:length]) in inside)
            if state < 0:
                break


def test_phrases_equal_greedy_parse(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 50)
    model = language.Model((("a", "the cat sat on the mat"), ("b", "der hund und die katze")))

    def greedy(symbols, sample):
        joined = bytes(sample)
        count = at = 0
        while at < len(symbols):
            size = 1
            while at + size < len(symbols) and bytes(symbols[at : at + size + 1]) in joined:
                size += 1
            count, at = count + 1, at + size
        return count

    lanes = [language._symbols(language._codes(t), model.table) for t in ("the rat sat", "und die kiste 12 zzz", "q", "mat" * 20)]
    samples = [np.append(language._symbols(language._codes(t), model.table), 0) for t in ("the cat sat on the mat", "der hund und die katze")]
    found = model.phrases(lanes)
    assert [[greedy(lane.tolist(), s.tolist()) for lane in lanes] for s in samples] == found.tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and len(held) > 30
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(40)] + [(100 + i, "le chat est sur la table avec le chien", "fr") for i in range(40)]
    rows += [(200, None, "en"), (201, "12 !? \n", "en"), (202, "", None), (203, "le chat " * 40000, None), (None, "the dog", "xx"), (203, "le chat", None)]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS lang_pred", "2 AS _text")
    found = [(r["doc_id"], r["lang_pred"]) for r in language.identify(frame).collect()]
    assert len(found) == len(rows)
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "fr"), (None, "en")} <= set(found)
    kept = language.keep_identified(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3
    assert language.identify(spark.createDataFrame([], COLUMNS)).count() == 0
    alone = language.identify(spark.createDataFrame([(1, "text", None)], COLUMNS)).first()
    assert (alone["lang_pred"], alone["score"]) == ("und", 0.0)


def test_symbols_fold_separators():
    model = language.Model((("a", "ab"),))
    assert language._symbols(language._codes("A, b!!  1B"), model.table).tolist() == [1, 0, 2, 0, 2]
    assert model.predict(["ab", "é"])[0] == ["a", "a"] and model.predict(["ab"])[1].tolist() == pytest.approx([1.0])


def test_large_alphabet_takes_little_memory():
    letters = [chr(0x4E00 + i) for i in range(5000)]
    pick = np.random.default_rng(1)
    sample = tuple((lang, "".join(pick.choice(letters, 1024))) for lang in ("x", "y", "z") for _ in range(16))
    model = language.Model(sample)
    held = sum(a.nbytes for a in (model.edges.key, model.edges.target, model.edges.rest_key, model.edges.rest_target, model.fresh, model.table))
    assert model.alphabet > 4900 and held < 100e6
    texts = [text[100:300] for _, text in sample[::16]]
    assert model.predict(texts)[0] == ["x", "y", "z"]


def test_edges_find_every_key():
    pick = np.random.default_rng(2)
    keys = np.unique(pick.integers(0, 10**6, 5000))
    targets = pick.integers(0, 10**6, len(keys))
    known = dict(zip(keys.tolist(), targets.tolist()))
    asked = pick.integers(0, 10**6, 20000)
    assert language.Edges(keys, targets).find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]


def test_whole_query_by_brute_force(spark):
    """Languages and scores of a table from substring searches alone."""
    pick = np.random.default_rng(5)
    rows = []
    for i in range(160):
        lang, letters = [("aa", "abcdef"), ("bb", "bcdegh"), ("cc", "ghijkl")][i % 3]
        words = ["".join(pick.choice(list(letters), pick.integers(2, 7))) for _ in range(pick.integers(1, 30))]
        rows.append((i, " ".join(words) + "." * (i % 2), None if i % 5 == 0 else lang))
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "?! 12", "bb"), (503, "zzzz", None), (504, "ab\u00e9 x", None)]
    frame = spark.createDataFrame(rows, COLUMNS)
    sample = language.training_sample(frame)
    assert len(sample) == 3 * 48 or all(any(c.isalpha() for c in t) for _, t in sample)

    def folded(text):
        out = []
        for c in text.lower():
            out.append(c if c.isalpha() else "\0")
        return "".join(c for i, c in enumerate(out) if c != "\0" or i == 0 or out[i - 1] != "\0")

    texts, seen = {}, set()
    for lang, text in sample:
        texts[lang] = texts.get(lang, "") + folded(text) + "\0"
        seen |= set(folded(text)) - {"\0"}

    def cost(text, lang):
        text = "".join(c if c in seen or c == "\0" else "\1" for c in folded(text))
        phrases = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in texts[lang]:
                size += 1
            phrases, at = phrases + 1, at + size
        return phrases * np.log2(max(len(texts[lang]), len(seen) + 2) + 1)

    for r in language.identify(frame).collect():
        text = rows[r["doc_id"]][1] if r["doc_id"] < 160 else next(t for i, t, _ in rows if i == r["doc_id"])
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        costs = sorted((cost(text, lang), lang) for lang in texts)
        assert r["lang_pred"] == costs[0][1] and r["score"] == pytest.approx((costs[1][0] - costs[0][0]) / costs[1][0])


def test_sample_takes_windows_of_distinct_texts(spark):
    header = "the same header " * 100
    rows = [(i, header + f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 2000, "en") for i in range(60)]
    rows += [(1000 + i, "copied text", "en") for i in range(500)] + [(2000 + i, "12 34", "en") for i in range(500)] + [(3000 + i, "", "en") for i in range(500)]
    sample = language.training_sample(spark.createDataFrame(rows, COLUMNS))
    assert 40 < len(sample) <= 48 and all(len(t) <= language.TRAIN_CHARS for _, t in sample)
    assert sum("header" not in t for _, t in sample) > 10 and sum(t == "copied text" for _, t in sample) <= 1
