"""Personal data: base spans against plain regular expressions, votes and classifier."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from martwright.llm import pii
from tests.conftest import SMALL

COLUMNS = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    spans = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), order, kind, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)]


TEXTS = [
    "mail me a@b.co or x.y+z@q-r.example.com_d@e.f.gh",
    "1.2.3.4 and 300.1.2.3.4 and 1.2.3.4.5.6.7.8 000255.1.1.1 0256.1.1.1 00000000000000000000001.1.1.1 1.1.1.99999999999999999999",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 5 4111111111111111 12345678901234567890123",
    "+1 (319) 555-5132 +12 +44 20 7946 0958. +1+2 3 4 5 6 7 8 9 0",
    None,
    "",
    "\U0001f600\U0001f600 a@b.co \U0001f600 1.2.3.4",
    "a" * 20000 + "@",
    "1" * 30000,
    "a@b." * 500 + "c",
    "1.2.3.4 " * 500,
    "9 " * 5000,
    "+1234567890" * 200,
]


def check(found, texts):
    assert len(found) == len(texts)
    for r in found:
        want = base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), COLUMNS).selectExpr("*", "1 AS spans", "'x' AS votes")
    check(pii.find(frame).collect(), dict(enumerate(TEXTS)))


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(pii.find(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def corpus():
    plain = [f"write to user{i}@mail{i % 9}.example.com now" for i in range(60)] + [f"call +1 (319) 555-{5000 + i} please" for i in range(60)] + [f"host 10.0.{i}.7 up" for i in range(40)]
    noise = [f"looked at home. Then section {i}.4 and 3 of {i}" for i in range(60)] + [f"order {1000 + i} 4111 1111 1111 {1000 + i}x" for i in range(30)]
    loose = ["contact: john [at] example [dot] com", "phone: (212) 555-1234 today", "server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up"]
    against = ["release 123-456-7890ab", "john [at] the [dot] zzzz", "isbn 4111-1111-1111-1112x"]
    return plain + noise + loose + against


def test_method_adds_likely_spans(spark):
    texts = corpus()
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), COLUMNS)).collect()}
    at = {t: i for i, t in enumerate(texts)}
    assert found[at["contact: john [at] example [dot] com"]] == "email:9:36"
    assert found[at["phone: (212) 555-1234 today"]] == "phone:7:21"
    assert found[at["server 2001:0db8:85a3:0000:0000:8a2e:0370:7334 up"]] == "ip:7:46"
    assert all(found[at[t]] == "" for t in texts if t.startswith(("looked", "release", "isbn")))


def test_reliabilities_find_the_good_labelers():
    counts = {(1, 1, 0, 0, 1): 900, (-1, -1, 0, 0, 1): 450, (-1, -1, 0, 0, -1): 450, (1, -1, 0, 0, 1): 50, (-1, 1, 0, 0, -1): 50}
    chances, tables = pii.reliabilities(counts)
    assert chances[(1, 1, 0, 0, 1)] > 0.95 and chances[(-1, -1, 0, 0, -1)] < 0.05
    assert tables[0][1][0] - tables[0][1][1] > tables[4][1][0] - tables[4][1][1]
    weights = pii.train(counts, chances)
    assert weights[0] > 0 and weights[1] > 0


def test_redaction(spark):
    rows = [(0, "to a@b.co and 1.2.3.4!", "en", 22), (1, None, "en", None), (2, "plain", "en", 5), (3, "\U0001f600 +1 (319) 555-5132", "en", 19)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _spans string, n_chars long")
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(frame.withColumnRenamed("_spans", "lang")).collect()}
    assert found == {0: ("to <EMAIL> and <IP>!", 20), 1: (None, None), 2: ("plain", 5), 3: ("\U0001f600 <PHONE>", 9)}


def test_odd_rows(spark):
    assert pii.find(spark.createDataFrame([], COLUMNS)).count() == 0
    found = pii.find(spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co")], COLUMNS)).collect()
    assert [r["n_email"] for r in found] == [1, 1]


def test_no_python_in_the_plan(spark, plan):
    text = plan(pii.with_candidates(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "text", "spans"))
    assert not re.search("Python|Pandas|Arrow", text)


@pytest.mark.parametrize("kind", pii.KINDS)
def test_patterns_are_anchored(kind):
    assert set(pii.STRICT) == set(pii.LOOSE) == set(pii.GAZETTEER) == set(pii.WORDS_FOR) and kind in pii.HINT


def redacted(text, spans):
    """Spans as written by ``find``, put into a text by hand."""
    out, at = [], 0
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], pii.KINDS.index(x[0]))):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


LARGE = [
    "a@" + "b." * 100_000 + "c",
    "x [at] " + "b [dot] " * 10_000 + "com",
    " ".join(f"u{i}@m.co" for i in range(50_000)),
    "é" * 5000 + " 4111 1111 1111 1112" * 3000 + " +1 (319) 555-5132 🙂" * 2000,
    ("word " * 900 + "to a@b.co and 1.2.3.4, (212) 555-1234! ") * 40,
    "1.2.3.4." * 4_000,
]


def test_large_texts(spark):
    """Long repeats don't overflow the stack, and many spans in one text take no time that grows with their square."""
    frame = spark.createDataFrame(list(enumerate(LARGE)), COLUMNS)
    started = time.monotonic()
    found = pii.find(frame).collect()
    assert time.monotonic() - started < 90
    check(found, dict(enumerate(LARGE)))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame.withColumn("n_chars", F.lit(0))).collect()}
    assert clean == {r["doc_id"]: redacted(LARGE[r["doc_id"]], r["spans"]) for r in found}


def test_redaction_is_that_of_the_spans(spark):
    texts = [t for t in TEXTS + corpus() if t is not None]
    frame = spark.createDataFrame(list(enumerate(texts)), COLUMNS).withColumn("n_chars", F.length("text").cast("long"))
    spans = {r["doc_id"]: r["spans"] for r in pii.find(frame).collect()}
    for r in pii.redact(frame).collect():
        want = redacted(texts[r["doc_id"]], spans[r["doc_id"]])
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_clashing_columns_and_empty_table(spark):
    names = ["_found", "_spans", "_clean", "_blocks", "_reached", "_spans_blocks", "__SPANS", "_spans_base_ip", "a.b"]
    frame = spark.createDataFrame([(1, "to a@b.co", 9)], "doc_id long, text string, n_chars long")
    for name in names:
        frame = frame.withColumn(name, F.lit("mine"))
    row = pii.redact(frame).first()
    assert row["text"] == "to <EMAIL>" and row["n_chars"] == 10 and all(row[name] == "mine" for name in names)
    assert pii.redact(frame.limit(0)).count() == 0 and pii.redact(frame).columns == frame.columns


def test_reliability_is_estimated_per_kind(spark):
    candidates = spark.createDataFrame([([(i, kind, i + 1, False, [1 if kind else -1, 1, 0, 0, 1 if kind else -1])],) for i in range(50) for kind in (0, 2)], f"spans array<{pii.SPAN}>")
    learned = pii.classifier(candidates, "spans")
    assert len(learned) == len(pii.KINDS) and learned[0] != learned[2] and learned[1] == learned[3]


@pytest.mark.parametrize("size", [1, 63, 1000])
def test_parts_of_a_text(spark, size):
    text = "".join(chr(97 + i % 26) if i % 5 else "🙂" for i in range(size * 9))
    frame = spark.createDataFrame([(text,)], "t string")
    assert "".join(frame.select(F.expr(pii._blocks("t"))).first()[0]) == text
    cuts = [(a, b) for a in (0, size, size * 4, size * 9) for b in (0, size + 1, size * 5, size * 9) if a <= b <= size * 9]
    found = frame.select(*[F.expr(pii._part(f"({pii._blocks('t')})", str(a), str(b))).alias(f"c{i}") for i, (a, b) in enumerate(cuts)]).first()
    assert list(found) == [text[a:b] for a, b in cuts]
