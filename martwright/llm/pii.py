"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Spans of the strict patterns are always reported. Looser patterns propose further
candidates. On every candidate five labelers vote yes, no or not at all: its form (a
regular expression), a gazetteer (known endings, prefixes and calling codes), the words
before it, its edges, and a check of its numbers. Expectation-maximisation over the
counts of the vote patterns estimates how reliable each labeler is, and a logistic
classifier trained on the resulting probabilities decides over the loose candidates.
Everything per document is DataFrame expressions; the driver sees the counts of at most
4 * 3 ** 5 patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from martwright.functions.arrays import MOST, SUM, let, running
from martwright.llm.common import stored, unused

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "edges", "numbers")

# The strict patterns, anchored so that a search never starts again inside
# a run of characters that it has already tried, and possessive where a group repeats
# without bound: such a group is matched in a loop, not by recursion. A card is a whole
# run of digits.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
STRICT = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _LOCAL + r"(?:\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": STRICT["card"],
    "phone": r"(?<![0-9A-Za-z+().-])(?:00[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
# What a text must contain before a pattern is tried at all.
HINT = {"email": r"@|[\x20\[({]at[\x20\])}]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]|[0-9][\x20.-][0-9]{4}"}
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])}]?\x20?)(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|eu|us|ch|at|nl|pl|ru|jp|cn|br|in|ca|au)$",
    "ip": r"^(?:10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|[1-9][0-9]{0,2})\.|^(?:2[0-9a-fA-F]{3}|f[cde][0-9a-fA-F]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|3[0568]|35)",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}\)?[\x20.-]",
}
WORDS_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ipv6|server|host|address|adresse|gateway)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l)\b",
}
WORDS_AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|order|invoice|section|chapter|figure|page|patent|serial|commit|sha|hash)\b"
CONTEXT = 40
# Characters of a text that are looked through to find a place in it.
BLOCK = 4096


def _raw(pattern: str) -> str:
    """A pattern as a SQL literal without escapes."""
    return f"r'{pattern}'"


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of digits passes the check."""
    digit = "cast(substr(turned, i + 1, 1) AS INT)"
    value = f"CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return let("turned", f"reverse({digits})", f"aggregate(sequence(0, length(turned) - 1), 0, (total, i) -> total + {value}) % 10 = 0")


def _passes(kind: str, match: str) -> str:
    """Whether a match of the strict pattern is a base span."""
    if kind == "ip":
        # Of a part without leading zeros at most three digits can be in range.
        short = f"regexp_replace(p, {_raw('^0+(?=[0-9])')}, '')"
        return f"forall(split({match}, {_raw('[.]')}), p -> length({short}) <= 3 AND cast(substring({short}, 1, 3) AS INT) <= 255)"
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return f"length({_digits(match)}) BETWEEN 9 AND 15"
    return "true"


def _blocks(text: str) -> str:
    """A text in pieces of ``BLOCK`` characters, so that a part of it is found without a walk from the start."""
    return f"CASE WHEN length({text}) <= {BLOCK} THEN array({text}) ELSE regexp_extract_all({text}, {_raw(f'(?s).{{1,{BLOCK}}}')}, 0) END"


def _part(blocks: str, start: str, end: str) -> str:
    """Characters start to end of a text in blocks; both lie inside it."""
    first, last = "(lo DIV {0})".format(BLOCK), "((hi - 1) DIV {0})".format(BLOCK)
    head = f"get({blocks}, cast({first} AS INT))"
    inside = f"substr({head}, lo % {BLOCK} + 1, hi - lo)"
    between = f"array_join(slice({blocks}, cast({first} AS INT) + 2, cast({last} - {first} AS INT) - 1), '')"
    across = f"concat(substr({head}, lo % {BLOCK} + 1), {between}, substr(get({blocks}, cast({last} AS INT)), 1, cast(hi - {last} * {BLOCK} AS INT)))"
    cases = f"CASE WHEN hi <= lo THEN '' WHEN {first} = {last} THEN {inside} ELSE {across} END"
    return let("lo", start, let("hi", end, cases))


MATCHES = "array<struct<start:int,match:string>>"


def _matches(text: str, pattern: str, hint: str) -> str:
    """Matches from the left that don't overlap, as structs (start, match); code points from 0."""
    gaps = f"slice(transform(split({text}, {_raw(pattern)}, -1), piece -> length(piece)), 1, size(found))"
    before = running("zip_with(gaps, found, (gap, match) -> gap + length(match))", SUM)
    places = f"zip_with({before}, gaps, (before, gap) -> before + gap)"
    pairs = f"zip_with({places}, found, (start, match) -> named_struct('start', start, 'match', match))"
    listed = let("found", f"regexp_extract_all({text}, {_raw(pattern)}, 0)", let("gaps", gaps, pairs))
    return f"CASE WHEN rlike({text}, {_raw(hint)}) THEN {listed} ELSE cast(array() AS {MATCHES}) END"


def _vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def _votes(kind: str, blocks: str, size: str, base: bool) -> str:
    """Votes of the labelers on a span ``s``, as an array in their order."""
    end, digits = "s.start + length(s.match)", _digits("s.match")
    before = _part(blocks, f"greatest(s.start - {CONTEXT}, 0)", "s.start")
    edges = f"concat(CASE WHEN s.start > 0 THEN {_part(blocks, 's.start - 1', 's.start')} ELSE ' ' END, {_part(blocks, end, f'least({end} + 1, {size})')})"
    strict = str(base).lower()
    same_gaps = r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"
    form = {"card": f"{strict} OR rlike(s.match, {_raw(same_gaps)})", "ip": "true"}.get(kind, strict)
    numbers = {
        "email": "length(s.match) <= 254", "ip": f"{strict} OR contains(s.match, ':')", "card": _luhn(digits), "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]
    votes = [
        _vote(form), _vote(f"rlike(s.match, {_raw(GAZETTEER[kind])})", str(kind in ("email", "card")).lower()),
        let("words", before, _vote(f"rlike(words, {_raw(WORDS_FOR[kind])})", f"rlike(words, {_raw(WORDS_AGAINST)})")),
        _vote("false", f"rlike({edges}, {_raw('[' + chr(92) + 'p{L}0-9]')})"), _vote(numbers, "true"),
    ]
    return f"array({', '.join(votes)})"


def _overlaps(others: str) -> str:
    """Whether a span ``s`` overlaps one of others, which are sorted and lie apart: only the last that begins before its end can."""
    bits = f"sequence(cast(floor(log2(greatest(size({others}), 1))) AS INT), 0, -1)"
    further = f"n + shiftleft(1, bit) <= size({others}) AND get({others}, n + shiftleft(1, bit) - 1).start < s.start + length(s.match)"
    last = f"get({others}, aggregate({bits}, 0, (n, bit) -> CASE WHEN {further} THEN n + shiftleft(1, bit) ELSE n END) - 1)"
    return let("o", last, "coalesce(o.start + length(o.match) > s.start, false)")


SPAN = "struct<start:int,kind:int,end:int,base:boolean,votes:array<int>>"


def _candidates(matches: str, kind: str, blocks: str, size: str, base: bool) -> str:
    """Matches as candidate spans with their votes."""
    fields = f"'start', s.start, 'kind', {KINDS.index(kind)}, 'end', s.start + length(s.match), 'base', {str(base).lower()}, 'votes', {_votes(kind, blocks, size, base)}"
    return f"transform({matches}, s -> named_struct({fields}))"


def with_candidates(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with all candidate spans in column ``name``; a narrow step without shuffle.

    Base spans come as they are; a loose candidate only where no base span is.
    """
    whole, blocks, size = (unused(docs, f"{name}_{part}") for part in ("text", "blocks", "size"))
    strict, passed, loose = ({k: unused(docs, f"{name}_{part}_{k}") for k in KINDS} for part in ("strict", "base", "loose"))
    found = docs.withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    first = {blocks: _blocks(whole), size: f"length({whole})", **{c: _matches(whole, STRICT[k], HINT[k]) for k, c in strict.items()}}
    # A card candidate is a run of digits that fails the check, so its strict matches serve.
    second = {c: strict[k] if k == "card" else _matches(whole, LOOSE[k], HINT[k]) for k, c in loose.items()}
    second |= {c: f"filter({strict[k]}, s -> {_passes(k, 's.match')})" for k, c in passed.items()}
    for step in (first, second):
        found = found.withColumns({c: F.expr(e) for c, e in step.items()})
    free = " AND ".join(f"NOT {_overlaps(c)}" for c in passed.values())
    spans = [_candidates(passed[k], k, blocks, size, True) for k in KINDS]
    spans += [_candidates(f"filter({loose[k]}, s -> {free})", k, blocks, size, False) for k in KINDS]
    found = found.withColumn(name, F.expr(f"cast(array_sort(concat({', '.join(spans)})) AS array<{SPAN}>)"))
    return found.drop(whole, blocks, size, *strict.values(), *passed.values(), *loose.values())


Votes = tuple[int, ...]
Table = dict[int, tuple[float, float]]

# Pseudo-counts behind a belief about a labeler, and about the share of a class.
PRIOR = 20.0
# Before anything is seen: a labeler is right about four times in five when it votes.
BELIEVED: Table = {1: (0.55, 0.15), 0: (0.3, 0.3), -1: (0.15, 0.55)}


def reliabilities(counts: dict[Votes, int], rounds: int = 50, believed: list[Table] | None = None) -> tuple[dict[Votes, float], list[Table]]:
    """Probability of each vote pattern and, per labeler and vote, its chance if the span is one and if not.

    ``believed`` are such chances to start from; ``PRIOR`` pseudo-counts hold on to them,
    which settles a corpus in which some vote never occurs.
    """
    believed = believed or [BELIEVED] * len(LABELERS)
    tables, share = [dict(t) for t in believed], 0.5
    chances: dict[Votes, float] = {}
    for _ in range(rounds):
        for votes in counts:
            yes = math.log(share) + sum(math.log(t[v][0]) for t, v in zip(tables, votes))
            no = math.log(1 - share) + sum(math.log(t[v][1]) for t, v in zip(tables, votes))
            chances[votes] = 1 / (1 + math.exp(min(700.0, no - yes)))
        positive = sum(n * chances[v] for v, n in counts.items())
        total = sum(counts.values())
        share = (positive + PRIOR / 2) / (total + PRIOR)
        for at, (table, first) in enumerate(zip(tables, believed)):
            for vote in (1, 0, -1):
                seen = [(n, chances[v]) for v, n in counts.items() if v[at] == vote]
                yes, no = sum(n * c for n, c in seen), sum(n * (1 - c) for n, c in seen)
                table[vote] = ((yes + PRIOR * first[vote][0]) / (positive + PRIOR), (no + PRIOR * first[vote][1]) / (total - positive + PRIOR))
    return chances, tables


def train(counts: dict[Votes, int], chances: dict[Votes, float], rounds: int = 2000, step: float = 0.5, decay: float = 0.01, start: list[float] | None = None) -> list[float]:
    """Weights of a logistic classifier (the last one is the bias) on the votes.

    Positive and negative mass weigh the same, so that a corpus full of plain cases
    does not decide over the others by its mere share. ``start`` are weights that are
    held on to where there is little mass of a class.
    """
    least = PRIOR if start else 0.0
    positive = max(least, sum(n * chances[v] for v, n in counts.items())) or 1.0
    negative = max(least, sum(n * (1 - chances[v]) for v, n in counts.items())) or 1.0
    rows = [((*v, 1), n * chances[v] / positive, n * (1 - chances[v]) / negative) for v, n in counts.items()]
    prior = start or [1.0] * len(LABELERS) + [-1.0]
    weights = list(prior)
    for _ in range(rounds):
        slope = [decay * (w - p) for w, p in zip(weights, prior)]
        for x, yes, no in rows:
            score = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(w * v for w, v in zip(weights, x))))))
            off = (yes + no) * score - yes
            for i, v in enumerate(x):
                slope[i] += off * v
        weights = [w - step * s for w, s in zip(weights, slope)]
    return weights


def classifier(candidates: DataFrame, name: str) -> list[list[float]]:
    """Per kind the weights learned from the votes on all candidate spans of it.

    A labeler has a reliability for each kind. What all kinds together say about it is
    the belief that each of them starts from, so a rare kind stays near the others.
    """
    votes = F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), s["votes"].alias("votes")))
    rows = candidates.select(F.explode(votes).alias("s")).groupBy("s").agg(F.count("*").alias("rows")).collect()
    by_kind: list[dict[Votes, int]] = [{} for _ in KINDS]
    every: dict[Votes, int] = {}
    for r in rows:
        pattern = tuple(r["s"]["votes"])
        by_kind[r["s"]["kind"]][pattern] = r["rows"]
        every[pattern] = every.get(pattern, 0) + r["rows"]
    if not every:
        return [[1.0] * len(LABELERS) + [-1.0]] * len(KINDS)
    chances, tables = reliabilities(every)
    common = train(every, chances)
    return [train(counts, reliabilities(counts, believed=tables)[0], start=common) if counts else common for counts in by_kind]


def accepted(spans: str, weights: list[list[float]]) -> Column:
    """Base spans and the loose candidates that the classifier of their kind takes, by start, then kind."""
    table = ", ".join(f"array({', '.join(f'{w!r}D' for w in own)})" for own in weights)
    score = " + ".join([f"get(own, {len(LABELERS)})", *(f"s.votes[{i}] * get(own, {i})" for i in range(len(LABELERS)))])
    return F.expr(f"filter({spans}, s -> s.base OR {let('own', f'get(array({table}), s.kind)', f'{score} > 0')})")


def _written(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base spans. A null text is empty; spans of
    equal start come in the order of the kinds; repeated rows come back as often as they
    came; an empty table gives no rows; further columns are not looked at.
    """
    kept = stored(with_candidates(docs.select("doc_id", "text"), "text", "spans").select("doc_id", "spans"), "candidates")
    weights = classifier(kept, "spans")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return kept.select("doc_id", *map(count, KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(accepted("spans", weights)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by its kind in angle brackets; n_chars follows.

    Of overlapping spans the first one names the whole. The spans are found once and
    stored beside their rows. Null and empty texts and those without a span come back as
    they are, with the n_chars they had; repeated rows stay repeated, an empty table
    stays empty. Other columns are not touched, whatever their names.
    """
    spans, found, clean = (unused(docs, name) for name in ("spans", "found", "clean"))
    rows = stored(with_candidates(docs, "text", spans), "redacted")
    weights = classifier(rows, spans)
    blocks, reached = unused(docs, "blocks"), unused(docs, "reached")
    rows = rows.withColumn(found, accepted(spans, weights))
    ends = f"transform({found}, s -> s.end)"
    rows = rows.withColumns({blocks: F.expr(_blocks("text")), reached: F.expr(running(ends, MOST))})
    # A span that begins inside an earlier one adds nothing; the others keep what lies before them.
    name = f"get(array({', '.join(repr(f'<{k.upper()}>') for k in KINDS)}), s.kind)"
    pieces = f"zip_with({found}, {reached}, (s, at) -> CASE WHEN s.start >= at THEN concat({_part(blocks, 'at', 's.start')}, {name}) ELSE '' END)"
    cut = f"concat(array_join({pieces}, ''), {_part(blocks, f'array_max({ends})', 'length(text)')})"
    rows = rows.withColumn(clean, F.expr(f"CASE WHEN size({found}) > 0 THEN {cut} ELSE text END"))
    columns = {"text": F.col(clean), "n_chars": F.when(F.size(found) > 0, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
