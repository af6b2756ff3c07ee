"""Language of a text by cross-parsing against labelled text.

Of every language a bounded sample of labelled text is kept as a suffix automaton. A
text is parsed greedily: the next phrase is the longest match that occurs anywhere in
the language's sample. A text in that language needs few phrases; their number, times
the bits of a position in the sample, per character, is the cross-parsing entropy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

UNKNOWN = "und"
# Bound of the sample per language: distinct texts, and characters of each.
TRAIN_ROWS, TRAIN_CHARS = 48, 1024
# Texts are parsed in blocks of this many characters, side by side; a phrase ends with its
# block, which costs every language at most one phrase more a block.
BLOCK = 4096
# Characters parsed at a time.
SYMBOLS = 1 << 22


def held_out(doc: Column) -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(doc.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, seed: int = 42) -> list[tuple[str, str]]:
    """Language and text of a bounded sample: a window of ``chars`` from ``rows`` distinct texts per language.

    Texts without a letter teach nothing and take no place; equal texts take one. Windows
    lie anywhere in a text, by a seeded hash.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.rlike("text", F.lit(r"\p{L}")))
    labelled = labelled.select(F.col("lang").alias("lang"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = labelled.withColumn("key", F.xxhash64("text", F.lit(seed)))
    texts = keyed.groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    drawn = texts.withColumn("place", place).where(F.col("place") <= rows).drop("place")
    start = F.pmod(F.col("key"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    found = keyed.join(drawn, ["lang", "key", "doc_id"], "left_semi").select("lang", "key", F.substr("text", start, F.lit(chars)).alias("text"))
    return sorted({(r["lang"], r["text"]) for r in found.collect()})


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def _symbols(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols of a text: runs of anything but letters are one separator (0)."""
    found = table[codes]
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep]


def automaton(symbols: np.ndarray) -> tuple[int, np.ndarray]:
    """States of the suffix automaton, and its transitions as rows (state, symbol, next)."""
    following, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols.tolist():
        new, at = len(following), last
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at >= 0 and symbol not in following[at]:
            following[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = following[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                copy = len(following)
                following.append(dict(following[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and following[at].get(symbol) == target:
                    following[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    edges = [(state, symbol, target) for state, out in enumerate(following) for symbol, target in out.items()]
    return len(following), np.array(edges, dtype=np.int64).reshape(-1, 3)


class Edges:
    """Transitions by (state, symbol): a slot by hash, the keys that find theirs taken by halving.

    Memory follows the number of transitions, at most three per symbol of the sample,
    whatever the size of the alphabet.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        slot = self._slot(keys)
        size = 1 << (64 - int(self.shift))
        _, kept = np.unique(slot, return_index=True)
        self.key, self.target = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        self.key[slot[kept]], self.target[slot[kept]] = keys[kept], targets[kept]
        rest = np.setdiff1d(np.arange(len(keys)), kept)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key = np.append(keys[rest], np.iinfo(np.int64).max)
        self.rest_target = np.append(targets[rest], -1).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no transition."""
        slot = self._slot(keys)
        target = self.target[slot]
        other = np.flatnonzero(self.key[slot] != keys)
        wanted = keys[other]
        place = np.searchsorted(self.rest_key, wanted)
        target[other] = np.where(self.rest_key[place] == wanted, self.rest_target[place], -1)
        return target


class Model:
    """Automata of all languages in one table of transitions."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        letters = _letters()
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(_codes(text))
        seen = np.unique(np.concatenate([c for t in texts.values() for c in t])) if texts else np.zeros(0, np.uint32)
        seen = seen[letters[seen]] if len(seen) else seen
        # 0 separates, 1.. are letters of the sample, the last one is any other letter.
        self.alphabet = len(seen) + 2
        self.table = np.where(letters, self.alphabet - 1, 0).astype(np.int32)
        self.table[seen] = np.arange(1, len(seen) + 1)
        self.languages, self.bits, edges, states, roots = sorted(texts), [], [], 0, []
        for lang in self.languages:
            symbols = np.concatenate([np.append(_symbols(c, self.table), 0) for c in texts[lang]])
            count, found = automaton(symbols)
            edges.append(found + np.array([states, 0, states]))
            roots.append(states)
            states += count
            # A phrase names a place in the sample; where that is short, at least a letter.
            self.bits.append(np.log2(max(len(symbols), self.alphabet) + 1))
        self.roots = np.array(roots, np.int32)
        joined = np.concatenate(edges) if edges else np.zeros((0, 3), np.int64)
        self.edges = Edges(joined[:, 0] * self.alphabet + joined[:, 1], joined[:, 2])
        keys = self.roots.astype(np.int64)[:, None] * self.alphabet + np.arange(self.alphabet)
        self.fresh = np.maximum(self.edges.find(keys.ravel()).reshape(keys.shape), self.roots[:, None]) if edges else np.zeros((0, self.alphabet), np.int32)

    def lettered(self, text: str | None) -> bool:
        return bool(text) and bool(self.table[_codes(text)].any())

    def phrases(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each lane of symbols under each language (languages x lanes)."""
        counts = np.zeros((len(self.languages), len(lanes)), np.int32)
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        lengths = np.array([len(lanes[i]) for i in order])
        grid = np.zeros((lengths[0] if len(lengths) else 0, len(lanes)), np.int32)
        for column, i in enumerate(order):
            grid[: len(lanes[i]), column] = lanes[i]
        roots = self.roots[:, None]
        state = np.repeat(roots, len(lanes), axis=1)
        found = np.zeros_like(counts)
        for step in range(len(grid)):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            symbol, now = grid[step, :active], state[:, :active]
            following = self.edges.find((now.astype(np.int64) * self.alphabet + symbol).ravel()).reshape(now.shape)
            ended = following < 0
            found[:, :active] += ended | (now == roots)
            state[:, :active] = np.where(ended, self.fresh[:, symbol], following)
        counts[:, order] = found
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        lanes: list[np.ndarray] = []
        owners: list[int] = []
        held = 0

        def settle() -> None:
            if not lanes:
                return
            counts, at = self.phrases(lanes), np.array(owners)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            sums = np.add.reduceat(counts, first, axis=1) * np.array(self.bits)[:, None]
            best = sums.argmin(axis=0)
            ranked = np.sort(sums, axis=0)
            margin = (ranked[1] - ranked[0]) / ranked[1] if len(sums) > 1 else np.ones(len(first))
            for i, b, s in zip(at[first].tolist(), best.tolist(), margin.tolist()):
                languages[i], scores[i] = self.languages[b], s
            lanes.clear()
            owners.clear()

        for i, text in enumerate(texts):
            symbols = _symbols(_codes(text), self.table) if text and self.languages else np.zeros(0, np.int32)
            if not symbols.any():
                continue
            for start in range(0, len(symbols), BLOCK):
                lanes.append(symbols[start : start + BLOCK])
                owners.append(i)
            held += len(symbols)
            if held > SYMBOLS:
                settle()
                held = 0
        settle()
        return languages, scores


@functools.lru_cache(maxsize=1)
def model(sample: tuple[tuple[str, str], ...]) -> Model:
    """Built once per process from the sample."""
    return Model(sample)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents that are not held out (a null doc_id is
    neither learned from nor held out). A null text, one without letters, or a table
    without any labels gives ``und`` with score 0; equal costs go to the first language
    by name; the score is the share by which the best language needs fewer bits than
    the second (1 if only one is known). Repeated rows come back as often; an empty
    table gives no rows; further columns of ``docs`` are not looked at. One pass, no
    shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(training_sample(docs)))
    chosen = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(shared.value)
        for batch in batches:
            languages, scores = known.predict(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose text has a language, known by a label or not, columns unchanged.

    Only null texts and texts without letters go, also where there is no label to learn from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(training_sample(docs)))
    text, plain = docs.columns.index("text"), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model(shared.value)
        for batch in batches:
            languages, _ = known.predict(batch.column(text).to_pylist())
            pairs = zip(languages, batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN or known.lettered(t) for lang, t in pairs], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
