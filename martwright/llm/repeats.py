"""Removal of long repeated byte strings, by content-defined parsing of the corpus.

Triggers of a rolling hash cut every text into phrases: the trigger of a string of
``length`` bytes is the position in its first ``length - CORE`` bytes whose window of
``WINDOW`` bytes has the smallest hash, so equal strings have their trigger at the same
place and no phrase is longer than that. A phrase is the run of positions that share a
trigger; with the bytes that follow, up to ``length`` from its last position, it is an
entry of the dictionary, and the texts are sequences of such entries.

Corpus order is only needed as far as ``length`` bytes: which positions have a neighbour
in it that agrees on all of them. Entries that occur again settle all their positions
at once; so does an entry whose core, the bytes that all its strings share, is alone.
Of the others one each is taken apart into parts of ``PART`` positions, which are settled
the same way, and what is left into single suffixes, which meet by a 128-bit digest of
their first ``length`` bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from martwright.llm.common import stored

LENGTH, CORE, WINDOW, PART = 400, 128, 8, 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Positions of a text that are parsed at a time.
CHUNK = 1 << 18
# Parts of entries that a task hands on at a time.
PACKED = 1 << 14
# Bits of the filter that spares the second pass most of the shuffle; a full filter only spares less.
FILTER_BITS, SEGMENT_BITS = 27, 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def parse(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a text as arrays (first, last, trigger) of positions.

    Every position that starts a string of ``length`` bytes lies in one phrase.
    """
    parts = []
    for start in range(0, len(data) - length + 1, CHUNK):
        piece = data[start : start + CHUNK + length - 1]
        count = len(piece) - CORE + 1
        windows = np.empty(count, np.uint64)
        for shift in range(min(WINDOW, count)):
            places = (count - shift + WINDOW - 1) // WINDOW
            windows[shift::WINDOW] = np.frombuffer(piece, "<u8", places, shift)
        ranked = ((windows * _ODD) & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
        trigger = (_least(ranked, length - CORE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        last = np.append(first[1:], len(trigger)) - 1
        parts.append((first + start, last + start, trigger[first] + start))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _cores(data: bytes, triggers: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[t : t + CORE]) for t in triggers.tolist()], dtype=np.uint64)


def _wide(data: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """128-bit digests of byte ranges, as two columns of signed numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _key(data: bytes) -> tuple[int, int]:
    """Digest by which a text is known; equal texts share one, and all that is found in them."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(data))


def _filter(places: DataFrame) -> np.ndarray:
    """Bitmap of the distinct ``place`` values; its size is fixed, its segments are built side by side."""
    places = places.select("place").distinct().withColumn("segment", F.shiftright("place", SEGMENT_BITS).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << SEGMENT_BITS, bool)
        bits[part["place"].to_numpy() & ((1 << SEGMENT_BITS) - 1)] = True
        return pd.DataFrame({"segment": [part["segment"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})

    found = np.zeros((1 << (FILTER_BITS - SEGMENT_BITS), 1 << (SEGMENT_BITS - 3)), np.uint8)
    for row in places.groupBy("segment").applyInPandas(pack, "segment int, bits binary").toLocalIterator():
        found[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return found.ravel()


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _in_filter(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(29))) * _ODD
    return numbers ^ (numbers >> np.uint64(32))


def _id(key: tuple[int, int], first: np.ndarray) -> np.ndarray:
    """Numbers by which the phrases of a text are known."""
    high, low = (np.array([k], np.int64).view(np.uint64) for k in key)
    return _mixed((high * _ODD ^ first.astype(np.uint64)) * _ODD + low)


def _settle(found: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Ranges whose bytes occur again, and the ids of those that must be taken apart.

    ``found`` has core, high, low (the digest of all the range's bytes), id, text_a, text_b,
    first and last. Of a core that has several kinds, one of them alone, one each goes apart.
    """
    kinds = stored(found.groupBy("core", "high", "low").agg(F.count("*").alias("rows"), F.min("id").alias("id")), label)
    mixed = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("rows").alias("fewest")).where("kinds > 1 and fewest = 1").select("core")
    ranges = found.select("high", "low", "text_a", "text_b", "first", "last")
    again = ranges.join(kinds.where("rows > 1").select("high", "low"), ["high", "low"]).drop("high", "low")
    return again, kinds.select("core", "id").join(mixed, "core").select("id")


def _spans(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings that start anywhere in first..last."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order] + length)
    opens = np.append(True, first[1:] > end[:-1])
    closes = np.append(opens[1:], True)
    return list(zip(first[opens].tolist(), end[closes].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept).

    Removes every byte covered by a string of ``length`` bytes that starts at another
    place too, in the same or another document; strings are those of the input. Null and
    empty texts have no bytes; repeated rows are documents of their own, so each of
    them repeats the other; an empty table gives no rows; further columns are not
    looked at. ``with_text`` adds the remaining bytes.
    """
    if length < CORE + WINDOW:
        raise ValueError(f"length must be at least {CORE + WINDOW}")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_cores(data, parse(data, length)[2]) for data in _texts(batch.column(0))]
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["core"])

    place = F.shiftrightunsigned("core", 64 - FILTER_BITS).alias("place")
    seen = texts.mapInArrow(cores, "core long").groupBy("core").agg(F.count("*").alias("rows")).where("rows > 1")
    repeated = spark.sparkContext.broadcast(_filter(seen.select(place)))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in _texts(batch.column(0)):
                first, last, trigger = parse(data, length)
                core = _cores(data, trigger)
                again = _in_filter(repeated.value, _place(core))
                if not again.any():
                    continue
                first, last, core, key = first[again], last[again], core[again], _key(data)
                wide = _wide(data, list(zip(first.tolist(), (last + length).tolist())))
                same = [np.full(len(core), k, np.int64) for k in key]
                columns = [core.view(np.int64), wide[:, 0], wide[:, 1], _id(key, first).view(np.int64), *same, first.astype(np.int32), last.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["core", "high", "low", "id", "text_a", "text_b", "first", "last"])

    layout = "core long, high long, low long, id long, text_a long, text_b long, first int, last int"
    whole, open_entries = _settle(stored(texts.mapInArrow(entries, layout), "entries"), "dictionary")
    opened = spark.sparkContext.broadcast(_filter(open_entries.select(F.shiftrightunsigned("id", 64 - FILTER_BITS).alias("place"))))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The filter may let further entries pass; that only adds suffixes without an equal.
        # Equal texts open the same entries: a task sends them once, as they are settled already.
        sent: set[int] = set()
        names = ["id", "text_a", "text_b", "entry", "last", "trigger", "bytes"]
        for batch in batches:
            for data in _texts(batch.column(0)):
                first, last, trigger = parse(data, length)
                key = _key(data)
                own = _id(key, first)
                chosen = _in_filter(opened.value, _place(own))
                fresh = [i for i in own[chosen].tolist() if i not in sent]
                if fresh:
                    sent.update(fresh)
                    chosen &= np.isin(own, np.array(fresh, np.uint64))
                    first, last, trigger, own = first[chosen], last[chosen], trigger[chosen], own[chosen]
                    held = [data[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
                    same = [np.full(len(first), k, np.int64) for k in key]
                    numbers = [own.view(np.int64), *same, *(x.astype(np.int32) for x in (first, last, trigger))]
                    yield pa.record_batch([*map(pa.array, numbers), pa.array(held, pa.binary())], names=names)

    held = texts.mapInArrow(contexts, "id long, text_a long, text_b long, entry int, last int, trigger int, bytes binary")
    held = stored(held, "contexts")

    def packed(out: list[tuple], digests: list[bytes]) -> pa.RecordBatch:
        core, own, a, b, low, high, entry = (np.array(c) for c in zip(*out))
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        ids = _mixed(own.astype(np.int64).view(np.uint64) + low.astype(np.uint64)).view(np.int64)
        columns = [core.astype(np.uint64).view(np.int64), pair[:, 0], pair[:, 1], ids, a, b, low.astype(np.int32), high.astype(np.int32), own]
        return pa.record_batch([pa.array(c) for c in columns], names=["core", "high", "low", "id", "text_a", "text_b", "first", "last", "entry"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, narrow = xxhash.xxh3_128_digest, xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[tuple] = []
            digests: list[bytes] = []
            for own, a, b, entry, last, trigger, data in zip(*(c.to_pylist() for c in batch.columns)):
                for number in range((trigger - last) // PART, (trigger - entry) // PART + 1):
                    low, high = max(entry, trigger - number * PART - PART + 1), min(last, trigger - number * PART)
                    # What all strings of the part share lies at the same place before the trigger everywhere.
                    start = trigger - number * PART - entry
                    core = narrow(data[start : start - PART + 1 + length], number)
                    digests.append(wide(data[low - entry : high - entry + length]))
                    out.append((core, own, a, b, low, high, entry))
                if len(out) >= PACKED:
                    yield packed(out, digests)
                    out, digests = [], []
            if out:
                yield packed(out, digests)

    cut_up = stored(held.mapInArrow(parts, f"{layout}, entry long"), "parts")
    several, open_parts = _settle(cut_up, "part_kinds")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, entry, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b", "entry", "bytes", "ranges"))):
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges])
                wide = _wide(data, [(p - entry, p - entry + length) for p in at.tolist()])
                same = [np.full(len(at), k, np.int64) for k in (a, b)]
                yield pa.record_batch([*map(pa.array, (*same, at.astype(np.int32), wide[:, 0], wide[:, 1]))], names=["text_a", "text_b", "first", "high", "low"])

    lists = cut_up.join(open_parts, "id").groupBy(F.col("entry").alias("id")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    loose = stored(held.join(lists, "id").mapInArrow(suffixes, "text_a long, text_b long, first int, high long, low long"), "suffixes")
    equal = loose.groupBy("high", "low").agg(F.count("*").alias("rows")).where("rows > 1").select("high", "low")
    single = loose.join(equal, ["high", "low"]).select("text_a", "text_b", "first", F.col("first").alias("last"))
    covered = whole.unionByName(several).unionByName(single).groupBy("text_a", "text_b")
    covered = stored(covered.agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "covered")
    marked = spark.sparkContext.broadcast(_filter(covered.select(F.shiftrightunsigned("text_a", 64 - FILTER_BITS).alias("place"))))

    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def results(ids: pa.Array, texts: Iterator[bytes], runs_of: Callable[[int], list[tuple[int, int]]]) -> pa.RecordBatch:
        """What is left of texts without the runs of bytes that go."""
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for i, data in enumerate(texts):
            runs = runs_of(i)
            digest, at, left = hashlib.sha256(), 0, []
            for start, end in [*runs, (len(data), len(data))]:
                digest.update(data[at:start])
                if with_text:
                    left.append(data[at:start])
                at = end
            sizes.append(len(data))
            removed.append(sum(end - start for start, end in runs))
            spans.append(len(runs))
            digests.append(digest.hexdigest())
            kept.append(b"".join(left))
        columns = [ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.record_batch([*columns, pa.array(kept, pa.binary())] if with_text else columns, names=names)

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the texts, and which of them may have something to remove."""
        keys = np.array([_key(data) for data in _texts(batch.column(0))], np.int64).reshape(-1, 2)
        return keys, _in_filter(marked.value, _place(keys[:, 0].copy().view(np.uint64)))

    def to_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, may = keyed(batch)
            yield pa.record_batch([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["text", "doc_id", "text_a", "text_b"]).filter(pa.array(may))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.filter(pa.array(~keyed(batch)[1]))
            yield results(left.column(1), _texts(left.column(0)), lambda i: [])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column(1)

            def runs_of(i: int) -> list[tuple[int, int]]:
                if not ranges[i].is_valid:
                    return []
                flat = ranges[i].values
                return _spans(np.asarray(flat.field("first")), np.asarray(flat.field("last")), length)

            yield results(batch.column(2), _texts(batch.column(0)), runs_of)

    rows = docs.select(F.col("text").cast("string").alias("text"), "doc_id")
    with_ranges = rows.mapInArrow(to_cut, f"text string, doc_id {kind}, text_a long, text_b long").join(covered, ["text_a", "text_b"], "left")
    return with_ranges.select("text", "ranges", "doc_id").mapInArrow(cut, result).unionByName(rows.mapInArrow(untouched, result))
