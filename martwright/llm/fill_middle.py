"""Fill-in-the-middle: prefix, middle and suffix of a text change places between markers.

A batch is one array of bytes. Where its pieces begin, a difference array notes by how
much the shift to the output changes; its running sum is the shift of every byte, one
scatter writes the whole output. Going back, the markers give the pieces, the same sums
give for every byte of the text where it lies, and one gather reads them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"
MARKS = ("<P>", "<S>", "<M>")
WIDTH = 3
# Texts taken at once, in bytes (a longer text comes alone), and bytes whose shifts are kept at once.
RUN = 1 << 24
WINDOW = 1 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned integers of 32 bits that hang on the document alone; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def windows(size: int) -> Iterator[tuple[int, int]]:
    return ((start, min(size, start + WINDOW)) for start in range(0, size, WINDOW))


def _starts(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Where code points begin."""
    return np.flatnonzero((data[low:high] & 0xC0) != 0x80) + low


def code_points_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each of the sorted byte positions."""
    found, seen = np.zeros(len(at), dtype=np.int64), 0
    for low, high in windows(len(data)):
        starts = _starts(data, low, high)
        first, last = np.searchsorted(at, (low, high))
        found[first:last] = seen + np.searchsorted(starts, at[first:last])
        seen += len(starts)
    found[np.searchsorted(at, len(data)) :] = seen
    return found


def byte_positions(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Byte at which each of the sorted code point numbers begins; the end for those beyond the last."""
    found, seen = np.full(len(wanted), len(data), dtype=np.int64), 0
    for low, high in windows(len(data)):
        starts = _starts(data, low, high)
        first, last = np.searchsorted(wanted, (seen, seen + len(starts)))
        found[first:last] = starts[wanted[first:last] - seen]
        seen += len(starts)
    return found


def displaced(size: int, begins: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Per window its positions and where each of them goes.

    ``begins`` are the sorted positions from which on a shift holds; of several at one
    position the last holds.
    """
    changes = np.diff(shifts, prepend=0)
    now = 0
    for low, high in windows(size):
        first, last = np.searchsorted(begins, (low, high))
        shift = np.zeros(high - low, dtype=np.int64)
        np.add.at(shift, begins[first:last] - low, changes[first:last])
        shift[0] += now
        np.cumsum(shift, out=shift)
        now = int(shift[-1])
        shift += np.arange(low, high)
        yield slice(low, high), shift


def scatter(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output bytes and offsets of a run of texts.

    ``cuts`` (texts x 2) are byte positions of the ends of prefix and middle, ``forms``
    the names of the forms.
    """
    begin, end = offsets[:-1], offsets[1:]
    moved = forms != PLAIN
    out_offsets = offsets + WIDTH * len(MARKS) * np.concatenate(([0], np.cumsum(moved)))
    base = (out_offsets - offsets)[:-1]
    prefix, middle, suffix = cuts[:, 0] - begin, cuts[:, 1] - cuts[:, 0], end - cuts[:, 1]
    psm, spm = forms == PSM, forms == SPM
    ahead = np.select([psm, spm], [WIDTH, 2 * WIDTH + suffix], 0)
    between = np.select([psm, spm], [3 * WIDTH + suffix, 3 * WIDTH + suffix], 0)
    behind = np.select([psm, spm], [2 * WIDTH - middle, WIDTH - prefix - middle], 0)
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    begins = np.stack([begin, cuts[:, 0], cuts[:, 1]], axis=1).ravel()
    shifts = np.stack([base + ahead, base + between, base + behind], axis=1).ravel()
    for here, there in displaced(len(data), begins, shifts):
        out[there] = data[here]
    start = out_offsets[:-1]
    places = {
        "<P>": np.select([psm, spm], [start, start + WIDTH + suffix], -1),
        "<S>": np.select([psm, spm], [start + WIDTH + prefix, start], -1),
        "<M>": np.where(moved, start + 2 * WIDTH + prefix + suffix, -1),
    }
    for mark, place in places.items():
        out[place[moved][:, None] + np.arange(WIDTH)] = np.frombuffer(mark.encode(), dtype=np.uint8)
    return out, out_offsets


def mark_positions(data: np.ndarray, mark: str) -> np.ndarray:
    """Where a marker stands in the bytes."""
    left, name, right = mark.encode()
    found = [
        np.flatnonzero((data[low : min(high, len(data) - 2)] == left) & (data[low + 1 : high + 1][: max(0, len(data) - 2 - low)] == name) & (data[low + 2 : high + 2] == right)) + low
        for low, high in windows(max(0, len(data) - 2))
    ]
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def gather(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a run of outputs, from the outputs and the names of their forms alone.

    No piece holds a marker, so the first one after the piece before it is the right one.
    """
    start, end = offsets[:-1], offsets[1:]
    moved, psm = forms != PLAIN, forms == PSM
    stands = {mark: mark_positions(data, mark) for mark in MARKS}

    def after(mark: str, position: np.ndarray) -> np.ndarray:
        at = np.append(stands[mark], len(data))
        return at[np.searchsorted(at, position)] if len(position) else position

    second = np.where(psm, after("<S>", np.minimum(start + WIDTH, len(data))), after("<P>", np.minimum(start + WIDTH, len(data))))
    third = after("<M>", np.minimum(second + WIDTH, len(data)))
    if (moved & (third + WIDTH > end)).any():
        raise ValueError("an output lacks a marker of its form")
    one, two, three = second - start - WIDTH, third - second - WIDTH, end - third - WIDTH
    prefix, suffix = np.where(psm, one, two), np.where(psm, two, one)
    out_offsets = offsets - WIDTH * len(MARKS) * np.concatenate(([0], np.cumsum(moved)))
    text = out_offsets[:-1]
    begins = np.stack([text, text + np.where(moved, prefix, 0), text + np.where(moved, prefix + three, 0)], axis=1)
    lies = np.stack([np.where(psm, start, second) + WIDTH, third + WIDTH, np.where(psm, second, start) + WIDTH], axis=1)
    shifts = np.where(moved[:, None], lies - begins, (start - text)[:, None])
    out = np.empty(int(out_offsets[-1]), dtype=np.uint8)
    for here, there in displaced(len(out), begins.ravel(), shifts.ravel()):
        out[here] = data[there]
    return out, out_offsets


def runs(offsets: np.ndarray) -> Iterator[slice]:
    """Rows of a batch in runs of at most RUN bytes, or one row."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN, side="right")) - 1)
        yield slice(first, last)
        first = last


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    return np.frombuffer(values, dtype=np.uint8) if values else np.empty(0, dtype=np.uint8), offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def _pieces(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes, counted from the run's first byte."""
    for batch in batches:
        data, offsets = texts_of(batch.column(column))
        for rows in runs(offsets):
            edges = offsets[rows.start : rows.stop + 1]
            yield batch.slice(rows.start, rows.stop - rows.start), data[edges[0] : edges[-1]], edges - edges[0]


def fill_in_middle(docs: DataFrame, seed: int = 1, moved_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output.

    Cuts fall between code points and hang on doc_id and length only. A text that holds
    a marker stays plain, as do ``100 - moved_percent`` of a hundred and empty texts. A null
    text is empty, a null doc_id draws as ''; equal rows give equal rows, an empty table
    none. Rows stay where they are read; further columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    one, two, three, four = draws(F.col("doc_id"), seed)
    form = F.when((text == "") | marked | (three % 100 >= moved_percent), PLAIN).when(four % 100 < spm_percent, SPM).otherwise(PSM)
    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), one.alias("one"), two.alias("two"))

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _pieces(batches, "text"):
            forms = rows.column("form").to_numpy(zero_copy_only=False)
            first = code_points_before(data, offsets)
            n = np.diff(first)
            drawn_cuts = np.stack([rows.column(c).to_numpy() % (n + 1) for c in ("one", "two")], axis=1)
            drawn_cuts.sort(axis=1)
            cuts = byte_positions(data, (first[:-1, None] + drawn_cuts).ravel()).reshape(-1, 2)
            output = strings(*scatter(data, offsets, cuts, forms))
            plain = forms == PLAIN
            prefix, middle = drawn_cuts[:, 0], drawn_cuts[:, 1] - drawn_cuts[:, 0]
            columns = [rows.column("doc_id"), pa.array(n), rows.column("form"), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return drawn.mapInArrow(move, SCHEMA)


def restore(moved: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """Adds the text rebuilt from an output and its form; takes the place of a column of that name."""
    kept = [c for c in moved.columns if c != name]
    found = moved.select(*kept).schema.add(name, "string")

    def back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _pieces(batches, output):
            text = strings(*gather(data, offsets, rows.column(form).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*rows.columns, text], [*kept, name])

    return moved.select(*kept).mapInArrow(back, found)


def fill_in_middle_digest(docs: DataFrame) -> DataFrame:
    """Digests of every output and of the text rebuilt from it."""
    both = restore(fill_in_middle(docs))
    return both.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """DuckDB statement for ``fill_in_middle_digest``."""
    draw = ", ".join(f"CAST(CAST('0x' || substr(digest, {8 * i + 1}, 8) AS UBIGINT) AS BIGINT) AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(body, '{mark}')" for mark in MARKS)
    return f"""
    WITH digests AS (
        SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
    drawn AS (SELECT doc_id, body, CAST(length(body) AS BIGINT) AS n, {draw} FROM digests),
    cut AS (
        SELECT doc_id, body, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN body = '' OR {marked} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
    pieces AS (
        SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1, n - b) AS suffix FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(body) AS restored_sha256
    FROM pieces"""
