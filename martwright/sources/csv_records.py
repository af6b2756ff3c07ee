"""CSV files cut into records side by side, quoted line breaks included, and their headers.

Whether a byte range starts inside a quoted field depends on all quotes before it. One
pass counts the quotes of every range, which also gives the first record of every file;
from the counts follows where each range stands. Then every task puts the lines of its
own range together to records, and hands on what belongs to records that begin or end in
another range. Quotes in quotes are doubled, so they leave the parity as it is.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FILE, RANGE = "file", "start"
_PLACE = f"{FILE} string, {RANGE} long"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file and the byte range they are read from, in the order of the file within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(RANGE))


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray]]:
    """Runs of lines of one range: its place, the lines, and whether each has an odd number of quotes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, files, starts = batch.columns
        odd = (np.asarray(pc.count_substring(lines, '"')) & 1).astype(bool)
        at, names = starts.to_numpy(), files.dictionary_encode()
        codes = names.indices.to_numpy()
        edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(codes) != 0)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            yield (names.dictionary[int(codes[low])].as_py(), int(at[low])), lines.slice(low, high - low), odd[low:high]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether its quotes are odd, and the first record of a file."""
    place: tuple[str, int] | None = None
    parity, first, closed = False, [], False

    def counted() -> pa.RecordBatch:
        header = "\n".join(first).removesuffix("\r").removeprefix("﻿") if place[1] == 0 else None
        columns = [pa.array([place[0]]), pa.array([place[1]], pa.int64()), pa.array([parity]), pa.array([header], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [FILE, RANGE, "odd", "header"])

    for here, lines, odd in _ranges(batches):
        if here != place:
            if place:
                yield counted()
            place, parity, first, closed = here, False, [], False
        for line, flips in zip(lines, odd) if here[1] == 0 and not closed else ():
            first.append(line.as_py())
            closed = closed ^ bool(flips) if len(first) > 1 else not flips
            if closed:
                break
        parity ^= bool(odd.sum() & 1)
    if place:
        yield counted()


def ranges_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per byte range: file, start, odd (its quotes), header (the first record, of a file's first range), opens_inside.

    One job over the lines, whatever the number of files; a line a range is left.
    """
    counted = _lines(spark, path).mapInArrow(_count, f"{_PLACE}, odd boolean, header string")
    before = F.sum(F.col("odd").cast("long")).over(Window.partitionBy(FILE).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("opens_inside", F.coalesce(before, F.lit(0)) % 2 == 1)


def columns_of(header: str) -> list[str]:
    """Column names of a header record."""
    return next(csv.reader([header], strict=False), [])


def _assembler(inside: dict[tuple[str, int], bool]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts lines together to records.

    A record whole in its range has no part; the end of one that began before has part
    0, or 1 if the range ends before it does, the beginning of one that goes on has part 2.
    """

    def batch_of(place: tuple[str, int], texts: pa.Array, part: int | None) -> pa.RecordBatch:
        count = len(texts)
        columns = [pa.array([place[0]] * count, pa.string()), pa.array([place[1]] * count, pa.int64()), pa.array([part] * count, pa.int32()), texts]
        return pa.RecordBatch.from_arrays(columns, [FILE, RANGE, "part", "text"])

    def joined(lines: list[pa.Array]) -> pa.Array:
        return pa.array(["\n".join(text for some in lines for text in some.to_pylist())], pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple[str, int] | None = None
        waiting: list[pa.Array] = []
        open_quote = ends_earlier = False

        def rest() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield batch_of(place, joined(waiting), 1 if ends_earlier else 2)

        for here, lines, odd in _ranges(batches):
            if here != place:
                yield from rest()
                if here not in inside:
                    raise ValueError(f"{here[0]} is read in other ranges than it was counted in")
                place, waiting, open_quote = here, [], inside[here]
                ends_earlier = open_quote
            after = (np.cumsum(odd) + open_quote) % 2 == 1
            begins = np.flatnonzero(~np.append(open_quote, after[:-1]))
            low = int(begins[0]) if len(begins) else len(lines)
            if open_quote:
                waiting.append(lines.slice(0, low))
                if low < len(lines) or not after[-1]:
                    yield batch_of(place, joined(waiting), 0 if ends_earlier else None)
                    waiting, ends_earlier = [], False
            open_quote = bool(after[-1])
            if not len(begins):
                continue
            high = int(begins[-1]) if open_quote else len(lines)
            if open_quote:
                waiting = [lines.slice(high)]
            starts = begins[begins < high] - low
            if len(starts) == high - low:
                yield batch_of(place, lines.slice(low, high - low).cast(pa.string()), None)
            elif len(starts):
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, high - low), pa.int32()), lines.slice(low, high - low).cast(pa.string()))
                yield batch_of(place, pc.binary_join(lists, "\n"), None)
        yield from rest()

    return run


def records_of(spark: SparkSession, path: str | list[str], ranges: DataFrame) -> DataFrame:
    """Records as text with their file; the first record of every file is its header.

    ``ranges`` comes from ``ranges_of`` over the same path. A row per byte range, some
    hundred thousand for 100 TB, goes to every task. Records over several ranges are put
    together from their parts, at most two a range, wherever a range is read.
    """
    inside = {(r[FILE], r[RANGE]): r["opens_inside"] for r in ranges.select(FILE, RANGE, "opens_inside").collect()}
    lines = _lines(spark, path).mapInArrow(_assembler(inside), f"{_PLACE}, part int, text string")
    whole = lines.where("part is null").select(FILE, RANGE, "text")
    # Parts of one record follow each other: a beginning opens it, all that follow belong to it.
    order = Window.partitionBy(FILE).orderBy(RANGE, F.when(F.col("part") == 2, 1).otherwise(0))
    parts = lines.where("part is not null").withColumn("record", F.sum((F.col("part") == 2).cast("long")).over(order))
    listed = parts.groupBy(FILE, "record").agg(F.array_sort(F.collect_list(F.struct(RANGE, F.when(F.col("part") == 2, 1).otherwise(0).alias("last"), "text"))).alias("parts"))
    across = listed.select(FILE, F.col("parts")[0][RANGE].alias(RANGE), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    texts = whole.unionByName(across).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    return texts.where(F.trim("text") != "")


def without_headers(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """Records without the header of each file: the one of a first range that reads like it, once."""
    headers = ranges.where(F.col("header").isNotNull()).select(FILE, "header")
    firsts = records.where(F.col(RANGE) == 0).join(headers, FILE)
    same = F.regexp_replace("text", "^﻿", "") == F.col("header")
    # A row that repeats the header stays: only one such record of a file goes.
    repeated = firsts.where(same).groupBy(FILE, RANGE, "text").agg((F.count("*") - 1).cast("int").alias("n"))
    kept = firsts.where(~same).select(FILE, RANGE, "text")
    again = repeated.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select(FILE, RANGE, "text")
    return records.where(F.col(RANGE) != 0).unionByName(kept).unionByName(again)
