"""SimHash near-duplicates, found through a vantage-point partition of the fingerprints.

Fingerprints are dealt out by a tree of vantage points: the Hamming distance to the
vantage decides which ring of the node a fingerprint belongs to. By the triangle bound
two fingerprints that differ in at most ``most_bits`` bits have distances that differ by
at most as much, so a fingerprint that close to its ring's lower edge is also sent to
the ring below; every linked pair then meets in some leaf. Within a leaf the same
bound, on the distance to the leaf's own vantage, leaves a window to compare exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from martwright.llm.common import blocks, components, dealt, forest, slices, stored

SEED = 42
# Words of a text are taken from pieces of about this many bytes.
PIECE = 1 << 22
_SPACE = re.compile(rb"[ \t-\r]")
RING = 8


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words, piece by piece; a piece ends at a space."""
    start = 0
    while start < len(data):
        end = _SPACE.search(data, start + PIECE) if len(data) - start > PIECE else None
        stop = end.end() if end else len(data)
        yield data[start:stop].split()
        start = stop


def simhash(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """64-bit fingerprint over word shingles, as an unsigned number; 0 without words."""
    data = (text or "").encode().lower()
    counts, total, carried = np.zeros(64, np.int64), 0, []
    for words in _pieces(data):
        words = carried + words
        if len(words) >= width:
            counts, total = _add(counts, total, words, width, seed)
        carried = words[-(width - 1) :] if width > 1 else []
    if not total and carried:
        counts, total = _add(counts, total, carried, len(carried), seed)
    bits = (2 * counts > total).astype(np.uint64)
    return int((bits << np.arange(63, -1, -1, dtype=np.uint64)).sum()) if total else 0


def _add(counts: np.ndarray, total: int, words: list[bytes], width: int, seed: int) -> tuple[np.ndarray, int]:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(joined[s:e], seed) for s, e in spans], dtype=">u8")
    for part in slices(len(hashes), 1 << 16):
        counts = counts + np.unpackbits(hashes[part].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts, total + len(hashes)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x.as_py(), width, seed) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, bits long")


def _near(bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits ^ other)


def grow(sample: np.ndarray, rows: int, leaf_rows: int, most_bits: int, seed: int = SEED, most_depth: int = 40) -> list[tuple[int, int, list[int]]]:
    """Partition tree as nodes (vantage, shift, children); a child below 0 is leaf ~child.

    Grown on a bounded sample, so that a leaf gets about ``leaf_rows`` of the rows. Of a
    few vantage points the one whose rings leave the fewest pairs is taken; a node that
    does not get smaller (a crowd of near copies) becomes a leaf.
    """
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    scale, rings = rows / max(1, len(sample)), (64 + RING) // RING + 1
    nodes.append((0, 0, []))
    work = [(0, sample, 0)]
    while work:
        at, points, depth = work.pop()
        best = None
        if len(points) * scale > leaf_rows and depth < most_depth:
            for vantage in rng.choice(points, 6):
                held = np.bincount(_near(points, vantage), minlength=65).astype(float)
                for shift in range(RING):
                    sums = np.zeros(rings)
                    distance = np.arange(65) + shift
                    np.add.at(sums, distance // RING, held)
                    edge = (distance % RING < most_bits) & (distance >= RING)
                    np.add.at(sums, distance[edge] // RING - 1, held[edge])
                    cost = float((sums**2).sum())
                    if best is None or cost < best[0]:
                        best = (cost, vantage, shift)
        if best is None or best[0] > 0.95 * len(points) ** 2:
            nodes[at] = (0, 0, [~leaves])
            leaves += 1
            continue
        _, vantage, shift = best
        distance = _near(points, vantage).astype(int) + shift
        children = []
        for ring in range(rings):
            inside = (distance // RING == ring) | ((distance // RING == ring + 1) & (distance % RING < most_bits))
            children.append(len(nodes))
            nodes.append((0, 0, []))
            work.append((children[-1], points[inside], depth + 1))
        nodes[at] = (int(vantage), shift, children)
    return nodes


def route(bits: np.ndarray, nodes: list[tuple[int, int, list[int]]], most_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the positions of the fingerprints that belong there."""
    work = [(0, np.arange(len(bits)))]
    while work:
        at, rows = work.pop()
        if not len(rows):
            continue
        vantage, shift, children = nodes[at]
        if len(children) == 1:
            yield ~children[0], rows
            continue
        distance = _near(bits[rows], np.uint64(vantage)).astype(int) + shift
        home, edge = distance // RING, distance % RING < most_bits
        for ring in np.unique(home):
            work.append((children[ring], rows[(home == ring) | ((home == ring + 1) & edge)]))
        lone = np.setdiff1d(np.unique(home[edge & (home > 0)]) - 1, home)
        for ring in lone:
            work.append((children[ring], rows[(home == ring + 1) & edge]))


def near_pairs(bits: np.ndarray, block: np.ndarray, cross: bool, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs at most ``most_bits`` apart, each pair once."""
    distance = _near(bits, bits[0])
    order = np.argsort(distance, kind="stable")
    sorted_bits, distance, block = bits[order], distance[order].astype(int), block[order]
    for part in slices(len(bits), 256):
        stop = int(np.searchsorted(distance, distance[part.stop - 1] + most_bits, side="right"))
        hit = _near(sorted_bits[part, None], sorted_bits[None, part.start : stop]) <= most_bits
        left, right = np.nonzero(np.triu(hit, 1))
        left, right = left + part.start, right + part.start
        if cross:
            apart = block[left] != block[right]
            left, right = left[apart], right[apart]
        if len(left):
            yield order[left], order[right]


def link(classes: DataFrame, most_bits: int = 3, leaf_rows: int = 32768, sample_rows: int = 65536) -> DataFrame:
    """Edges between fingerprint classes (bits, rep) that connect all links.

    Of the links of a leaf a spanning forest is returned, so the result grows with the
    rows. ``sample_rows`` bounds what the driver sees when the tree is grown. Leaves
    that hold more than ``leaf_rows`` are compared in block pairs.
    """
    spark, rows = classes.sparkSession, classes.count()
    sample = classes.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(sample_rows).collect()
    points = np.array([r["bits"] for r in sample], dtype=np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(grow(points, rows, leaf_rows, most_bits))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed, reps = (np.asarray(batch.column(i)) for i in (0, 1))
            for leaf, at in route(signed.view(np.uint64), tree.value, most_bits):
                yield pa.record_batch([pa.array(np.full(len(at), leaf, np.int32)), pa.array(signed[at]), pa.array(reps[at])], names=["leaf", "bits", "rep"])

    placed = stored(classes.select("bits", "rep").mapInArrow(deal, "leaf int, bits long, rep long"), "leaves")
    counts = placed.groupBy("leaf").agg(F.count("*").alias("rows"))
    pairs = placed.join(counts, "leaf").withColumn("pair", F.explode(blocks(F.xxhash64("bits"), F.col("rows"), leaf_rows)))
    pairs = pairs.select("leaf", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), F.col("pair.home").alias("home"), "bits", "rep")

    def search(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        reps, bits = part["rep"].to_numpy(), part["bits"].to_numpy().view(np.uint64)
        cross = part["i"].iloc[0] != part["j"].iloc[0]
        root = forest(len(reps), near_pairs(bits, part["home"].to_numpy(), cross, most_bits))
        tied = root != np.arange(len(reps))
        return pd.DataFrame({"vertex": reps[tied], "root": reps[root[tied]]})

    return dealt(pairs, "leaf", "i", "j").groupBy("leaf", "i", "j").applyInPandas(search, "vertex long, root long")


def simhash_groups(docs: DataFrame, width: int = 3, most_bits: int = 3, seed: int = SEED, leaf_rows: int = 32768) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Texts with equal fingerprints are one class and are compared once. Null and
    wordless texts have fingerprint zero and are linked like any other; documents
    with a null doc_id get a fingerprint but a null component unless others share
    it; repeated rows come back as often as they came; an empty table gives no rows;
    further columns of ``docs`` are not looked at. ``kept`` marks the smallest
    doc_id of each component.
    """
    prints = stored(fingerprints(docs, width, seed), "prints")
    classes = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    roots = components(link(classes, most_bits, leaf_rows)).select(F.col("vertex").alias("rep"), "root")
    found = classes.join(roots, "rep", "left").select("bits", F.coalesce("root", "rep").alias("component_id"))
    joined = prints.join(found, "bits", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def keep_first(docs: DataFrame, width: int = 3, most_bits: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with one row per group: that of the smallest doc_id (null last), columns unchanged.

    Rows are told apart by a number of their own, so repeated and null ids lose nothing
    but copies.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(f"c{docs.columns.index(name)}").alias(name) for name in ("doc_id", "text"))
    rows = stored(docs.toDF(*own).withColumn("_row", F.monotonically_increasing_id()), "documents")
    groups = simhash_groups(rows.select(F.col("_row").alias("doc_id"), text), width, most_bits, seed)
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", doc), "_row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row").select(*own).toDF(*docs.columns)
