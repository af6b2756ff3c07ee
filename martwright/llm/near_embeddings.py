"""Near-duplicate embeddings by counting collisions in sorted projections.

Unit vectors with cosine c are sqrt(2 - 2c) apart, and so is the standard deviation of
the difference of their Gaussian projections. Two vectors collide in a projection if one
lies in the window of ``WIDTH`` deviations around the other. Linked vectors collide in
almost all of ``PROJECTIONS`` projections; pairs that collide in fewer than the
calibrated number are dropped, the others are verified by their cosine.

Vectors of a label meet in cells: the first projections of a table cut the label into
cells wider than the window, and a vector within a window of its cell's lower edge
is also in the cell below. Several tables with other projections make up for the rare
pair that is apart in one of them. Crowded cells are compared in block pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from martwright.llm.common import blocks, components, dealt, forest, slices, stored

PROJECTIONS, WIDTH, LOSS = 24, 3.0, 1e-9
# The sorted window that a pair must share before collisions are counted, in deviations.
SORTED_WIDTH = 5.5
TABLES, MOST_SPLITS = 3, 6
# Cells are this many windows wide.
CELL = 4.0


def calibrated_count(projections: int = PROJECTIONS, width: float = WIDTH, loss: float = LOSS) -> int:
    """Largest number of collisions that a linked pair reaches but for a chance of ``loss``."""
    hit, lost = math.erf(width / math.sqrt(2)), 0.0
    for count in range(projections + 1):
        lost += math.comb(projections, count) * hit**count * (1 - hit) ** (projections - count)
        if lost > loss:
            return count
    return projections


def units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def axes(dims: int, seed: int) -> np.ndarray:
    """Projections of the cells of every table, then those that are counted."""
    return np.random.default_rng([seed, dims]).standard_normal((dims, TABLES * MOST_SPLITS + PROJECTIONS))


def cells(shadow: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell per projection, and whether the cell below is touched."""
    place = shadow / (CELL * window)
    home = np.floor(place)
    return home.astype(np.int64), (place - home) * CELL < 1


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _meet(home: np.ndarray, touches: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs share a cell."""
    step = home[left] - home[right]
    return ((step == 0) | ((step == 1) & touches[left]) | ((step == -1) & touches[right])).all(axis=1)


def _deal(batches: Iterator[pa.RecordBatch], window: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Every class in all its cells: table, splits, cell, rep, held, vector."""
    for batch in batches:
        rows = batch.to_pandas()
        for (dims, splits), part in rows.groupby([rows["vector"].map(len), "splits"], sort=True):
            shadow = units(_stack(part["vector"])) @ axes(dims, seed)
            for table in range(TABLES if splits else 1):
                home, touches = cells(shadow[:, table * MOST_SPLITS : table * MOST_SPLITS + splits], window)
                for below in range(1 << splits):
                    down = np.array([below >> s & 1 for s in range(splits)], dtype=np.int64)
                    at = np.flatnonzero((touches | (down == 0)).all(axis=1))
                    if not len(at):
                        continue
                    names = ["/".join(map(str, c)) for c in (home[at] - down).tolist()]
                    out = part.iloc[at].assign(tab=table, dims=dims, cell=names)
                    yield pa.RecordBatch.from_pandas(out[["label", "dims", "splits", "tab", "cell", "rep", "held", "vector"]], preserve_index=False)


def _pairs(unit: np.ndarray, counted: np.ndarray, window: float, reach: float, least: float, need: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs, in batches of index arrays."""
    order = np.argsort(counted[:, 0], kind="stable")
    sorted_by = counted[order]
    first = sorted_by[:, 0]
    half = PROJECTIONS // 2
    for part in slices(len(order), 128):
        stop = int(np.searchsorted(first, first[part.stop - 1] + reach, side="right"))
        hits = np.zeros((part.stop - part.start, stop - part.start), np.int8)
        for p in range(half):
            hits += np.abs(sorted_by[part, None, p] - sorted_by[None, part.start : stop, p]) <= window
        left, right = np.nonzero(np.triu(hits >= need - (PROJECTIONS - half), 1))
        for some in slices(len(left), 1 << 16):
            a, b = left[some], right[some]
            count = hits[a, b] + (np.abs(sorted_by[a + part.start, half:] - sorted_by[b + part.start, half:]) <= window).sum(axis=1)
            a, b = order[a[count >= need] + part.start], order[b[count >= need] + part.start]
            near = (unit[a] * unit[b]).sum(axis=1) >= least
            if near.any():
                yield a[near], b[near]


def _search(part: pd.DataFrame, least: float, window: float, seed: int) -> pd.DataFrame:
    """Links per class and a spanning forest of a block pair of a cell."""
    part = part.sort_values("rep", kind="stable")
    reps, held, home_block = (part[c].to_numpy() for c in ("rep", "held", "home"))
    table, splits, cross = int(part["tab"].iloc[0]), int(part["splits"].iloc[0]), part["i"].iloc[0] != part["j"].iloc[0]
    unit = units(_stack(part["vector"]))
    shadow = unit @ axes(unit.shape[1], seed)
    here = np.array([int(x) for x in part["cell"].iloc[0].split("/") if x], dtype=np.int64)
    placed = [cells(shadow[:, t * MOST_SPLITS : t * MOST_SPLITS + splits], window) for t in range(table + 1)]
    links = np.zeros(len(reps), np.int64)

    def own() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        counted = shadow[:, TABLES * MOST_SPLITS :]
        for a, b in _pairs(unit, counted, window, window / WIDTH * SORTED_WIDTH, least, calibrated_count()):
            # A pair counts where it meets first: in the first table, in its lowest cell.
            ours = (np.minimum(placed[table][0][a], placed[table][0][b]) == here).all(axis=1)
            for home, touches in placed[:table]:
                ours &= ~_meet(home, touches, a, b)
            if cross:
                ours &= home_block[a] != home_block[b]
            a, b = a[ours], b[ours]
            np.add.at(links, a, held[b])
            np.add.at(links, b, held[a])
            yield a, b

    root = forest(len(reps), own())
    linked = links > 0
    return pd.DataFrame({"vertex": reps[linked], "root": reps[root[linked]], "links": links[linked]})


def embedding_groups(vectors: DataFrame, least: float = 0.98, seed: int = 42, cell_rows: int = 2048) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label that are equal are one class and compared once; all of them
    count as links. A vector that is null, zero or not finite, one without a label, and
    one with another number of components links with nothing. Repeated rows count as
    other vectors; a null vec_id has a null component unless an equal vector has an id;
    an empty table gives no rows; further columns are not looked at.
    """
    window = WIDTH * math.sqrt(2 - 2 * least)
    rows = vectors.select("vec_id", "label", F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.col("embedding")).alias("vector"))
    fine = rows.where("vector is not null")
    classes = stored(fine.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("held")), "classes")
    splits = F.ceil(F.log2(F.col("rows") / F.lit(cell_rows)))
    sizes = classes.groupBy("label").agg(F.count("*").alias("rows")).select("label", F.least(F.greatest(splits, F.lit(0)), F.lit(MOST_SPLITS)).cast("int").alias("splits"))
    label = dict(classes.dtypes)["label"]
    kinds = f"label {label}, dims long, splits int, tab long, cell string, rep long, held long, vector {dict(classes.dtypes)['vector']}"
    placed = classes.where("rep is not null").join(sizes, "label").select("label", "splits", F.col("rep").cast("long"), "held", "vector")
    placed = stored(placed.mapInArrow(lambda batches: _deal(batches, window, seed), kinds), "cells")
    key = ["label", "dims", "tab", "cell"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
    pairs = placed.join(counts, key).withColumn("pair", F.explode(blocks(F.xxhash64("rep"), F.col("rows"), cell_rows)))
    pairs = pairs.select(*key, "splits", "rep", "held", "vector", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), F.col("pair.home").alias("home"))
    found = dealt(pairs, *key, "i", "j").groupBy(*key, "i", "j").applyInPandas(lambda part: _search(part, least, window, seed), "vertex long, root long, links long")
    found = stored(found, "links")
    links = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    roots = components(found.select("vertex", "root"))
    known = classes.join(links, F.col("rep") == F.col("vertex"), "left").drop("vertex").join(roots, F.col("rep") == F.col("vertex"), "left")
    known = known.select("label", "vector", (F.col("held") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    joined = rows.join(known, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def oracle(least: float = 0.98) -> str:
    """DuckDB statement for ``embedding_groups``: all pairs of a label, so for small tables."""
    return f"""
    WITH RECURSIVE fine AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= {least}),
    reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, links.y FROM reach JOIN links ON links.x = reach.r),
    roots AS (SELECT v, min(r) AS root FROM reach GROUP BY v)
    SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, root AS component_id, vec_id = root AS kept
    FROM embeddings JOIN roots ON v = vec_id"""
