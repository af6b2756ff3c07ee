"""Sampled segmentations of a text into vocabulary pieces, without replacement, and back.

The pieces of a text form a lattice: an edge is a piece, a path a segmentation, and its
probability the product of its pieces' weights. Gumbel top-k draws k different paths, as
if one after the other without replacement: every path has its log-probability plus
Gumbel noise, and the k largest win. They are found by an A* search over prefixes, best
first. The bound of a prefix is the largest perturbed value below it, drawn from the
mass of all its completions, which the lattice knows exactly; the siblings that a path
leaves behind get their bounds as Gumbel noise truncated at the bound of their parent.

A text is a sequence of units: a space (also the one implied at the start) and the
characters up to the next. No piece crosses a unit; a long one is cut further where no
piece that occurs in it crosses, and only there, so every segmentation stays possible.
The lattices of all units that occur are built once and shared. Characters outside the
vocabulary are spelled in byte pieces.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Characters from which a unit is cut if it can be, of a batch, and units that a process keeps.
UNIT, BATCH, KEPT = 256, 1 << 18, 200_000
# Characters of a long unit in which pieces are looked for at a time.
REACH = 1 << 18
# Stands for a space in a unit: no valid text has this code.
_SPACE, _SPACE_CODE = "\ud800", 0xD800
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id (None: not to be used), the first of 256 byte pieces, smoothing of the weights."""

    pieces: tuple[str | None, ...]
    first_byte: int
    sharpness: float = 1.0


def load(path: str = MODEL, sharpness: float = 1.0) -> Vocabulary:
    """Vocabulary of a model with byte pieces; pieces with an inner space are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: list[str | None] = []
    first_byte = -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) and first_byte < 0:
            first_byte = i
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        pieces.append(piece.replace("▁", _SPACE) if plain and "▁" not in piece[1:] else None)
    return Vocabulary(tuple(pieces), first_byte, sharpness)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


# Places tried at a time for a node's children.
_WINDOW = 1024


class Trie:
    """Pieces as a tree in arrays; weights fall with the rank of a piece."""

    def __init__(self, vocabulary: Vocabulary):
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(vocabulary.pieces):
            at = 0
            for code in map(ord, piece or ""):
                at = children.setdefault((at, code), len(children) + 1)
            if piece:
                ends[at] = number
        self._lay(children)
        # Node numbers follow from the places of the rows.
        ends = {self.number[node]: number for node, number in ends.items()}
        self.piece = np.full(len(self.parent), -1, np.int64)
        for node, number in ends.items():
            self.piece[node] = number
        count = len(vocabulary.pieces)
        self.weight = -vocabulary.sharpness * np.log(np.arange(count) + 2.0)
        self.byte_weight = -vocabulary.sharpness * np.log(count + 2.0)
        self.first_byte = vocabulary.first_byte
        self.bytes = [(p or "").replace(_SPACE, " ").encode() for p in vocabulary.pieces]
        for i in range(256):
            self.bytes[self.first_byte + i] = bytes([i])
        self.longest = max((len(p or "") for p in vocabulary.pieces), default=1)
        self.lengths = np.fromiter(map(len, self.bytes), np.int64, count)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _lay(self, children: dict[tuple[int, int], int]) -> None:
        """Lay the children of all nodes into one array: that by a character is at the node's base plus the rank of the character.

        Full rows go first, each to where all its places are free; common characters have low ranks.
        """
        common = collections.Counter(code for _, code in children)
        ranks = {code: n for n, (code, _) in enumerate(common.most_common())}
        # A character that no piece has gets the last rank, where no node has a child.
        self.rank = np.full(0x110000, len(ranks), np.int32)
        self.rank[list(ranks)] = list(ranks.values())
        rows: dict[int, list[tuple[int, int]]] = {}
        for (node, code), child in children.items():
            rows.setdefault(node, []).append((ranks[code], child))
        # Room for all rows, wherever they go: none starts further than a window behind the last place taken.
        free = np.ones(2 * len(children) + (len(ranks) + _WINDOW) * 2, bool)
        base, place = np.zeros(len(children) + 1, np.int64), np.zeros(len(children) + 1, np.int64)
        free[0] = False  # the root's own place
        low = 1
        for node, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            ranked = sorted(rank for rank, _ in row)
            at = max(low - ranked[0], 0)
            while True:
                if at + ranked[-1] + _WINDOW > len(free):
                    free = np.append(free, np.ones(len(free), bool))
                fits = free[at + ranked[0] : at + ranked[0] + _WINDOW].copy()
                for rank in ranked[1:]:
                    fits &= free[at + rank : at + rank + _WINDOW]
                first = int(fits.argmax())
                if fits[first]:
                    break
                at += _WINDOW
            base[node] = at + first
            for rank, child in row:
                place[child] = at + first + rank
                free[at + first + rank] = False
            low += int(free[low:].argmax())
        parent = np.full(int(place.max()) + 1, -1, np.int32)
        # What was laid out by the first numbers of the nodes is kept by their places.
        self.number = place.tolist()
        for node, row in rows.items():
            parent[place[[child for _, child in row]]] = place[node]
        self.parent = np.append(parent, np.full(len(ranks) + 1, -1, np.int32))
        self.base = np.zeros(len(self.parent), np.int32)
        self.base[place] = base

    def step(self, node: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (node, rank of a character) pairs have a child, and their children."""
        place = self.base[node] + rank
        found = np.flatnonzero(self.parent[place] == node)
        return found, place[found]

    def free_cuts(self, codes: np.ndarray) -> np.ndarray:
        """Positions inside a unit that no piece occurring in it crosses."""
        crossed = np.zeros(len(codes) + self.longest + 1, np.int64)
        ranks = self.rank[codes]
        for low in range(0, len(codes), REACH):
            at = np.arange(low, min(len(codes), low + REACH))
            ahead, state = at, np.zeros(len(at), np.int32)
            while len(at):
                alive, state = self.step(state, ranks[ahead])
                at, ahead = at[alive], ahead[alive] + 1
                whole = self.piece[state] >= 0
                np.add.at(crossed, at[whole] + 1, 1)
                np.add.at(crossed, ahead[whole], -1)
                more = ahead < len(codes)
                at, ahead, state = at[more], ahead[more], state[more]
        free = np.cumsum(crossed[: len(codes)]) == 0
        free[0] = False
        return np.flatnonzero(free)

    def cut(self, unit: str) -> list[str]:
        """A unit in parts of about ``UNIT`` characters, longer where it can not be cut."""
        if len(unit) <= UNIT:
            return [unit]
        free = self.free_cuts(_codes(unit))
        parts, start = [], 0
        while len(unit) - start > UNIT:
            place = int(np.searchsorted(free, start + UNIT, side="right"))
            end = int(free[place - 1]) if place and free[place - 1] > start else int(free[place]) if place < len(free) else len(unit)
            parts.append(unit[start:end])
            start = end
        return [*parts, unit[start:]] if start < len(unit) else parts

    def text(self, ids: np.ndarray) -> bytes:
        """Bytes of piece ids, the implied first space included."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


@functools.lru_cache(maxsize=2)
def trie_of(vocabulary: Vocabulary) -> Trie:
    return Trie(vocabulary)


def _spelled(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each of some characters has in UTF-8, and all these bytes."""
    codes = np.where(codes == _SPACE_CODE, 32, codes)
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return sizes, np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)


class Lattices:
    """Lattices of units: edges from the same node lie together, longest piece first, with their probabilities.

    A node is named by its first edge.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.trie = trie_of(vocabulary)
        # First edge of every node, and the end; of every unit, that of its start; of every edge, that of the node after it.
        self.room = {name: np.zeros(1, np.int32) for name in ("first", "root", "next", "piece")} | {"upto": np.zeros(0, np.float32), "log": np.zeros(0)}
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        for name, room in self.room.items():
            setattr(self, name, room[: name == "first"])

    def _append(self, name: str, values: np.ndarray) -> None:
        """Longer by some values; the array lies in one with room for as many again, which takes no memory before it is used."""
        old = getattr(self, name)
        size = len(old) + len(values)
        room = self.room[name]
        if len(room) < size:
            room = np.empty(2 * size, old.dtype)
            room[: len(old)] = old
            self.room[name] = room
        room[len(old) : size] = values
        setattr(self, name, room[:size])

    def look_up(self, units: list[str]) -> np.ndarray:
        """Numbers of distinct units; lattices of those not known yet are built."""
        numbers = np.fromiter(map(self.units.get, units, itertools.repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(numbers < 0)
        if len(self.units) + len(new) > KEPT and self.units:
            self.clear()
            new = np.arange(len(units))
        fresh, known = [units[n] for n in new.tolist()], len(self.units)
        numbers[new] = np.arange(known, known + len(fresh))
        self.units.update(zip(fresh, range(known, known + len(fresh))))
        for some in range(0, len(fresh), 20_000):
            self._add(fresh[some : some + 20_000])
        return numbers

    def _add(self, fresh: list[str]) -> None:
        """Lattices of new units, in the order of their numbers. Nodes are numbered by their distance to the end of the unit, then by length of the unit."""
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        order = np.argsort(-sizes, kind="stable")
        codes, sizes = _codes("".join(map(fresh.__getitem__, order.tolist()))), sizes[order]
        close = np.cumsum(sizes)
        held = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        level = np.append(0, np.cumsum(held))
        count = int(level[-1])
        back = np.repeat(np.arange(1, sizes[0] + 1), held)
        unit = np.arange(count) - level[back - 1]
        code = codes[close[unit] - back]
        # The node one character on; the end of every unit is the node after the last.
        following = np.where(back > 1, level[back - 2] + unit, count)
        found, at, state = [], np.arange(count), np.zeros(count, np.int32)
        ahead, rank = at, self.trie.rank[code]
        whole_char = np.zeros(count, bool)
        while len(at):
            alive, state = self.trie.step(state, rank[ahead])
            at, target = at[alive], following[ahead[alive]]
            number = self.trie.piece[state]
            whole = np.flatnonzero(number >= 0)
            if not found:
                whole_char[at[whole]] = True
                lone = np.flatnonzero(~whole_char)
                found.append((lone, following[lone], -1 - code[lone]))
            found.append((at[whole], target[whole], number[whole]))
            more = np.flatnonzero(target < count)
            at, ahead, state = at[more], target[more], state[more]
        edges = np.bincount(np.concatenate([f[0] for f in found]), minlength=count)
        first = np.append(0, np.cumsum(edges))
        total = int(first[-1])
        # From the back of every node's edges, as the pieces get longer: the longest comes first.
        free = first[1:] - 1
        target, piece = np.empty(total, np.int64), np.empty(total, np.int64)
        for node, to, number in found:
            place = free[node]
            target[place], piece[place] = to, number
            free[node] -= 1
        weight = self.trie.weight[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        weight[odd] = self.trie.byte_weight * _spelled(-1 - piece[odd])[0]
        # Mass of all completions of a node, one distance after the other.
        mass, log = np.zeros(count + 1), np.empty(total)
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            start, stop = int(first[a]), int(first[b])
            value = weight[start:stop] + mass[target[start:stop]]
            mass[a:b] = np.logaddexp.reduceat(value, first[a:b] - start)
            log[start:stop] = value
        log -= np.repeat(mass[:count], edges)
        upto = np.cumsum(np.exp(log))
        upto -= np.repeat(np.append(0.0, upto)[first[:-1]], edges)
        upto[first[1:] - 1] = np.inf
        before = len(self.next)
        root = np.empty(len(fresh), np.int64)
        root[order] = first[level[sizes - 1] + np.arange(len(fresh))] + before
        new = {"root": root, "first": first[1:] + before, "next": np.where(target == count, -1, first[target] + before)}
        for name, values in {**new, "piece": piece, "upto": upto, "log": log}.items():
            self._append(name, values)

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from every node: steps per path, and their edges one path after the other."""
        steps, active, edge = [], np.arange(len(nodes)), nodes.copy()
        counts = np.zeros(len(nodes), np.int64)
        while len(active):
            draw = _uniform(keys)
            wait = np.flatnonzero(draw >= self.upto[edge])
            while len(wait):
                ahead = edge[wait] + 1
                edge[wait] = ahead
                wait = wait[draw[wait] >= self.upto[ahead]]
            steps.append((active, edge))
            counts[active] += 1
            node = self.next[edge]
            on = np.flatnonzero(node >= 0)
            active, edge, keys = active[on], node[on], keys[on] + _GOLD
        start = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int32)
        for step, (active, edge) in enumerate(steps):
            flat[start[active] + step] = edge
        return counts, flat

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path; characters in bytes."""
        return self.spell_all([edges])[0]

    def spell_all(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of some paths, one after the other, and where each ends."""
        ids = self.piece[np.concatenate(paths)] if paths else np.zeros(0, np.int32)
        ends = np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths)))
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            sizes, spelled = _spelled(-1 - ids[odd])
            longer = np.append(0, np.cumsum(sizes - 1))
            ends = ends + longer[np.searchsorted(odd, ends)]
            copies = np.ones(len(ids), np.int64)
            copies[odd] = sizes
            ids = np.repeat(ids, copies)
            ids[ids < 0] = self.trie.first_byte + spelled
        return ids, ends


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1, one for each key."""
    return ((_mixed(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _key(row: int, *parts: int) -> np.uint64:
    """One scrambled number for a row and a purpose."""
    mask, key = 0xFFFFFFFFFFFFFFFF, row & 0xFFFFFFFFFFFFFFFF
    for part in parts:
        key = (key + int(_GOLD) * (part + 1)) & mask
        key = ((key ^ (key >> 30)) * 0xBF58476D1CE4E5B9) & mask
        key = ((key ^ (key >> 27)) * 0x94D049BB133111EB) & mask
        key ^= key >> 31
    return np.uint64(key)


# Gumbel noise made from 52-bit numbers is never larger.
_MOST_NOISE = 37.0


# Steps of a path whose siblings are looked at together.
_AHEAD = 128


@dataclass
class Path:
    """A segmentation: its edges, log-probability and score, and how it goes on from where it left another path.

    The steps before ``fresh`` belong to the other path, which looks after their siblings.
    From there on it has ``counts`` steps in unit ``unit`` and those after it; of the first
    of them also the log-probability before each, and the cost of leaving the path there:
    the bound on what the step left aside is minus the log of the sum of exp(cost) and
    exp(-score), so the least cost is the best bound. The other steps cannot be among the
    best of the search.
    """

    edges: np.ndarray
    fresh: int
    unit: int
    counts: np.ndarray
    before: np.ndarray
    cost: np.ndarray
    log_prob: float
    score: float

    def unit_of(self, step: int) -> int:
        """Unit in which one of the first steps lies; every unit has a step at least."""
        return self.unit + int(np.searchsorted(np.cumsum(self.counts[: step + 1]), step, side="right"))

    def best(self) -> tuple[float, int]:
        """Best bound and its step; minus infinity if nothing is left aside."""
        step = int(self.cost.argmin()) if len(self.cost) else 0
        if not len(self.cost) or self.cost[step] == np.inf:
            return -np.inf, 0
        return -float(np.logaddexp(-self.score, self.cost[step])), step


def _noise(keys: np.ndarray) -> np.ndarray:
    """Logarithms of exponential noise, one for each key."""
    return np.log(-np.log(_uniform(keys)))


def _costs(logs: np.ndarray, befores: list[np.ndarray], keys: np.ndarray, wanted: int) -> list[np.ndarray]:
    """Costs of leaving each of some paths at its first steps.

    ``logs`` are those of all steps, one path after the other, ``befores`` the
    log-probabilities before them and at the end. The bound of a step is the largest
    perturbed value among the siblings: noise on their mass, truncated at the path's score.
    A prefix only gets less likely with every step, so once it is too unlikely for the
    ``wanted`` best bounds the later steps are left out.
    """
    sizes = np.fromiter(map(len, befores), np.int64, len(befores)) - 1
    starts = np.cumsum(sizes) - sizes
    parts: list[list[np.ndarray]] = [[] for _ in befores]
    left, low = np.flatnonzero(sizes), 0
    while len(left):
        step = np.arange(low, low + _AHEAD)
        there = step < sizes[left, None]
        before = np.zeros((len(left), _AHEAD))
        beyond = np.empty(len(left))
        for n, path in enumerate(left.tolist()):
            own = befores[path][low : low + _AHEAD + 1]
            before[n, : len(own) - 1], beyond[n] = own[:-1], own[-1]
        with np.errstate(divide="ignore"):
            leave = np.log(-np.expm1(np.minimum(0.0, logs[np.minimum(starts[left, None] + step, len(logs) - 1)])))
            cost = np.where(there, _noise(keys[left, None] + _GOLD * step.astype(np.uint64)) - before - leave, np.inf)
        for n, path in enumerate(left.tolist()):
            parts[path].append(cost[n, : sizes[path] - low])
        low += _AHEAD
        on = np.flatnonzero(low < sizes[left])
        if len(on):
            # Only of paths with more steps is the bound looked at.
            least = np.array([np.sort(np.concatenate(parts[path]))[wanted - 1] if low >= wanted else np.inf for path in left[on].tolist()])
            on = on[-beyond[on] - _MOST_NOISE <= least]
        left = left[on]
    return [own[0] if len(own) == 1 else np.concatenate([np.zeros(0), *own]) for own in parts]


def draw(lattices: Lattices, rows: list[tuple[int, list[str]]], samples: int, seed: int = 42) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Distinct segmentations per row (key, units): edges, log-probability, score, log inclusion.

    The log inclusion is that of the probability, given the first value that did not make it,
    that the segmentation is among the drawn ones. Fewer than ``samples`` are returned
    where a text has fewer segmentations. Depends on nothing but row, units and seed.
    """
    place: dict[str, int] = {}
    places = [place.setdefault(u, len(place)) for _, units in rows for u in units]
    numbers = lattices.look_up(list(place))[places] if places else np.zeros(0, np.int64)
    return _drawn(lattices, [k for k, _ in rows], [len(units) for _, units in rows], numbers, samples, seed)


def _drawn(lattices: Lattices, rows: list[int], sizes: list[int], numbers: np.ndarray, samples: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """``draw`` from the numbers of all units, of which each row has ``sizes``."""
    offsets = np.cumsum([0, *sizes])
    roots = lattices.root[numbers]
    paths: list[list[Path]] = [[] for _ in rows]
    taken: list[dict[tuple[int, int], list[int]]] = [{} for _ in rows]
    # Of every row: unit to go on from, node inside the one before it, the steps before, and the score.
    scores = -_noise(np.array([_key(k, seed, 0) for k in rows], np.uint64))
    todo = [(i, at, None, np.zeros(0, np.int32), score) for i, (at, score) in enumerate(zip(offsets.tolist(), scores.tolist()))]
    for sample in range(samples if rows else 0):
        starts, units, spans = [], [], []
        for i, at, node, _, _ in todo:
            stop = int(offsets[i + 1])
            if node is not None:
                starts.append([node])
                units.append([np.uint64(1 << 62)])
            starts.append(roots[at:stop])
            units.append(np.arange(at - offsets[i], stop - offsets[i], dtype=np.uint64))
            spans.append(stop - at + (node is not None))
        bases = np.array([_key(rows[i], seed, 1, sample) for i, *_ in todo], np.uint64)
        counts, flat = lattices.walk(np.concatenate(starts), _mixed(np.repeat(bases, spans) + _GOLD * np.concatenate(units))) if todo else (np.zeros(0, np.int64),) * 2
        logs = lattices.log[flat]
        keys = np.array([_key(rows[i], seed, 2, sample) for i, *_ in todo], np.uint64)
        last = np.cumsum(spans, dtype=np.int64)
        ends = np.append(0, np.cumsum(counts))
        cuts = ends[np.append(0, last)].tolist()
        befores = []
        for (_, _, _, edges, _), low, high in zip(todo, cuts, cuts[1:]):
            # Added up from the first step on, so that equal steps have equal sums.
            before = np.zeros(len(edges) + high - low + 1)
            np.cumsum(np.concatenate([lattices.log[edges], logs[low:high]]) if len(edges) else logs[low:high], out=before[1:])
            befores.append(before[len(edges) :])
        costs = _costs(logs, befores, keys, samples + 1)
        for (i, at, node, edges, score), before, cost, low, high, end, span in zip(todo, befores, costs, cuts, cuts[1:], last.tolist(), spans):
            whole = np.append(edges, flat[low:high]) if len(edges) else flat[low:high]
            paths[i].append(Path(whole, len(edges), at - (node is not None), counts[end - span : end], before[: len(cost)], cost, float(before[-1]), score))
        if sample + 1 < samples:
            todo = [again for i, *_ in todo if (again := _branch(lattices, paths[i], taken[i], i, _key(rows[i], seed, 3, sample)))]
    results = []
    for i, own in enumerate(paths):
        paths[i] = []
        limit = max((p.best()[0] for p in own), default=-np.inf)
        out = []
        for path in own:
            gap = path.log_prob - limit
            inclusion = 0.0 if limit == -np.inf or gap > 30 else float(np.log(-np.expm1(-np.exp(gap)))) if gap > -30 else gap
            out.append((path.edges, path.log_prob, path.score, inclusion))
        results.append(out)
    return results


def _branch(lattices: Lattices, paths: list[Path], taken: dict[tuple[int, int], list[int]], row: int, key: np.uint64) -> tuple | None:
    """Take the best bound of the search: the path leaves an earlier one at that step for a sibling."""
    tops = [(p.best(), n) for n, p in enumerate(paths)]
    (score, step), number = max(tops, key=lambda x: (x[0][0], -x[1]))
    if score == -np.inf:
        return None
    path = paths[number]
    own = int(path.edges[path.fresh + step])
    used = taken.setdefault((number, step), [own])
    # The node is where the chosen edge starts: the last first edge at or before it.
    node = int(np.searchsorted(lattices.first, np.int32(own), side="right")) - 1
    choices = [e for e in range(int(lattices.first[node]), int(lattices.first[node + 1])) if e not in used]
    chances = np.exp(lattices.log[choices])
    draws = _uniform(key + _GOLD * np.arange(2, dtype=np.uint64))
    at = min(int(np.searchsorted(np.cumsum(chances), draws[0] * chances.sum(), side="right")), len(choices) - 1)
    edge = choices[at]
    used.append(edge)
    rest = float(np.concatenate([chances[:at], chances[at + 1 :]]).sum())
    if rest:
        # The others keep noise truncated at the value that was just taken.
        left = float(-np.logaddexp(-score, np.log(-np.log(draws[1])) - (path.before[step] + np.log(rest))))
        path.cost[step] = -left + np.log1p(-np.exp(min(left - path.score, -1e-300)))
    else:
        path.cost[step] = np.inf
    following = int(lattices.next[edge])
    return row, path.unit_of(step) + 1, following if following >= 0 else None, np.append(path.edges[: path.fresh + step], np.int32(edge)), score


def units_of(text: str | None, trie: Trie) -> list[str]:
    """Units of a text; an empty or null one has none."""
    if not text:
        return []
    units = (_SPACE + text.replace(" ", " " + _SPACE)).split(" ")
    if max(map(len, units)) > UNIT:
        units = [part for unit in units for part in trie.cut(unit)]
    return units


def _numbers(texts: pa.Array, lattices: Lattices) -> tuple[list[int], np.ndarray]:
    """Number of units of each text, and the units' numbers, one text after the other; as ``units_of`` for each."""
    full = pc.fill_null(pc.not_equal(texts, ""), False)
    words = pc.split_pattern(texts.filter(full), " ")
    full = full.to_numpy(zero_copy_only=False)
    sizes = np.zeros(len(full), np.int64)
    sizes[full] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    found = words.flatten().dictionary_encode()
    place = found.indices.to_numpy(zero_copy_only=False)
    units = [_SPACE + word for word in found.dictionary.to_numpy(zero_copy_only=False).tolist()]
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(found.dictionary), UNIT).to_numpy(zero_copy_only=False))
    if not len(long):
        return sizes.tolist(), lattices.look_up(units)[place]
    parts = [[unit] for unit in units]
    for n in long.tolist():
        parts[n] = lattices.trie.cut(units[n])
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    known: dict[str, int] = {}
    order = np.array([known.setdefault(part, len(known)) for own in parts for part in own])
    numbers, starts = lattices.look_up(list(known))[order], np.cumsum(counts) - counts
    ends = np.append(0, np.cumsum(counts[place]))
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], counts[place])
    return np.diff(ends[np.append(0, np.cumsum(sizes))]).tolist(), numbers[np.repeat(starts[place], counts[place]) + within]


def decode(ids: np.ndarray | list[int], table: list[bytes]) -> str:
    """Text of piece ids: the bytes of the pieces without the implied first space."""
    return b"".join(map(table.__getitem__, ids))[1:].decode()


def _row_key(doc: int | None) -> int:
    return -1 if doc is None else doc


def _encoded(batch: pa.RecordBatch, lattices: Lattices, samples: int, seed: int) -> Iterator[tuple[int, bytes | None, int, np.ndarray, float, float, float]]:
    """Rows of the result for a batch of (doc_id, text), in pieces of about ``BATCH`` characters; the text in UTF-8."""
    held = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) + 64)
    low = 0
    while low < batch.num_rows:
        high = min(batch.num_rows, int(np.searchsorted(held, (held[low - 1] if low else 0) + BATCH)) + 1)
        docs, texts = (column.slice(low, high - low) for column in batch.columns)
        docs, low = docs.to_pylist(), high
        found = _drawn(lattices, [_row_key(d) for d in docs], *_numbers(texts, lattices), samples, seed)
        ids, ends = lattices.spell_all([edges for own in found for edges, _, _, _ in own])
        start, stops = 0, iter(ends.tolist())
        for doc, text, own in zip(docs, texts.cast(pa.large_binary()).to_pylist(), found):
            for sample, (_, log_prob, score, inclusion) in enumerate(own, 1):
                stop = next(stops)
                yield doc, text, sample, ids[start:stop], log_prob, score, inclusion
                start = stop


def sample_encode(docs: DataFrame, samples: int = 2, path: str = MODEL, sharpness: float = 1.0, seed: int = 42, digest: bool = False) -> DataFrame:
    """Up to ``samples`` distinct segmentations per document, best perturbed value first.

    Columns doc_id, sample (from 1), n_pieces, log_prob, score (the perturbed value),
    log_inclusion, and ids; with ``digest`` also the MD5 of the ids and whether decoding
    them gives the text back. The draws depend on doc_id, text and seed only, so repeated rows
    give equal rows; a null doc_id is a key as any other. Null and empty texts have one
    segmentation without pieces; a text with fewer segmentations than asked for gives
    those; an empty table gives no rows; further columns are not looked at.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path, sharpness))
    kind = "n_pieces long, log_prob double, score double, log_inclusion double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a task, not of its process: other stages run there, and need the memory.
        lattices = Lattices(shared.value)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text, sample, ids, log_prob, score, inclusion in _encoded(batch, lattices, samples, seed):
                checked = (hashlib.md5(ids.astype("<i4")).hexdigest(), lattices.trie.text(ids)[1:] == (text or b"")) if digest else ()
                out.append((doc, sample, len(ids), log_prob, score, inclusion, ids, *checked))
                size += len(ids) * 4 + 64
                if size > 1 << 22:
                    yield _arrow(out, digest)
                    out, size = [], 0
            if out:
                yield _arrow(out, digest)
        del lattices
        pa.default_memory_pool().release_unused()

    layout = f"doc_id long, sample int, {kind}, ids array<int>" + ", ids_md5 string, decodes boolean" * digest
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, layout)


def _arrow(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "sample", "n_pieces", "log_prob", "score", "log_inclusion"]
    columns = list(zip(*rows))
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    starts = np.cumsum([0, *map(len, columns[6])]).astype(np.int32)
    arrays.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(columns[6]).astype(np.int32))))
    if digest:
        arrays += [pa.array(columns[7], pa.string()), pa.array(columns[8], pa.bool_())]
    return pa.record_batch(arrays, names=[*names, "ids", *(["ids_md5", "decodes"] if digest else [])])


def decode_table(rows: DataFrame, path: str = MODEL, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of their piece ids in column ``name``, in place of one of that name.

    Null ids have a null text, an empty list the empty one; ids outside the vocabulary are
    an error. Bytes that are no text become U+FFFD. An empty table stays empty; other
    columns come back as they are, whatever their names.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in rows.columns if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(shared.value)
        for batch in batches:
            found = [_text(trie, cell) for cell in batch.column(kept.index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*plain, "text"])

    # Plain names on the way: a column may have any name.
    plain = [f"c{i}" for i in range(len(kept))]
    held = rows.select(*[F.col(f"`{c}`") for c in kept]).toDF(*plain)
    return held.mapInArrow(run, StructType([*held.schema.fields, StructField("text", StringType())])).toDF(*kept, name)


def _text(trie: Trie, cell: pa.Scalar) -> str | None:
    if not cell.is_valid:
        return None
    numbers = np.asarray(cell.values, dtype=np.int64)
    if len(numbers) and not 0 <= numbers.min() <= numbers.max() < len(trie.lengths):
        raise ValueError("a piece id lies outside the vocabulary")
    return trie.text(numbers)[1:].decode("utf-8", "replace")
