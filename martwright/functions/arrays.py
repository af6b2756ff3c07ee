"""SQL text for steps over arrays inside one row."""

from __future__ import annotations

# Ways to combine what came before (a) with a number (x).
SUM, MOST, LAST_SEEN = "{a} + {x}", "greatest({a}, {x})", "CASE WHEN {x} >= 0 THEN {x} ELSE {a} END"


def let(name: str, value: str, body: str) -> str:
    """``body`` with a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(numbers: str, combine: str, start: str = "0") -> str:
    """What comes before each number of an array of ints, combined from ``start``.

    ``start`` must change nothing where it is combined. Appending copies an array, so the
    numbers are taken in pieces of about the root of their count: first whole pieces are
    combined, then the numbers inside them.
    """
    none = "cast(array() AS ARRAY<INT>)"
    width = "greatest(64, cast(ceil(sqrt(size(numbers))) AS INT))"
    chunks = f"transform(sequence(0, greatest(0, cast(floor((size(numbers) - 1) / {width}) AS INT))), i -> slice(numbers, i * {width} + 1, {width}))"

    def scan(values: str, first: str) -> str:
        step = combine.format(a="acc.at", x="x")
        return f"aggregate({values}, named_struct('at', {first}, 'out', {none}), (acc, x) -> named_struct('at', {step}, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"

    sums = f"transform(chunks, c -> aggregate(c, {start}, (acc, x) -> {combine.format(a='acc', x='x')}))"
    pieces = f"flatten(zip_with(chunks, {scan(sums, start)}, (chunk, first) -> {scan('chunk', 'first')}))"
    return let("numbers", numbers, let("chunks", chunks, pieces))
