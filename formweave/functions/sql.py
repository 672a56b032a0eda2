"""SQL text shared by the operators."""

from __future__ import annotations


def string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> str:
    """An array literal; also the empty one has its type."""
    return f"CAST(array({', '.join(map(string, values))}) AS ARRAY<STRING>)"


def x_overlap(a: str, b: str) -> str:
    """Inclusive overlap of two boxes along x."""
    return f"({a}.x0 <= {b}.x1 AND {b}.x0 <= {a}.x1)"


def y_overlap(a: str, b: str) -> str:
    """Inclusive overlap of two boxes along y."""
    return f"({a}.y0 <= {b}.y1 AND {b}.y0 <= {a}.y1)"


def center_distance(a: str, b: str) -> str:
    return f"abs(({a}.x0 + {a}.x1) / 2 - ({b}.x0 + {b}.x1) / 2)"


def aligned(k: str, v: str) -> str:
    """Whether a value row v stands under a header row k (arrays of boxes in reading order).

    Two walks over neighbours, each moving on past the box that ends first: no value may
    overlap two adjacent keys and no key two adjacent values; and no more than half of
    the values may lie outside of the keys' range.
    """

    def walk(i0: int, j0: int, clash: str) -> str:
        step = (
            f"CASE WHEN s.bad OR s.i >= size({k}) OR s.j >= size({v}) THEN s ELSE named_struct("
            f"'i', s.i + CASE WHEN {k}[s.i].x1 < {v}[s.j].x1 THEN 1 ELSE 0 END, 'j', s.j + CASE WHEN {k}[s.i].x1 < {v}[s.j].x1 THEN 0 ELSE 1 END, 'bad', {clash}) END"
        )
        return f"aggregate(sequence(1, size({k}) + size({v})), named_struct('i', {i0}, 'j', {j0}, 'bad', false), (s, t) -> {step}, s -> s.bad)"

    key, before = f"{k}[s.i]", f"{k}[s.i - 1]"
    value, left = f"{v}[s.j]", f"{v}[s.j - 1]"
    first = walk(1, 0, f"{x_overlap(value, key)} AND {x_overlap(value, before)}")
    second = walk(0, 1, f"{x_overlap(key, left)} AND {x_overlap(key, value)}")
    return f"(NOT {first} AND NOT {second} AND NOT ({outside(k, v)} * 2 > size({v})))"


def outside(k: str, v: str) -> str:
    """How many values lie wholly beside the range of the keys."""
    return f"size(filter({v}, b -> b.x0 > array_max(transform({k}, a -> a.x1)) OR b.x1 < array_min(transform({k}, a -> a.x0))))"
