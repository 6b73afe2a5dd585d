"""Boxes as SQL over structs with x, y, w, h: centres, overlaps, bands."""

from __future__ import annotations


def cx(b: str) -> str:
    return f"({b}.x + {b}.w / 2D)"


def cy(b: str) -> str:
    return f"({b}.y + {b}.h / 2D)"


def right(b: str) -> str:
    return f"({b}.x + {b}.w)"


def bottom(b: str) -> str:
    return f"({b}.y + {b}.h)"


def shared_x(a: str, b: str) -> str:
    """Common width, 0 if apart."""
    return f"greatest(least({right(a)}, {right(b)}) - greatest({a}.x, {b}.x), 0)"


def shared_y(a: str, b: str) -> str:
    return f"greatest(least({bottom(a)}, {bottom(b)}) - greatest({a}.y, {b}.y), 0)"


def shared(a: str, b: str) -> str:
    """Common area."""
    return f"({shared_x(a, b)} * {shared_y(a, b)})"


def overlap(a: str, b: str) -> str:
    """Common area as a share of a's."""
    return f"({shared(a, b)} / CAST(greatest({a}.w * {a}.h, 1) AS DOUBLE))"


def iou(a: str, b: str) -> str:
    return f"({shared(a, b)} / CAST(greatest({a}.w * {a}.h + {b}.w * {b}.h - {shared(a, b)}, 1) AS DOUBLE))"


def holds(box: str, x: str, y: str) -> str:
    return f"({x} BETWEEN {box}.x AND {right(box)} AND {y} BETWEEN {box}.y AND {bottom(box)})"


def normal_angle(a: str) -> str:
    """Into (-45, 45]."""
    return f"(CASE WHEN pmod({a}, 90) > 45 THEN pmod({a}, 90) - 90 ELSE pmod({a}, 90) END)"


def first(items: str) -> str:
    """The first element of an array, null if there is none."""
    return f"get({items}, 0)"


def nearest(items: str, key: str, number: str) -> str:
    """The element with the smallest key (SQL over e), the lower number at ties; null if there is none."""
    return f"array_min(transform({items}, e -> named_struct('k', {key}, 'no', e.{number}, 'e', e))).e"


def owner(cells: str, x: str, y: str) -> str:
    """The smallest cell that holds a point, the first at ties."""
    return nearest(f"filter({cells}, c -> {holds('c', x, y)})", "e.w * e.h", "cell_no")
