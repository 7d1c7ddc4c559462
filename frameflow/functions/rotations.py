"""Rotations between axis-angle, quaternion (w x y z), 6-D, matrix and Euler angles, as column expressions.

Every conversion goes by way of the 3 x 3 matrix, an array of nine numbers by rows. Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The axis that each letter of an Euler order turns about.
AXES = {"r": 0, "p": 1, "y": 2}
SIZES = {"axis_angle": 3, "quaternion": 4, "rotation_6d": 6, "matrix": 9}
_EULER = "euler_angles_"
_TINY = 1e-9
_LOCKED = 1 - 1e-12  # sine of the middle angle from which the outer two turn about one axis

Term = Column | float  # a number that is known beforehand stays one, so that products with 0 and 1 vanish


def size_of(kind: str) -> int:
    """How many numbers a representation has; an error if there is none of that name."""
    order = kind.removeprefix(_EULER)
    if kind in SIZES:
        return SIZES[kind]
    if kind.startswith(_EULER) and sorted(order) == sorted(AXES):
        return 3
    raise ValueError(f"unknown rotation {kind!r}")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(a: Term, b: Term) -> Term:
    if isinstance(a, float) and isinstance(b, float):
        return a * b
    for x, y in ((a, b), (b, a)):
        if isinstance(x, float):
            return 0.0 if x == 0 else y if x == 1 else y * x
    return a * b


def _sum(terms: list[Term]) -> Term:
    known = sum(t for t in terms if isinstance(t, float))
    columns = [t for t in terms if not isinstance(t, float)]
    return reduce(lambda x, y: x + y, columns) + F.lit(known) if columns and known else reduce(lambda x, y: x + y, columns) if columns else known


def _product(a: list[list[Term]], b: list[list[Term]]) -> list[list[Term]]:
    return [[_sum([_times(a[i][k], b[k][j]) for k in range(3)]) for j in range(3)] for i in range(3)]


def _about(axis: int, angle: Column) -> list[list[Term]]:
    m: list[list[Term]] = [[float(i == j) for j in range(3)] for i in range(3)]
    i, j = (axis + 1) % 3, (axis + 2) % 3
    m[i][i] = m[j][j] = F.cos(angle)
    m[i][j], m[j][i] = -F.sin(angle), F.sin(angle)
    return m


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    return let(F.sqrt(_dot(v, v)), lambda n: F.transform(v, lambda x: x / n))


def _of_quaternion(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    one = F.lit(1.0)
    return F.array(
        one - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), one - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), one - 2 * (x * x + y * y),
    )


def to_matrix(v: Column, kind: str) -> Column:
    """The matrix of an array column; Euler orders are named like `euler_angles_rpy`, turns multiplied from the left."""
    size_of(kind)
    if kind == "matrix":
        return v
    if kind == "quaternion":
        return let(_unit(v), _of_quaternion)
    if kind == "axis_angle":
        share = lambda a: F.when(a > _TINY, F.sin(a / 2) / a).otherwise(0.5)
        return let(F.sqrt(_dot(v, v)), lambda a: let(F.concat(F.array(F.cos(a / 2)), F.transform(v, lambda x: x * share(a))), _of_quaternion))
    if kind == "rotation_6d":

        def rows(x: Column) -> Column:
            rest = F.slice(v, 4, 3)
            across = let(_dot(x, rest), lambda d: F.zip_with(rest, x, lambda b, a: b - d * a))
            return let(_unit(across), lambda y: F.concat(x, y, F.array(*(x[i] * y[j] - x[j] * y[i] for i, j in ((1, 2), (2, 0), (0, 1))))))

        return let(_unit(F.slice(v, 1, 3)), rows)
    m = reduce(_product, [_about(AXES[letter], v[k]) for k, letter in enumerate(kind.removeprefix(_EULER))])
    return F.array(*(x if isinstance(x, Column) else F.lit(x) for row in m for x in row))


def _to_quaternion(m: Column) -> Column:
    """From the largest of the four squares, as the others may vanish; w is not negative."""
    at = lambda i, j: m[3 * i + j]
    d, s, u = at(2, 1) - at(1, 2), at(0, 2) - at(2, 0), at(1, 0) - at(0, 1)
    p, q, r = at(1, 0) + at(0, 1), at(0, 2) + at(2, 0), at(2, 1) + at(1, 2)
    squares = F.array(*(F.lit(1.0) + a * at(0, 0) + b * at(1, 1) + c * at(2, 2) for a, b, c in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))))

    def by(t: Column) -> Column:
        rows = ((t[0], d, s, u), (d, t[1], p, q), (s, p, t[2], r), (u, q, r, t[3]))
        most = F.greatest(*(t[k] for k in range(4)))
        scaled = lambda k: F.transform(F.array(*rows[k]), lambda x: x / (2 * F.sqrt(most)))
        return F.when(t[0] == most, scaled(0)).when(t[1] == most, scaled(1)).when(t[2] == most, scaled(2)).otherwise(scaled(3))

    return let(let(squares, by), lambda x: F.transform(x, lambda y: F.when(x[0] < 0, -y).otherwise(y)))


def from_matrix(m: Column, kind: str) -> Column:
    size_of(kind)
    if kind == "matrix":
        return m
    if kind == "rotation_6d":
        return F.slice(m, 1, 6)
    if kind == "quaternion":
        return _to_quaternion(m)
    if kind == "axis_angle":

        def turned(q: Column) -> Column:
            axis = F.slice(q, 2, 3)
            return let(F.sqrt(_dot(axis, axis)), lambda n: let(F.when(n > _TINY, 2 * F.atan2(n, q[0]) / n).otherwise(2.0), lambda f: F.transform(axis, lambda x: x * f)))

        return let(_to_quaternion(m), turned)
    i, j, k = (AXES[c] for c in kind.removeprefix(_EULER))
    sign = 1.0 if (j - i) % 3 == 1 else -1.0
    at = lambda r, c: m[3 * r + c]
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), at(i, k) * sign))
    free = F.array(F.atan2(at(j, k) * -sign, at(k, k)), F.asin(sine), F.atan2(at(i, j) * -sign, at(i, i)))
    locked = F.array(F.atan2(at(k, j) * sign, at(j, j)), F.asin(sine), F.lit(0.0))  # the outer turns add up: all goes to the first
    return F.when(F.abs(sine) > _LOCKED, locked).otherwise(free)


def convert(v: Column, source: str, target: str) -> Column:
    """An array column of one representation as another; null stays null, as does one with a null among its numbers.

    Any other number of elements than the representation has is an error.
    """
    n = size_of(source)
    size_of(target)
    there = v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    fine = F.when(F.size(v) == n, v.cast("array<double>")).otherwise(F.raise_error(F.lit(f"a {source} has {n} numbers")).cast("array<double>"))
    return F.when(there, let(fine, lambda x: let(to_matrix(x, source), lambda m: from_matrix(m, target))))
