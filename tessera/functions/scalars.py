"""Scalar expressions; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and increment of the 48-bit generator.
LCG_A, LCG_C, MASK48 = 0x5DEECE66D, 0xB, (1 << 48) - 1


def _times_mod48(x: Column, a: int) -> Column:
    """(x * a) mod 2^48 for 0 <= x < 2^48 without overflow: 24-bit halves."""
    m24 = (1 << 24) - 1
    x0, x1 = x.bitwiseAND(F.lit(m24)), F.shiftright(x, 24)
    a0, a1 = a & m24, (a >> 24) & m24
    cross = (x1 * F.lit(a0)).bitwiseAND(F.lit(m24)) + (x0 * F.lit(a1)).bitwiseAND(F.lit(m24))
    return (x0 * F.lit(a0) + F.shiftleft(cross.bitwiseAND(F.lit(m24)), 24)).bitwiseAND(F.lit(MASK48))


def lcg48(x: Column, rounds: int = 1) -> Column:
    for _ in range(rounds):
        x = (_times_mod48(x, LCG_A) + F.lit(LCG_C)).bitwiseAND(F.lit(MASK48))
    return x


def pow2_bucket(v: Column) -> Column:
    """Smallest k with v <= 2^k, by integers; null below 1."""
    return F.when(v >= 1, F.when(v == 1, 0).otherwise(F.length(F.conv((v - 1).cast("string"), 10, 2))).cast("long"))


def unit_bytes(text: Column) -> Column:
    """'4k', '2m', '1g' or a plain number as bytes."""
    n = F.regexp_extract(text, r"^(\d+)", 1).cast("long")
    unit = F.lower(F.regexp_extract(text, r"^\d+([kmgKMG]?)$", 1))
    return n * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1).cast("long")


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE 754 has it: by zero an infinity of the sign of both, or NaN for 0 / 0. Spark's own division raises there."""
    negative = b.cast("string").startswith("-")  # -0.0 too
    return F.when(b == 0, a * F.when(negative, float("-inf")).otherwise(float("inf"))).otherwise(F.try_divide(a, b))


def dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cell_index(p: Column, origin: float, width: float) -> Column:
    return F.floor((p - F.lit(origin)) / F.lit(width)).cast("long")


def linear_id(x: Column, y: Column, z: Column, ny: int, nz: int) -> Column:
    """Cell of a grid with a border of one on each side."""
    return (x * (ny + 2) + y) * (nz + 2) + z


def uts_child(parent_hex: Column, child: Column) -> Column:
    """SHA-1 of a node's 20 bytes and the big-endian number of its child, in hex."""
    return F.sha1(F.concat(F.unhex(parent_hex), F.unhex(F.lpad(F.hex(child.cast("long")), 8, "0"))))


def uts_has_children(node_hex: Column, q: float) -> Column:
    """Whether the last 31 bits, as a share of 2^31, are below q."""
    return F.conv(F.right(node_hex, F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)) / F.lit(float(1 << 31)) < F.lit(q)


def triangle_angles(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> list[Column]:
    """Degrees at a, b and c."""

    def side(x1, y1, x2, y2):
        return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))

    a, b, c = side(bx, by, cx, cy), side(ax, ay, cx, cy), side(ax, ay, bx, by)

    def at(o, p, q):
        cos = (p * p + q * q - o * o) / (2 * p * q)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    return [at(a, b, c), at(b, a, c), at(c, a, b)]


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def true_modulo(v: Column, n: int) -> Column:
    """0 to n - 1, of negative numbers too."""
    return F.pmod(v, F.lit(n))


def stride(step: int, size: int) -> Column:
    return F.lit(step * size)


def reverse_direction(d: Column) -> Column:
    """Of the six directions 0 to 5 that whose number adds up with it to 5."""
    return F.lit(5) - d


def product(factors: list[Column]) -> Column:
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out


def pulse(t: Column, middle: float, width: float, omega: float) -> tuple[Column, Column]:
    """Real and imaginary part of a Gaussian pulse: its size and its angle in time."""
    size = F.exp(-(t - middle) * (t - middle) / F.lit(width))
    return size * F.cos(F.lit(omega) * t), size * F.sin(F.lit(omega) * t)


def complex_divide(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(a + bi) / (c + di)"""
    size = c * c + d * d
    return (a * c + b * d) / size, (b * c - a * d) / size


def bilinear(c00: Column, c10: Column, c01: Column, c11: Column, dx: float, dy: float) -> Column:
    """The plane through four children, dx and dy from their middle in units of their spacing."""
    mx, my = ((c10 - c00) + (c11 - c01)) / 2, ((c01 - c00) + (c11 - c10)) / 2
    return (c00 + c10 + c01 + c11) / 4 + mx * F.lit(dx) + my * F.lit(dy)


def circumcentre(a: tuple, b: tuple, c: tuple) -> tuple[Column, Column]:
    sq = [p[0] * p[0] + p[1] * p[1] for p in (a, b, c)]
    d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    x = (sq[0] * (b[1] - c[1]) + sq[1] * (c[1] - a[1]) + sq[2] * (a[1] - b[1])) / d
    return x, (sq[0] * (c[0] - b[0]) + sq[1] * (a[0] - c[0]) + sq[2] * (b[0] - a[0])) / d


def in_circle(a: tuple, b: tuple, c: tuple, p: tuple) -> Column:
    ox, oy = circumcentre(a, b, c)
    return (p[0] - ox) * (p[0] - ox) + (p[1] - oy) * (p[1] - oy) < (a[0] - ox) * (a[0] - ox) + (a[1] - oy) * (a[1] - oy)


def common_cell(corners: str, width: int, n: int) -> Column:
    """The cell of an n x n grid that holds all corners (an array of x, y), else -1; corners beyond the last cell count to it."""
    cell = F.transform(corners, lambda p: clamp(F.floor(p["x"] / width), 0, n - 1) * n + clamp(F.floor(p["y"] / width), 0, n - 1))
    return F.when(F.array_size(F.array_distinct(cell)) == 1, F.get(cell, F.lit(0))).otherwise(F.lit(-1))
