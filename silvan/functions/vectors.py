"""Vector functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def power_norm(v: Column, p: float = 0.5) -> Column:
    """sign(x) * |x|^p of each element."""
    return F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(p)))


def _scaled(v: Column, norm: Column) -> Column:
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def l1(v: Column) -> Column:
    """x / sum |x|; a zero vector stays as it is."""
    return _scaled(v, total(F.transform(v, F.abs)))


def l2(v: Column) -> Column:
    """x / sqrt(sum x^2); a zero vector stays as it is."""
    return _scaled(v, F.sqrt(total(F.transform(v, lambda x: x * x))))


def normalize(v: Column, kind: str) -> Column:
    """The norm by name; null for a zero vector, where the quotient is undefined."""
    if kind not in ("l1", "l2"):
        raise ValueError(f"unknown norm {kind!r}")
    out = l1(v) if kind == "l1" else l2(v)
    return F.when(total(F.transform(v, F.abs)) > 0, out)


def split_l1(v: Column, size: int) -> Column:
    """Each half of a vector of ``size`` elements normalised by itself."""
    half = size // 2
    return F.concat(l1(F.slice(v, 1, half)), l1(F.slice(v, half + 1, size - half)))


def displacements(v: Column) -> Column:
    """Differences of interleaved (x, y) points: element j+2 minus element j."""
    return F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda j: F.get(v, j + 2) - F.get(v, j))


def differences(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda j: F.get(v, j + 1) - F.get(v, j))


def points(v: Column) -> Column:
    """An interleaved vector as an array of (x, y) pairs."""
    return F.transform(F.sequence(F.lit(0), F.expr("0") + F.size(v) / 2 - 1), lambda j: F.array(F.get(v, 2 * j), F.get(v, 2 * j + 1)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller absolute value of each pair."""
    return total(F.zip_with(a, b, lambda x, y: F.least(F.abs(x), F.abs(y))))


def chi_square(a: Column, b: Column, gamma: float | None = None) -> Column:
    """Sum of (x - y)^2 / (x + y) on absolute values, denominators under 1e-7 taken as 1; exp(-gamma d) if asked."""

    def term(x, y):
        below = F.abs(x) + F.abs(y)
        return F.pow(F.abs(x) - F.abs(y), 2) / F.when(below < 1e-7, 1.0).otherwise(below)

    d = total(F.zip_with(a, b, term))
    return d if gamma is None else F.exp(-gamma * d)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def signed_sqrt(k: Column) -> Column:
    return F.signum(k) * F.sqrt(F.abs(k))


def rbf(distance: Column, median: Column) -> Column:
    """exp(-d^2 / (2 median)); a missing or zero median gives gamma 0, hence 1."""
    gamma = F.when(F.coalesce(median, F.lit(0.0)) > 0, 1 / (2 * median)).otherwise(0.0)
    return F.exp(-gamma * distance * distance)


def ancestors(path: Column) -> Column:
    """A heap-coded node and its ancestors up to the root 1; integer arithmetic only, so exact to 62 levels."""
    return F.transform(F.sequence(F.lit(0), F.length(F.bin(path)) - 1), lambda i: F.call_function("shiftright", path, i))


def parent(path: Column) -> Column:
    return F.shiftright(path, 1)


def parse_path(name: Column) -> Column:
    """A node name of 0s and 1s as its number."""
    return F.conv(name, 2, 10).cast("long")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue in 0..256; a hue of 1 or more wraps round."""
    sector = F.floor(h * 6)
    f = h * 6 - sector
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = F.pmod(sector, F.lit(6))
    picks = ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))
    out = []
    for channel in range(3):
        chosen = F.lit(None).cast("double")
        for n, pick in enumerate(picks):
            chosen = F.when(k == n, pick[channel]).otherwise(chosen)
        out.append(F.floor(chosen * 256).cast("int"))
    return out


def trajectory_channels(trj: Column, frame: Column, points: int = 15) -> dict[str, Column]:
    """x, y, v_x, v_y and t of interleaved positions that end at ``frame``; all but t leave out the first point."""
    later = F.sequence(F.lit(1), F.lit(points - 1))
    return {
        "x": F.transform(later, lambda i: F.get(trj, 2 * i)),
        "y": F.transform(later, lambda i: F.get(trj, 2 * i + 1)),
        "v_x": F.transform(later, lambda i: F.get(trj, 2 * i) - F.get(trj, 2 * i - 2)),
        "v_y": F.transform(later, lambda i: F.get(trj, 2 * i + 1) - F.get(trj, 2 * i - 1)),
        "t": F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (frame - F.lit(points - 1) + i).cast("double")),
    }
