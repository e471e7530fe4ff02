"""Boxes and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x1, y1, x2, y2 under a prefix."""
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; boxes that only touch have 0, as have two without area."""
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = (width * height).cast("double")
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def expand_box(b: Box, margin: Column | float) -> Box:
    """The box grown on each side by ``margin`` of its own size, rounded half to even."""
    margin = F.lit(margin) if isinstance(margin, (int, float)) else margin
    dx = F.bround((b[2] - b[0]) * margin, 0).cast("int")
    dy = F.bround((b[3] - b[1]) * margin, 0).cast("int")
    return b[0] - dx, b[1] - dy, b[2] + dx, b[3] + dy


def clamp_box(b: Box, width: Column, height: Column) -> Column:
    """The box within the frame as a struct; null where nothing is left."""
    x1, y1 = F.greatest(F.lit(0), b[0]), F.greatest(F.lit(0), b[1])
    x2, y2 = F.least(width, b[2]), F.least(height, b[3])
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def dot(a: str | Column, b: str | Column) -> Column:
    """The inner product of two arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: str | Column) -> Column:
    """The array divided by its length; a zero array stays as it is."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine_difference(a: str | Column, b: str | Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.lit(1.0) - F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def distances_to_box(px: Column, py: Column, d: Column) -> Box:
    """A box from an anchor point and its distances to the left, top, right and bottom edges."""
    return px - d[0], py - d[1], px + d[2], py + d[3]


def curve_points(values: str | Column, x: Column) -> Column:
    """A curve as ``x,y`` points of a drawing 1000 wide and 56 high, joined by blanks.

    The top stands for the larger of X + 2 and the curve's own largest value, rounded up; a curve of one value stands at 0.
    """
    top = F.greatest(x + 2, F.ceil(F.array_max(values))).cast("double")
    step = F.when(F.size(values) > 1, F.lit(1000.0) / (F.size(values) - 1)).otherwise(F.lit(0.0))
    return F.transform(values, lambda v, i: F.struct((i * step).alias("x"), (F.lit(56.0) - v / top * 56.0).alias("y")))


def laplacian_variance(pixels: str, width: str | Column) -> Column:
    """Variance of the 4-neighbour Laplacian of a grey picture, rows in one array; the border repeats mirrored; 0 of an empty one."""
    w = F.col(width) if isinstance(width, str) else width
    n = F.size(pixels)
    h = (n / w).cast("int")

    def mirrored(k: Column, size: Column) -> Column:
        return F.when(size == 1, F.lit(0)).when(k < 0, -k).when(k >= size, 2 * size - 2 - k).otherwise(k)

    def at(row: Column, column: Column) -> Column:
        return F.get(pixels, (mirrored(row, h) * w + mirrored(column, w)).cast("int")).cast("double")

    def response(k: Column) -> Column:
        row, column = F.floor(k / w).cast("int"), (k % w).cast("int")
        return at(row - 1, column) + at(row + 1, column) + at(row, column - 1) + at(row, column + 1) - 4 * at(row, column)

    values = F.transform(F.sequence(F.lit(0), n - 1), response)
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b")))
    return F.when(n > 0, sums["b"] / n - (sums["a"] / n) * (sums["a"] / n)).otherwise(F.lit(0.0))


def similarity_transform(source: str, target: str) -> Column:
    """(a, b, tx, ty) of the least-squares rotation, scale and shift of points onto others: x' = a x - b y + tx, y' = b x + a y + ty.

    Points are arrays of structs with x and y, as many in both; null where all source points coincide.
    """
    pairs = F.arrays_zip(F.col(source).alias("p"), F.col(target).alias("q"))
    names = ("px", "py", "qx", "qy", "pp", "dot", "cross")
    zero = F.struct(*(F.lit(0.0).alias(k) for k in names))

    def add(s: Column, v: Column) -> Column:
        p, q = v["p"], v["q"]
        terms = (p["x"], p["y"], q["x"], q["y"], p["x"] * p["x"] + p["y"] * p["y"], p["x"] * q["x"] + p["y"] * q["y"], p["x"] * q["y"] - p["y"] * q["x"])
        return F.struct(*((s[k] + t.cast("double")).alias(k) for k, t in zip(names, terms)))

    def solved(s: Column) -> Column:
        n = F.size(source)
        spread = s["pp"] - (s["px"] * s["px"] + s["py"] * s["py"]) / n
        a = (s["dot"] - (s["px"] * s["qx"] + s["py"] * s["qy"]) / n) / spread
        b = (s["cross"] - (s["px"] * s["qy"] - s["py"] * s["qx"]) / n) / spread
        tx, ty = (s["qx"] - a * s["px"] + b * s["py"]) / n, (s["qy"] - b * s["px"] - a * s["py"]) / n
        return F.when(spread > 0, F.struct(a.alias("a"), b.alias("b"), tx.alias("tx"), ty.alias("ty")))

    return F.aggregate(pairs, zero, add, solved)
