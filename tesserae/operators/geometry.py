"""Operators on meshes: positions, faces and attributes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import linalg as la


def face_offsets(faces: DataFrame, order: str = "face", by: str = "mesh", width: int = 1 << 16) -> DataFrame:
    """Adds first: where a face's indices begin, the exclusive prefix sum of n in the order of a number.

    Sums go over stretches of `width` of the order first, so a mesh of very
    many faces spreads over many tasks.
    """
    rows = faces.withColumn("stretch", F.floor(F.col(order) / width))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "stretch").agg(F.sum("n").alias("sum"))
    begins = sums.select(by, "stretch", F.coalesce(F.sum("sum").over(before(Window.partitionBy(by).orderBy("stretch"))), F.lit(0)).alias("begin"))
    inside = F.coalesce(F.sum("n").over(before(Window.partitionBy(by, "stretch").orderBy(order))), F.lit(0))
    return rows.withColumn("inside", inside).join(begins, [by, "stretch"]).withColumn("first", F.col("begin") + F.col("inside")).drop("stretch", "inside", "begin")


def fan(indices: Column) -> Column:
    """Triangles (a, b, c) of a polygon's indices; none for fewer than three."""
    n = F.size(indices)
    at = lambda k: F.element_at(indices, k.cast("int"))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda k: F.struct(F.element_at(indices, F.lit(1)).alias("a"), at(k + 1).alias("b"), at(k + 2).alias("c")))
    return F.when(n >= 3, whole)


def gather(values: Column, indices: Column, missing: Column) -> Column:
    """values[i] for each index, missing where an index is out of range; values themselves without indices."""
    return F.when(indices.isNull(), values).otherwise(F.transform(indices, lambda i: F.coalesce(F.when(i >= 0, F.try_element_at(values, (i + 1).cast("int"))), missing)))


def face_normal(p0: Column, p1: Column, p2: Column) -> Column:
    """Normal of the first three corners; up (0, 1, 0) where one is missing."""
    known = p0.isNotNull() & p1.isNotNull() & p2.isNotNull()
    n = la.normalize(la.cross(la.sub(p1, p0), la.sub(p2, p0)))
    return F.when(known, n).otherwise(la.vec(F.lit(0), F.lit(1), F.lit(0)))


def triangle(a: Column, b: Column, c: Column) -> Column:
    """struct(area, min_x .. max_z, center_x .. center_z, box_area, longest_axis) of a triangle; box_area is the surface of its box, ties between axes go to the first."""
    n = la.cross(la.sub(b, a), la.sub(c, a))
    of = lambda f, x: f(a[x], b[x], c[x])
    dx, dy, dz = (of(F.greatest, x) - of(F.least, x) for x in "xyz")
    return F.struct(
        F.round(F.sqrt(la.dot(n, n)) / 2, 6).alias("area"),
        *(of(f, x).alias(f"{name}_{x}") for name, f in (("min", F.least), ("max", F.greatest)) for x in "xyz"),
        *(F.round((a[x] + b[x] + c[x]) / 3, 6).alias(f"center_{x}") for x in "xyz"),
        (2 * (dx * dy + dy * dz + dz * dx)).alias("box_area"),
        F.when((dx >= dy) & (dx >= dz), 0).when(dy >= dz, 1).otherwise(2).alias("longest_axis"),
    )


def bounds(df: DataFrame, by: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Smallest box of the points of each group; NaN and null coordinates don't count."""
    real = {c: F.when(~F.isnan(c), F.col(c)) for c in (x, y, z)}
    return df.groupBy(*by).agg(*(f(real[c]).alias(f"{name}_{axis}") for name, f in (("min", F.min), ("max", F.max)) for axis, c in zip("xyz", (x, y, z))))


def union_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Smallest box around boxes (min_x .. max_z); inverted and null ones don't count."""
    proper = boxes.filter("min_x <= max_x and min_y <= max_y and min_z <= max_z")
    return proper.groupBy(*by).agg(*(F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"), *(F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"))


def coincident(corners: DataFrame, degrees: float) -> DataFrame:
    """(mesh, cell, n, m, times): the normals m within an angle of n at the same rounded position, and how many corners have them.

    Equal normals at a position are first counted together, so the pairs
    that meet are pairs of different normals at one position. corners: mesh,
    p, n.
    """
    kinds = corners.groupBy("mesh", cell_of(F.col("p")).alias("cell"), "n").agg(F.count("*").alias("times"))
    other = kinds.select("mesh", "cell", F.col("n").alias("m"), "times")
    return kinds.drop("times").join(other, ["mesh", "cell"]).filter(la.dot(F.col("n"), F.col("m")) >= F.cos(F.radians(F.lit(degrees))))


def cell_of(p: Column) -> Column:
    """A position rounded to four digits, as whole numbers."""
    return F.struct(*(F.round(p[a] * 10000).cast("long").alias(a) for a in "xyz"))


def smooth_normals(corners: DataFrame, degrees: float) -> DataFrame:
    """For corners (mesh, corner, p, n): the mean of the normals at the same rounded position that are within an angle."""
    met = coincident(corners, degrees)
    total = met.groupBy("mesh", "cell", "n").agg(*(F.sum(F.col(f"m.{a}") * F.col("times")).alias(f"s{a}") for a in "xyz"), F.sum("times").alias("k"))
    mean = total.select("mesh", "cell", "n", la.normalize(la.vec(F.col("sx") / F.col("k"), F.col("sy") / F.col("k"), F.col("sz") / F.col("k"))).alias("smooth"))
    return corners.withColumn("cell", cell_of(F.col("p"))).join(mean, ["mesh", "cell", "n"], "left").select("mesh", "corner", F.coalesce("smooth", "n").alias("normal"))


def tuples(flat: Column, n: int) -> Column:
    """Array of the arrays of n consecutive numbers; what is left over is cut."""
    whole = F.floor(F.size(flat) / n).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda k: F.slice(flat, k * n + 1, n))).otherwise(F.array().cast("array<array<double>>"))


def expanded(flat: Column, n: int, indices: Column, missing: list[float]) -> Column:
    """Attribute values of n numbers each by index, `missing` where an index is out of range; all values in order if indices is null."""
    return gather(tuples(flat, n), indices, F.array(*map(F.lit, missing)))


def picked(values: Column, corners: list[Column], vertices: list[Column], missing: Column, by_vertex: bool = True) -> list[Column]:
    """A triangle's three values: by face corner if values reach its last, else (if by_vertex) by vertex if they reach its last, else missing. Null values are missing."""
    at = lambda k: F.try_element_at(values, (k + 1).cast("int"))
    n = F.coalesce(F.size(values), F.lit(0))
    own = lambda c, v: F.when(n > corners[2], at(c)).when((n > vertices[2]) & F.lit(by_vertex), F.coalesce(at(v), missing)).otherwise(missing)
    return [own(c, v) for c, v in zip(corners, vertices)]


def trim_curve(counts: Column, orders: Column, knots: Column, u: Column, i: Column) -> Column:
    """STRUCT<order, knots, u> of trim curve i (from 0): knots and vertices lie one curve after another, a curve of n vertices has n + order knots. Null if there is no such curve or its numbers run out."""
    n, order = F.try_element_at(counts, (i + 1).cast("int")), F.try_element_at(orders, (i + 1).cast("int"))
    before = lambda a: F.aggregate(F.slice(a, 1, F.greatest(i, F.lit(0)).cast("int")), F.lit(0), lambda s, x: s + x.cast("int"))
    first_u = before(counts)
    first_knot = first_u + before(orders)
    fits = (i >= 0) & (first_knot + n + order <= F.size(knots)) & (first_u + n <= F.size(u))
    return F.when(fits, F.struct(order.alias("order"), F.slice(knots, first_knot + 1, n + order).alias("knots"), F.slice(u, first_u + 1, n).alias("u")))


def curve_in_loop(loops: Column, loop: int, nth: Column) -> Column:
    """Number of the nth curve of a loop, where loops holds the number of curves of each."""
    return F.when(F.size(loops) > loop, F.aggregate(F.slice(loops, 1, loop), F.lit(0), lambda s, x: s + x.cast("int")) + nth)


def archive_bounds(samples: DataFrame, index: Column) -> DataFrame:
    """Box around the objects of an archive at a sample index: each one's own bounds (min_x .. max_z) at its sample, else those of its points.

    samples: object, idx, n (number of its samples), own (struct of min_x ..
    max_z or null), points (array of points). index may depend on n. Objects
    that have no such sample don't count; without any there is no row.
    """
    names = [f"{f}_{a}" for f in ("min", "max") for a in "xyz"]
    of = lambda f, a: (F.array_min if f == "min" else F.array_max)(F.transform("points", lambda p: p[a]))
    at = samples.filter(F.col("idx") == index)
    box = at.select(*(F.when(F.col("own").isNotNull(), F.col(f"own.{name}")).otherwise(of(*name.split("_"))).alias(name) for name in names))
    return union_boxes(box.withColumn("all", F.lit(1)), ["all"]).drop("all")


def cdf(pixels: DataFrame, height: int) -> DataFrame:
    """For luminance (y, x, lum) of an equirectangular image: conditional CDF within rows and marginal CDF of rows, weighted by the sine of the latitude."""
    w = F.col("lum") * F.sin(F.lit(3.141592653589793) * (F.col("y") + 0.5) / height)
    weighed = pixels.withColumn("w", w)
    row = Window.partitionBy("y")
    running = row.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = weighed.withColumn("row_sum", F.sum("w").over(row)).withColumn("conditional", F.when(F.col("row_sum") > 0, F.sum("w").over(running) / F.col("row_sum")).otherwise(0.0))
    rows = weighed.groupBy("y").agg(F.sum("w").alias("s"))  # a row for each line of the image
    upto = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marginal = rows.select("y", F.when(F.sum("s").over(every) > 0, F.sum("s").over(upto) / F.sum("s").over(every)).otherwise(0.0).alias("marginal"))
    return inside.join(marginal, "y").select("y", "x", "conditional", "marginal")
