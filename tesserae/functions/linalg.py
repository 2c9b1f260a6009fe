"""Vectors as STRUCT<x,y,z> and 4x4 matrices as ARRAY<DOUBLE> of 16, column by column (translation at 13 to 15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(a: Column, body) -> Column:
    """body of a, with a evaluated once however often body uses it."""
    return F.transform(F.array(a), body)[0]


def vec(x, y, z) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def normalize(a: Column) -> Column:
    """Length 1, or zero if a is zero."""

    def scaled(a):
        n = F.nullif(F.sqrt(dot(a, a)), F.lit(0.0))
        return vec(*(F.coalesce(c / n, F.lit(0.0)) for c in (a.x, a.y, a.z)))

    return let(a, scaled)


def matrix(*rows_of_columns) -> Column:
    return F.array(*(F.lit(float(v)) if isinstance(v, (int, float)) else v.cast("double") for v in rows_of_columns))


def identity() -> Column:
    return matrix(*(float(k % 5 == 0) for k in range(16)))


def translation(x: Column, y: Column, z: Column) -> Column:
    return matrix(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1)


def scaling(x: Column, y: Column, z: Column) -> Column:
    return matrix(x, 0, 0, 0, 0, y, 0, 0, 0, 0, z, 0, 0, 0, 0, 1)


def rotation(axis: str, degrees: Column) -> Column:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    if axis == "x":
        return matrix(1, 0, 0, 0, 0, c, s, 0, 0, -s, c, 0, 0, 0, 0, 1)
    if axis == "y":
        return matrix(c, 0, -s, 0, 0, 1, 0, 0, s, 0, c, 0, 0, 0, 0, 1)
    return matrix(c, s, 0, 0, -s, c, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)


def axis_rotation(x: Column, y: Column, z: Column, degrees: Column) -> Column:
    """About an axis of any length; the identity if the axis is (almost) zero."""
    n = F.sqrt(x * x + y * y + z * z)
    x, y, z = (v / F.nullif(n, F.lit(0.0)) for v in (x, y, z))
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    t = 1 - c
    turned = matrix(t * x * x + c, t * x * y + s * z, t * x * z - s * y, 0, t * x * y - s * z, t * y * y + c, t * y * z + s * x, 0, t * x * z + s * y, t * y * z - s * x, t * z * z + c, 0, 0, 0, 0, 1)
    return F.when(n * n > 0.0001, turned).otherwise(identity())


def matmul(a: Column, b: Column) -> Column:
    """a times b."""

    def product(ab):
        at = lambda m, col, row: F.element_at(ab[m], F.lit(4 * col + row + 1))
        return F.array(*(sum((at("a", k, row) * at("b", col, k) for k in range(1, 4)), at("a", 0, row) * at("b", col, 0)) for col in range(4) for row in range(4)))

    return let(F.struct(a.alias("a"), b.alias("b")), product)


def op_matrix(kind: Column, values: Column) -> Column:
    """Matrix of one transform operation: 0 scale, 1 translate, 2 rotate (axis, degrees), 3 matrix, 4 to 6 rotate about x, y, z."""
    v = lambda k: F.try_element_at(values, F.lit(k + 1))
    return (
        F.when(kind == 0, scaling(v(0), v(1), v(2)))
        .when(kind == 1, translation(v(0), v(1), v(2)))
        .when(kind == 2, axis_rotation(v(0), v(1), v(2), v(3)))
        .when(kind == 3, values)
        .when(kind == 4, rotation("x", v(0)))
        .when(kind == 5, rotation("y", v(0)))
        .when(kind == 6, rotation("z", v(0)))
        .otherwise(identity())
    )


def ops_matrix(ops: Column) -> Column:
    """Product, from the left, of an array of STRUCT<kind INT, values ARRAY<DOUBLE>>."""
    return F.aggregate(ops, identity(), lambda m, op: matmul(m, op_matrix(op["kind"], op["values"])))


def transform_point(m: Column, p: Column) -> Column:
    e = lambda k: F.element_at(m, F.lit(k + 1))
    return vec(e(0) * p.x + e(4) * p.y + e(8) * p.z + e(12), e(1) * p.x + e(5) * p.y + e(9) * p.z + e(13), e(2) * p.x + e(6) * p.y + e(10) * p.z + e(14))


def trs(m: Column) -> dict[str, Column]:
    """Translation, scale and Euler angles (XYZ, degrees) of a matrix without shear."""
    e = lambda row, col: F.element_at(m, F.lit(4 * row + col + 1))
    scale = [F.sqrt(e(r, 0) * e(r, 0) + e(r, 1) * e(r, 1) + e(r, 2) * e(r, 2)) for r in range(3)]
    by = [F.when(s > 1e-10, s).otherwise(1.0) for s in scale]
    n = lambda row, col: e(row, col) / by[row]
    free = F.abs(n(0, 2)) < 0.9999
    ry = F.when(free, F.asin(-F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n(0, 2))))).when(n(0, 2) < 0, F.lit(1.5707963267948966)).otherwise(F.lit(-1.5707963267948966))
    cos = F.cos(ry)
    rx = F.when(free, F.atan2(n(1, 2) / cos, n(2, 2) / cos)).when(n(0, 2) < 0, F.atan2(n(1, 0), n(1, 1))).otherwise(F.atan2(-n(1, 0), n(1, 1)))
    rz = F.when(free, F.atan2(n(0, 1) / cos, n(0, 0) / cos)).otherwise(0.0)
    names = {**dict(zip(("tx", "ty", "tz"), (e(3, 0), e(3, 1), e(3, 2)))), **dict(zip(("sx", "sy", "sz"), scale))}
    return names | dict(zip(("rx", "ry", "rz"), map(F.degrees, (rx, ry, rz))))


def quaternion(m: Column) -> Column:
    """STRUCT<x,y,z,w> of the rotation of a matrix without shear."""
    return let(m, _quaternion)


def _quaternion(m: Column) -> Column:
    e = lambda row, col: F.element_at(m, F.lit(4 * row + col + 1))
    scale = [F.sqrt(e(r, 0) * e(r, 0) + e(r, 1) * e(r, 1) + e(r, 2) * e(r, 2)) for r in range(3)]
    by = [F.when(s > 1e-10, s).otherwise(1.0) for s in scale]
    n = {(r, c): e(r, c) / by[r] for r in range(3) for c in range(3)}
    root = lambda *signs: F.sqrt(F.greatest(F.lit(0.0), 1 + sum(s * n[k, k] for k, s in enumerate(signs))))
    # the largest of the four components is found from the diagonal, the others from it
    q = lambda x, y, z, w: F.struct(x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))
    a, b, c = n[1, 2] - n[2, 1], n[2, 0] - n[0, 2], n[0, 1] - n[1, 0]
    u, v, w = n[1, 0] + n[0, 1], n[2, 0] + n[0, 2], n[2, 1] + n[1, 2]
    rw, rx, ry, rz = root(1, 1, 1), root(1, -1, -1), root(-1, 1, -1), root(-1, -1, 1)
    safe = lambda r: 2 * F.nullif(r, F.lit(0.0))
    return (
        F.when(n[0, 0] + n[1, 1] + n[2, 2] > 0, q(a / safe(rw), b / safe(rw), c / safe(rw), rw / 2))
        .when((n[0, 0] > n[1, 1]) & (n[0, 0] > n[2, 2]), q(rx / 2, u / safe(rx), v / safe(rx), a / safe(rx)))
        .when(n[1, 1] > n[2, 2], q(u / safe(ry), ry / 2, w / safe(ry), b / safe(ry)))
        .otherwise(q(v / safe(rz), w / safe(rz), rz / 2, c / safe(rz)))
    )


def corners(lo: Column, hi: Column) -> Column:
    """The eight corners of a box."""
    return F.array(*(vec(a.x, b.y, c.z) for a in (lo, hi) for b in (lo, hi) for c in (lo, hi)))


#: Kinds of transform operations by the upper four bits of their code, and how many values each takes. Fixed values.
OP_VALUES = (3, 3, 4, 16, 1, 1, 1)


def decode_ops(codes: Column, values: Column) -> Column:
    """ARRAY<STRUCT<kind, values>> of coded transform operations: each code takes its values in turn; it ends where they run out, and codes of no known kind take none and are left out."""
    kind = lambda c: F.shiftright(c, 4)
    takes = lambda c: F.coalesce(F.try_element_at(F.array(*map(F.lit, OP_VALUES)), kind(c) + 1), F.lit(0))
    op = "struct<kind:int,values:array<double>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("ended"), F.array().cast(f"array<{op}>").alias("ops"))

    def step(state, c):
        ended = state.ended | (state.at + takes(c) > F.size(values))
        taken = F.struct(kind(c).cast("int").alias("kind"), F.slice(values, state.at + 1, takes(c)).alias("values"))
        ops = F.when(ended | (kind(c) >= len(OP_VALUES)), state.ops).otherwise(F.concat(state.ops, F.array(taken.cast(op))))
        return F.struct(F.when(ended, state.at).otherwise(state.at + takes(c)).alias("at"), ended.alias("ended"), ops.alias("ops"))

    return F.aggregate(codes, start, step, lambda state: state.ops)


def film_back(ops: Column) -> Column:
    """Product, from the left, of film-back operations ARRAY<STRUCT<kind STRING, values ARRAY<DOUBLE>>> (translate, scale, matrix) as 9 numbers row by row."""
    number = lambda x: F.lit(float(x)) if isinstance(x, int) else x.cast("double")
    rows = lambda *v: F.array(*map(number, v))
    v = lambda op, k: F.try_element_at(op["values"], F.lit(k))
    one = lambda op: F.when(op["kind"] == "translate", rows(1, 0, v(op, 1), 0, 1, v(op, 2), 0, 0, 1)).when(op["kind"] == "scale", rows(v(op, 1), 0, 0, 0, v(op, 2), 0, 0, 0, 1)).otherwise(op["values"])

    def product(ab):
        at = lambda m, i, j: F.element_at(ab[m], F.lit(3 * i + j + 1))
        return F.array(*(at("a", i, 0) * at("b", 0, j) + at("a", i, 1) * at("b", 1, j) + at("a", i, 2) * at("b", 2, j) for i in range(3) for j in range(3)))

    return F.aggregate(ops, rows(1, 0, 0, 0, 1, 0, 0, 0, 1), lambda m, op: let(F.struct(m.alias("a"), one(op).alias("b")), product))


def transform_normal(m: Column, n: Column) -> Column:
    """A normal turned by the transposed inverse of the upper 3x3 of a matrix, of length 1; zero if that has no inverse."""

    def turned(mn):
        e = lambda col, row: F.element_at(mn["m"], F.lit(4 * col + row + 1))
        x, y, z = (vec(e(k, 0), e(k, 1), e(k, 2)) for k in range(3))
        parts = cross(y, z), cross(z, x), cross(x, y)
        det = F.nullif(dot(x, parts[0]), F.lit(0.0))
        of = lambda axis: sum((parts[k][axis] * mn["n"][c] for k, c in ((1, "y"), (2, "z"))), parts[0][axis] * mn["n"]["x"]) / det
        return normalize(vec(*(F.coalesce(of(axis), F.lit(0.0)) for axis in "xyz")))

    return let(F.struct(m.alias("m"), n.alias("n")), turned)
