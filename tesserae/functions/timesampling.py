"""Time sampling as column expressions.

A sampling is described by the columns kind ('identity', 'uniform', 'cyclic',
'acyclic'), tpc (time per cycle), start and times (ARRAY<DOUBLE>). Indices
count from 0; n is the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def clamp_index(i: Column, n: Column) -> Column:
    return F.when((n > 0) & (i >= n), n - 1).otherwise(i)


def sample_time(kind: Column, tpc: Column, start: Column, times: Column, i: Column, n: Column) -> Column:
    """Time of sample i, which is clamped to the last; 0 for identity and where an acyclic sampling has no such time."""
    i = clamp_index(i, n)
    k = F.size(times)
    at = F.try_element_at(times, (i % F.when(k > 0, k) + 1).cast("int"))
    cyclic = F.coalesce(at + F.floor(i / F.when(k > 0, k)) * tpc, F.lit(0.0))
    acyclic = F.coalesce(F.try_element_at(times, (i + 1).cast("int")), F.lit(0.0))
    return F.when(kind == "uniform", start + i * tpc).when(kind == "cyclic", cyclic).when(kind == "acyclic", acyclic).otherwise(F.lit(0.0))


def uniform_floor(tpc: Column, start: Column, t: Column, n: Column) -> Column:
    """Closed form of the floor index: no join with the samples is needed."""
    return F.when((n == 0) | (t <= start), F.lit(0)).otherwise(F.least(F.floor((t - start) / tpc), n - 1)).cast("long")


def cyclic_floor(tpc: Column, times: Column, t: Column, n: Column) -> Column:
    """Floor index of a cyclic sampling with increasing times within [0, tpc): by cycle, then within it."""
    k = F.size(times)
    cycle = F.floor(t / tpc)
    within = F.size(F.filter(times, lambda x: x + cycle * tpc <= t))
    return F.when((n == 0) | (t < F.element_at(times, 1)), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(cycle * k + within - 1, n - 1))).cast("long")


def ceil_index(floor: Column, floor_time: Column, t: Column, n: Column) -> Column:
    return F.when((n == 0) | (floor_time >= t), floor).otherwise(F.least(floor + 1, n - 1))


def near_index(floor: Column, floor_time: Column, next_time: Column, t: Column, n: Column) -> Column:
    """The nearer of the floor and the next sample, ties to the floor."""
    last = (n == 0) | (floor >= n - 1)
    return F.when(last | (F.abs(t - floor_time) <= F.abs(next_time - t)), floor).otherwise(floor + 1)


def alpha(floor: Column, floor_time: Column, next_time: Column, t: Column, n: Column) -> Column:
    """Position of t between the floor and the next sample, in [0, 1]."""
    span = next_time - floor_time
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - floor_time) / F.nullif(span, F.lit(0.0))))
    return F.when((n <= 1) | (floor >= n - 1) | (F.abs(span) < EPS), F.lit(0.0)).otherwise(inside)


def needs_interpolation(floor: Column, ceil: Column, a: Column) -> Column:
    return (floor != ceil) & (a > EPS) & (a < 1 - EPS)


def increasing(times: Column) -> Column:
    """Each time exceeds the one before it."""
    n = F.size(times)
    return F.when(n <= 1, F.lit(True)).otherwise(F.forall(F.zip_with(F.slice(times, 1, F.greatest(n - 1, F.lit(1))), F.slice(times, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: b > a), lambda x: x))


def is_valid(kind: Column, tpc: Column, times: Column) -> Column:
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    ordered = (F.size(times) > 0) & F.forall(times, finite) & increasing(times)
    positive = (tpc > 0) & finite(tpc)
    within = F.forall(times, lambda x: (x >= 0) & (x < tpc))
    return F.when(kind == "identity", F.lit(True)).when(kind == "uniform", positive).when(kind == "cyclic", positive & ordered & within).otherwise(ordered)


def stored_index(i: Column, first: Column, last: Column) -> Column:
    """Index among the stored samples of logical sample i, where repeats before the first and after the last change are not stored."""
    return F.when((i < first) | ((first == 0) & (last == 0)), F.lit(0)).when(i >= last, last - first + 1).otherwise(i - first + 1).cast("long")


def is_constant(n: Column, first: Column, last: Column) -> Column:
    return (n <= 1) | ((first == 0) & (last == 0))


def frame_at_24(t: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(t * 24), n - 1)).cast("long")


def equivalent(kind_a, tpc_a, start_a, times_a, kind_b, tpc_b, start_b, times_b) -> Column:
    """Same kind, and all numbers within 1e-10."""
    close = lambda a, b: F.abs(a - b) < EPS
    lists = (F.size(times_a) == F.size(times_b)) & F.forall(F.zip_with(times_a, times_b, close), lambda x: F.coalesce(x, F.lit(False)))
    return (kind_a == kind_b) & F.when(kind_a == "uniform", close(tpc_a, tpc_b) & close(start_a, start_b)).when(kind_a == "cyclic", close(tpc_a, tpc_b) & lists).when(kind_a == "acyclic", lists).otherwise(F.lit(True))


def topology_variance(positions: Column, counts: Column, indices: Column) -> Column:
    """From the numbers of samples of positions and topology."""
    p, c, i = (F.coalesce(x, F.lit(1)) for x in (positions, counts, indices))
    return F.when(F.greatest(p, c, i) <= 1, "static").when((c <= 1) & (i <= 1), "homogeneous").otherwise("heterogeneous")
