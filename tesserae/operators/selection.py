"""Choosing samples by time: as-of joins of probe times with time-sampled properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import timesampling as ts


def floor_samples(samples: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """Adds floor_idx to probes (key, t, ...): the last sample at or before t, or 0 if there is none.

    samples: (key, idx, t), idx counting from 0 in the order of t. Rows are
    windowed by (key, t div width), with one carried index for each such
    bucket, so that a key with very many samples spreads over many tasks.
    Linear in the input; one shuffle of samples and probes together.
    """
    columns = [c for c in probes.columns if c not in ("key", "t")]
    bucket = F.floor(F.col("t") / width)
    packed = probes.select("key", "t", F.lit(None).cast("long").alias("idx"), F.struct(*columns).alias("probe"))
    both = samples.select("key", "t", F.col("idx").cast("long"), F.lit(None).cast(packed.schema["probe"].dataType).alias("probe")).unionByName(packed).withColumn("bucket", bucket)
    last = both.groupBy("key", "bucket").agg(F.max("idx").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("key", "bucket", F.max("last").over(before).alias("carried"))
    upto = Window.partitionBy("key", "bucket").orderBy("t", F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("own", F.max("idx").over(upto)).filter("probe is not null")
    return found.join(carried, ["key", "bucket"]).select("key", "t", "probe.*", F.coalesce("own", "carried", F.lit(0)).alias("floor_idx"))


def select_samples(samples: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """Adds to probes n, floor, ceil and nearest index, the bracket (lo, hi, alpha) and whether it needs interpolation.

    Keys without samples have n 0 and indices 0. Times must increase with
    idx within a key.
    """
    n = samples.groupBy("key").agg(F.count("*").alias("n"))
    at = floor_samples(samples, probes, width).join(n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # by key and index, so that no key's samples meet in one task
    here, following = (samples.select("key", (F.col("idx").cast("long") - back).alias("floor_idx"), F.col("t").cast("double").alias(name)) for back, name in ((0, "floor_t"), (1, "next_t")))
    at = at.join(here, ["key", "floor_idx"], "left").join(following, ["key", "floor_idx"], "left")
    t, n, lo, lo_t, hi_t = (F.col(c) for c in ("t", "n", "floor_idx", "floor_t", "next_t"))
    hi = F.when((n <= 1) | (lo >= n - 1), lo).otherwise(lo + 1)
    out = at.withColumns({"ceil_idx": ts.ceil_index(lo, lo_t, t, n), "near_idx": ts.near_index(lo, lo_t, hi_t, t, n), "hi_idx": hi, "alpha": F.coalesce(ts.alpha(lo, lo_t, hi_t, t.cast("double"), n), F.lit(0.0))})
    return out.withColumn("interpolates", ts.needs_interpolation(F.col("floor_idx"), F.col("hi_idx"), F.col("alpha")))


def changes(samples: DataFrame) -> DataFrame:
    """Adds changed: whether the value differs from that of the sample before; false for the first.

    idx counts from 0 without gaps. A sample meets the one before it by key
    and idx, so a key with very many samples spreads over many tasks.
    """
    before = samples.select("key", (F.col("idx") + 1).alias("idx"), F.col("value").alias("old"))
    changed = ~F.col("value").eqNullSafe(F.col("old")) & (F.col("idx") > 0)
    return samples.join(before, ["key", "idx"], "left").withColumn("changed", changed).drop("old")


def change_runs(samples: DataFrame) -> DataFrame:
    """For each key its n samples, first_changed and last_changed: the first and last idx whose value differs from the one before; 0 if none does."""
    at = F.when(F.col("changed"), F.col("idx"))
    return changes(samples).groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.min(at), F.lit(0)).alias("first_changed"), F.coalesce(F.max(at), F.lit(0)).alias("last_changed"))


def equivalent_samplings(samplings: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within.., ts_index, same_as): the smallest index of an equivalent sampling, among those that agree on the columns of within.

    Equal descriptors count once, as the smallest index; those that differ
    meet on kind and number of times, and on rounded numbers in eight grids,
    each number shifted by half a step or not.
    """
    descriptor = [*within, "kind", "tpc", "start", "times"]
    distinct = samplings.groupBy(descriptor).agg(F.min("ts_index").alias("ts_index"))
    numbers = [F.coalesce(x, F.lit(0.0)) for x in (F.col("tpc"), F.col("start"), F.try_element_at("times", F.lit(1)))]
    grid = lambda g: F.struct(F.lit(g).alias("g"), F.array(*(F.floor(x * 1e9 + (g >> k) % 2 / 2) for k, x in enumerate(numbers))).alias("at"))
    keyed = distinct.withColumn("cell", F.explode(F.array(*map(grid, range(8))))).withColumn("k", F.size("times"))
    a, b = (keyed.select(*within, "cell", "kind", "k", *(F.col(c).alias(f"{c}_{s}") for c in ("ts_index", "tpc", "start", "times"))) for s in "ab")
    met = a.join(b, [*within, "cell", "kind", "k"]).filter("ts_index_b <= ts_index_a")
    same = ts.equivalent(*(F.col(c) for c in ("kind", "tpc_a", "start_a", "times_a", "kind", "tpc_b", "start_b", "times_b")))
    named = met.filter(same).groupBy(*(F.col(c).alias(f"{c}_a") for c in (*within, "kind")), *(f"{c}_a" for c in ("tpc", "start", "times"))).agg(F.min("ts_index_b").alias("same_as"))
    alike = [F.col(c).eqNullSafe(F.col(f"{c}_a")) for c in descriptor]
    return samplings.join(named, alike).groupBy(*within, "ts_index").agg(F.min("same_as").alias("same_as"))
