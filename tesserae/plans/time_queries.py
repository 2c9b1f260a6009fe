"""Queries on time sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import timesampling as ts
from tesserae.operators import selection as sel
from tesserae.plans.bindings import PROBES, SAMPLES, probes, samples, table

QUERIES, ORACLES = {}, {}
DAY = 86_400_000_000


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("T1_sample_time_uniform", f"with {SAMPLES} select event_id, key * 0.5::double + least(idx + 2, 39) * (1.0::double / 24.0::double) as time from samples")
def sample_time_uniform(spark, sf):
    n = F.lit(40)
    return samples(spark, sf).select("event_id", ts.sample_time(F.lit("uniform"), F.lit(1.0) / F.lit(24.0), F.col("key") * 0.5, F.array().cast("array<double>"), F.col("idx") + 2, n).alias("time"))


@query("T1_sample_time_cyclic", f"with {SAMPLES} select event_id, [0.0, 0.25, 0.5][idx % 3 + 1]::double + (idx // 3)::double as time from samples")
def sample_time_cyclic(spark, sf):
    return samples(spark, sf).select("event_id", ts.sample_time(F.lit("cyclic"), F.lit(1.0), F.lit(0.0), F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5)), F.col("idx"), F.lit(1 << 40)).alias("time"))


@query("T1_sample_time_acyclic", f"with {SAMPLES} select event_id, [0.0, 0.5, 1.0, 2.0, 5.0][least(idx % 7, 4) + 1]::double as time from samples")
def sample_time_acyclic(spark, sf):
    times = F.array(*map(F.lit, (0.0, 0.5, 1.0, 2.0, 5.0)))
    return samples(spark, sf).select("event_id", ts.sample_time(F.lit("acyclic"), F.lit(0.0), F.lit(0.0), times, F.col("idx") % 7, F.lit(5)).alias("time"))


@query("T2_floor_uniform", f"with {SAMPLES}, {PROBES} select event_id, case when t <= 0 then 0 else least(t // 3600000000, 99) end::bigint as floor_idx from probes")
def floor_uniform(spark, sf):
    return probes(spark, sf).select("event_id", ts.uniform_floor(F.lit(3600000000.0), F.lit(0.0), F.col("t").cast("double"), F.lit(100)).alias("floor_idx"))


@query("T2_floor_cyclic", f"with {SAMPLES}, {PROBES} select event_id, (case when t < 0 then 0 else least(t // 1000000000 * 3 + case when t % 1000000000 >= 500000000 then 2 when t % 1000000000 >= 250000000 then 1 else 0 end, 4999) end)::bigint as floor_idx from probes")
def floor_cyclic(spark, sf):
    times = F.array(*map(F.lit, (0.0, 250000000.0, 500000000.0)))
    return probes(spark, sf).select("event_id", ts.cyclic_floor(F.lit(1000000000.0), times, F.col("t").cast("double"), F.lit(5000)).alias("floor_idx"))


SELECTED = f"""
with {SAMPLES}, {PROBES}, n as (select key, count(*) as n from samples group by key),
f as (select p.event_id, p.key, p.t, coalesce(s.idx, 0) as floor_idx, n.n from probes p asof left join samples s on p.key = s.key and p.t >= s.t join n on n.key = p.key),
g as (select f.*, a.t as floor_t, b.t as next_t from f join samples a on a.key = f.key and a.idx = f.floor_idx left join samples b on b.key = f.key and b.idx = f.floor_idx + 1)
"""


def selected(spark, sf):
    return sel.select_samples(samples(spark, sf).select("key", "idx", "t"), probes(spark, sf), DAY)


@query("T2_floor_index", SELECTED + "select event_id, floor_idx from g")
def floor_index(spark, sf):
    return sel.floor_samples(samples(spark, sf).select("key", "idx", "t"), probes(spark, sf), DAY).select("event_id", "floor_idx")


@query("T3_ceil_index", SELECTED + "select event_id, case when floor_t >= t then floor_idx else least(floor_idx + 1, n - 1) end as ceil_idx from g")
def ceil_index(spark, sf):
    return selected(spark, sf).select("event_id", "ceil_idx")


@query("T4_near_index", SELECTED + "select event_id, case when floor_idx >= n - 1 or abs(t - floor_t) <= abs(next_t - t) then floor_idx else floor_idx + 1 end as near_idx from g")
def near_index(spark, sf):
    return selected(spark, sf).select("event_id", "near_idx")


ALPHA = "case when floor_idx >= n - 1 then 0.0 else greatest(0.0, least(1.0, (t - floor_t)::double / (next_t - floor_t)::double)) end"


@query("T5_bracketing", SELECTED + f"select event_id, floor_idx as lo, case when floor_idx >= n - 1 then floor_idx else floor_idx + 1 end as hi, round({ALPHA}, 9) as alpha from g")
def bracketing(spark, sf):
    return selected(spark, sf).select("event_id", F.col("floor_idx").alias("lo"), F.col("hi_idx").alias("hi"), F.round("alpha", 9).alias("alpha"))


@query("T6_needs_interpolation", SELECTED + f"select event_id, floor_idx < n - 1 and {ALPHA} > 1e-10 and {ALPHA} < 1 - 1e-10 as interpolates from g")
def needs_interpolation(spark, sf):
    return selected(spark, sf).select("event_id", "interpolates")


@query("T7_time_range", f"with {SAMPLES} select key, min(t) as first_t, max(t) as last_t from samples group by key")
def time_range(spark, sf):
    return samples(spark, sf).groupBy("key").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("T8_validate", f"with {SAMPLES}, d as (select key, t - lag(t) over (partition by key order by idx) as step from samples) select key, coalesce(min(step) > 0, true) as valid from d group by key")
def validate(spark, sf):
    step = F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("idx"))
    return samples(spark, sf).withColumn("step", step).groupBy("key").agg(F.coalesce(F.min("step") > 0, F.lit(True)).alias("valid"))


@query("T8_validate_descriptors", "select p_partkey, case p_partkey % 4 when 0 then true when 1 then p_size % 5 > 0 when 2 then p_size % 5 > 0 and p_size % 3 > 0 and p_size % 3 < p_size % 5 else p_size % 3 > 0 end as valid from part")
def validate_descriptors(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("identity", "uniform", "cyclic", "acyclic"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    times = F.array(F.lit(0.0), (F.col("p_size") % 3).cast("double"))
    return table(spark, sf, "part").select("p_partkey", ts.is_valid(kind, (F.col("p_size") % 5).cast("double"), times).alias("valid"))


@query("T9_ts_equivalence", "with u as (select distinct user_id from events), d as (select user_id as ts_index, user_id % 5 + 1 as a, user_id % 3 as b from u) select x.ts_index, min(y.ts_index) as same_as from d x join d y on x.a = y.a and x.b = y.b and y.ts_index <= x.ts_index group by 1")
def ts_equivalence(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("ts_index")).distinct()
    d = u.select("ts_index", F.lit("uniform").alias("kind"), ((F.col("ts_index") % 5 + 1) / 24.0).alias("tpc"), (F.col("ts_index") % 3).cast("double").alias("start"), F.array().cast("array<double>").alias("times"))
    return sel.equivalent_samplings(d)


@query("T10_sample_selector", SELECTED + "select event_id, case event_id % 4 when 0 then least(event_id, n - 1) when 1 then floor_idx when 2 then case when floor_t >= t then floor_idx else least(floor_idx + 1, n - 1) end else case when floor_idx >= n - 1 or abs(t - floor_t) <= abs(next_t - t) then floor_idx else floor_idx + 1 end end as idx from g")
def sample_selector(spark, sf):
    way = F.col("event_id") % 4
    idx = F.when(way == 0, ts.clamp_index(F.col("event_id"), F.col("n"))).when(way == 1, F.col("floor_idx")).when(way == 2, F.col("ceil_idx")).otherwise(F.col("near_idx"))
    return selected(spark, sf).select("event_id", idx.alias("idx"))


@query("T11_stored_index", f"with {SAMPLES} select event_id, case when idx < key % 4 or (key % 4 = 0 and key % 4 + key % 3 = 0) then 0 when idx >= key % 4 + key % 3 then key % 3 + 1 else idx - key % 4 + 1 end::bigint as stored from samples")
def stored_index(spark, sf):
    first = F.col("key") % 4
    return samples(spark, sf).select("event_id", ts.stored_index(F.col("idx"), first, first + F.col("key") % 3).alias("stored"))


RUNS = f"""
with {SAMPLES}, c as (select key, idx, idx > 0 and event_type is distinct from lag(event_type) over (partition by key order by idx) as changed from samples),
r as (select key, count(*) as n, coalesce(min(idx) filter (changed), 0) as first_changed, coalesce(max(idx) filter (changed), 0) as last_changed from c group by key)
"""


def runs(spark, sf):
    return sel.change_runs(samples(spark, sf).select("key", "idx", F.col("event_type").alias("value")))


@query("T12_change_runs", RUNS + "select * from r")
def change_runs(spark, sf):
    return runs(spark, sf)


@query("T13_constant", RUNS + "select key, n <= 1 or (first_changed = 0 and last_changed = 0) as constant from r")
def constant(spark, sf):
    return runs(spark, sf).select("key", ts.is_constant(F.col("n"), F.col("first_changed"), F.col("last_changed")).alias("constant"))


@query("T14_max_samples", RUNS + "select key % 5 as ts_index, max(case when n <= 1 or (first_changed = 0 and last_changed = 0) then 1 else n end) as max_samples from r group by 1")
def max_samples(spark, sf):
    r = runs(spark, sf)
    n = F.when(ts.is_constant(F.col("n"), F.col("first_changed"), F.col("last_changed")), F.lit(1)).otherwise(F.col("n"))
    return r.groupBy((F.col("key") % 5).alias("ts_index")).agg(F.max(n).alias("max_samples"))


COUNTS = "with c as (select l_orderkey as path, count(*) as p, count(distinct l_returnflag) as c, count(distinct l_linestatus) as i from lineitem group by 1) "


def sample_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.count("*").alias("p"), F.count_distinct("l_returnflag").alias("c"), F.count_distinct("l_linestatus").alias("i"))


@query("T15_samples_per_object", COUNTS + "select path, case path % 3 when 0 then p when 1 then greatest(c, i) else greatest(p, i) end as n from c")
def samples_per_object(spark, sf):
    kind = F.col("path") % 3
    return sample_counts(spark, sf).select("path", F.when(kind == 0, F.col("p")).when(kind == 1, F.greatest("c", "i")).otherwise(F.greatest("p", "i")).alias("n"))


@query("T16_topology_variance", COUNTS + "select path, case when greatest(p, c, i) <= 1 then 'static' when c <= 1 and i <= 1 then 'homogeneous' else 'heterogeneous' end as variance from c")
def topology_variance(spark, sf):
    return sample_counts(spark, sf).select("path", ts.topology_variance(F.col("p"), F.col("c"), F.col("i")).alias("variance"))


@query("T17_frame_24", f"with {SAMPLES}, {PROBES} select event_id, greatest(0, least(floor(t::double / 1e6 * 24), 1000000))::bigint as frame from probes")
def frame_24(spark, sf):
    return probes(spark, sf).select("event_id", ts.frame_at_24(F.col("t").cast("double") / 1e6, F.lit(1000001)).alias("frame"))


@query("T18_primary_ts", "select user_id as key, arg_min(event_id % 7, (case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end, event_id)) as ts_index from events group by 1")
def primary_ts(spark, sf):
    place = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.min_by(F.col("event_id") % 7, F.struct(place, F.col("event_id"))).alias("ts_index"))


@query("O3_latest", "select user_id, arg_max(event_id, (ts, event_id)) as event_id from events group by 1")
def latest(spark, sf):
    from tesserae.operators.content import latest as last

    return last(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("J3_ts_remap", "with m as (select distinct user_id % 10 as src, user_id % 10 + 100 as dst from events where user_id % 10 < 6) select event_id, coalesce(dst, user_id % 10) as ts_index from events left join m on src = user_id % 10")
def ts_remap(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("src"))
    m = e.filter("src < 6").select("src", (F.col("src") + 100).alias("dst")).distinct()
    return e.join(m, "src", "left").select("event_id", F.coalesce("dst", "src").alias("ts_index"))


@query("A12_is_animated", "select l_orderkey % 100 as archive, bool_or(n > 1) as animated from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def is_animated(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy((F.col("l_orderkey") % 100).alias("archive")).agg(F.bool_or(F.col("n") > 1).alias("animated"))


# names under which the queries at the times of all events were first registered
for _name in [n for n, sql in ORACLES.items() if PROBES in sql]:
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]
