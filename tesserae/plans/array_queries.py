"""Queries on arrays, geometry, text and content keys."""


from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import linalg as la
from tesserae.functions import text
from tesserae.functions.hashing import sample_digest
from tesserae.operators import content
from tesserae.operators import geometry as geo
from tesserae.plans.bindings import CORNERS, corners, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


E = "embedding[{}]::double"


def point(k=0):
    e = lambda i: F.element_at("embedding", F.lit(3 * k + i + 1)).cast("double")
    return la.vec(e(0), e(1), e(2))


@query("P1_property_names", "select c_mktsegment as object, count(*) as n, min(c_name) as first_name from customer group by 1")
def property_names(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("object")).agg(F.count("*").alias("n"), F.min("c_name").alias("first_name"))


@query("P2_kind_exists", "select p_partkey from part where p_size % 3 = 2")
def kind_exists(spark, sf):
    return table(spark, sf, "part").filter("p_size % 3 = 2").select("p_partkey")


@query("P3_typed_scalar", "select p_partkey, p_size::double as value from part where p_size between 1 and 50")
def typed_scalar(spark, sf):
    return table(spark, sf, "part").filter("p_size between 1 and 50").select("p_partkey", F.col("p_size").cast("double").alias("value"))


@query("P4_string_array", "select p_partkey, len(list_filter([p_brand, '', p_name], lambda x: x <> ''))::int as n from part")
def string_array(spark, sf):
    raw = F.concat("p_brand", F.lit("\0"), F.lit("\0"), "p_name", F.lit("\0"))
    return table(spark, sf, "part").select("p_partkey", F.size(text.strings_of(raw)).alias("n"))


@query("P5_array_convert", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 9) as total from embeddings")
def array_convert(spark, sf):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("P6_scalar_like", "select o_custkey, max(n) = 1 as scalar_like from (select o_custkey, l_orderkey, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) group by 1")
def scalar_like(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.bool_and(F.col("n") == 1).alias("scalar_like"))


@query("P7_dims", "select vec_id, 2 as rank, (len(embedding) * (label + 1))::bigint as num_points from embeddings")
def dims(spark, sf):
    d = F.array(F.size("embedding").cast("long"), (F.col("label") + 1).cast("long"))
    return table(spark, sf, "embeddings").select("vec_id", F.size(d).alias("rank"), F.aggregate(d, F.lit(1).cast("long"), lambda a, x: a * x).alias("num_points"))


@query("P8_vec3_reader", f"select vec_id, {E.format(1)} as x, {E.format(2)} as y, {E.format(3)} as z from embeddings")
def vec3_reader(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", point().alias("p")).select("vec_id", "p.*")


@query("P10_bounds_reader", "select vec_id, list_min(embedding)::double as lo, list_max(embedding)::double as hi from embeddings")
def bounds_reader(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("lo"), F.array_max("embedding").cast("double").alias("hi"))


@query("P12_curve_slice", "select vec_id, round(list_sum(list_transform(list_slice(embedding, case label % 3 when 0 then 1 when 1 then label + 2 else label * 2 + 4 end, case label % 3 when 0 then label + 1 when 1 then label * 2 + 3 else label * 3 + 6 end), lambda x: x::double)), 9) as total from embeddings")
def curve_slice(spark, sf):
    counts = F.array(F.col("label") + 1, F.col("label") + 2, F.col("label") + 3)
    nth = F.col("label") % 3
    first = F.aggregate(F.slice(counts, F.lit(1), nth), F.lit(0), lambda a, n: a + n)
    curve = F.slice("embedding", first + 1, F.element_at(counts, nth + 1))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(curve, F.lit(0.0), lambda a, x: a + x.cast("double")), 9).alias("total"))


@query("P14_nurbs_facts", "select vec_id, label + 1 as degree, list_max(list_transform(embedding, lambda x: abs(x::double - 1))) > 1e-6 as rational, len(embedding)::int - label - 2 as expected from embeddings")
def nurbs_facts(spark, sf):
    order = F.col("label") + 2
    return table(spark, sf, "embeddings").select("vec_id", (order - 1).alias("degree"), F.exists("embedding", lambda w: F.abs(w.cast("double") - 1) > 1e-6).alias("rational"), (F.size("embedding") - order).alias("expected"))


@query("P15_fov", "select p_partkey, round(degrees(2 * atan((p_size % 7 + 1)::double / (2.0::double * (p_size + 10) / 10.0::double))), 6) as hfov, round((p_size % 7 + 1)::double / (p_size % 5 + 1), 9) as aspect from part")
def fov(spark, sf):
    width, height, focal = (F.col("p_size") % 7 + 1).cast("double"), F.col("p_size") % 5 + 1, F.col("p_size") + 10
    return table(spark, sf, "part").select("p_partkey", F.round(F.degrees(2 * F.atan(width / (2.0 * focal / 10.0))), 6).alias("hfov"), F.round(width / height, 9).alias("aspect"))


@query("P17_light_from_transform", f"select vec_id, {E.format(1)} as x, {E.format(2)} as y, {E.format(3)} as z, -1.0::double as dz from embeddings")
def light(spark, sf):
    p = point()
    m = la.matmul(la.translation(p.x, p.y, p.z), la.scaling(F.lit(2.0), F.lit(2.0), F.lit(2.0)))
    e = lambda k: F.element_at("m", F.lit(k))
    back = la.normalize(la.vec(-e(9), -e(10), -e(11)))
    return table(spark, sf, "embeddings").withColumn("m", m).select("vec_id", e(13).alias("x"), e(14).alias("y"), e(15).alias("z"), back.z.alias("dz"))


@query("P18_valid_samples", "select vec_id, len(embedding) > 0 and label > 2 as valid from embeddings")
def valid_samples(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ((F.size("embedding") > 0) & (F.col("label") > 2)).alias("valid"))


@query("A3_points_bounds", f"select label, min({E.format(1)}) as min_x, min({E.format(2)}) as min_y, min({E.format(3)}) as min_z, max({E.format(1)}) as max_x, max({E.format(2)}) as max_y, max({E.format(3)}) as max_z from embeddings group by 1")
def points_bounds(spark, sf):
    return geo.bounds(table(spark, sf, "embeddings").select("label", point().alias("p")).select("label", "p.*"), ["label"])


@query("A4_bounds_union", f"select label, min({E.format(1)}) as min_x, min({E.format(2)}) as min_y, min({E.format(3)}) as min_z, max({E.format(1)}) as max_x, max({E.format(2)}) as max_y, max({E.format(3)}) as max_z from embeddings group by 1")
def bounds_union(spark, sf):
    """The boxes of all vectors, and besides them inverted ones, which don't count."""
    p = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 10).alias("g"), point().alias("p")).select("label", "g", "p.*")
    boxes = geo.bounds(p, ["label", "g"])
    inverted = boxes.filter("g = 3").withColumns({"min_x": F.col("max_x") + 2, "max_x": F.col("max_x") + 1, "min_y": F.col("min_y") - 9, "max_z": F.col("max_z") + 9})
    return geo.union_boxes(boxes.unionByName(inverted), ["label"])


@query("A11_dedup", "select count(*) as stored, count(distinct text) as distinct_keys, sum(strlen(text))::bigint - (select sum(strlen(text)) from (select distinct text from documents))::bigint as saved from documents")
def dedup(spark, sf):
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    each = d.groupBy("digest", "size").agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("stored"), F.count("*").alias("distinct_keys"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))


@query("H3_content_dedup", "select doc_id, min(doc_id) over (partition by text) as first from documents")
def content_dedup(spark, sf):
    return content.content_dedup(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "first")


@query("H5_intern", "with v as (select p_brand || p_type || (p_partkey % 5) as value, min(p_partkey) as seen from part group by 1), n as (select *, row_number() over (order by seen, value) as k from v) select value, seen, case when k <= 254 then k else 255 end::int as index from n")
def intern(spark, sf):
    p = table(spark, sf, "part").groupBy(F.concat("p_brand", "p_type", F.col("p_partkey") % 5).alias("value")).agg(F.min("p_partkey").alias("seen"))
    return content.intern(p)


@query("H1_murmur3")
def murmur3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.hex(sample_digest(F.encode("p_name", "UTF-8"))).alias("digest"))


@query("W1_face_offsets", "with f as (select l_orderkey % 50 as mesh, l_orderkey as face, count(*) as n from lineitem group by 1, 2) select mesh, face, n, coalesce(sum(n) over (partition by mesh order by face rows between unbounded preceding and 1 preceding), 0)::bigint as first from f")
def face_offsets(spark, sf):
    f = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("mesh"), F.col("l_orderkey").alias("face")).agg(F.count("*").alias("n"))
    return geo.face_offsets(f, width=1 << 12)


PIXELS = "p as (select day(ts) - 1 as y, hour(ts) as x, sum(value::decimal(18,2))::double as lum from events group by 1, 2)"


@query("W2_cdf", f"""with {PIXELS}, w as (select *, lum * sin(pi() * (y + 0.5::double) / 31) as w from p), r as (select y, sum(w) as s from w group by 1),
m as (select y, sum(s) over (order by y) / (select sum(s) from r) as marginal from r)
select w.y::int as y, x::int as x, round(sum(w) over (partition by w.y order by x) / s, 6) as conditional, round(marginal, 6) as marginal from w join r using (y) join m using (y)""")
def cdf(spark, sf):
    e = table(spark, sf, "events")
    p = e.groupBy((F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("lum"))
    return geo.cdf(p, 31).select("y", "x", F.round("conditional", 6).alias("conditional"), F.round("marginal", 6).alias("marginal"))


@query("G17_cdf_inversion", f"""with {PIXELS}, c as (select y, x, sum(lum) over (partition by y order by x) / sum(lum) over (partition by y) as cdf from p), u as (select distinct y, (y * 7 % 10) / 10.0::double as u from p)
select u.y::int as y, min(x)::int as x from u join c on c.y = u.y and cdf > u group by 1""")
def cdf_inversion(spark, sf):
    e = table(spark, sf, "events")
    p = e.groupBy((F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("lum"))
    w = Window.partitionBy("y")
    c = p.withColumn("cdf", F.sum("lum").over(w.orderBy("x")) / F.sum("lum").over(w)).withColumn("u", (F.col("y") * 7 % 10) / 10.0)
    return c.filter("cdf > u").groupBy("y").agg(F.min("x").alias("x"))


@query("J4_gather", "select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 70 < 64 then embedding[l_partkey % 70 + 1]::double else 0.0 end as value from lineitem join embeddings on vec_id = l_orderkey % 100")
def gather_join(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") % 100).alias("vec_id"))
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    met = li.withColumn("pos", (F.col("l_partkey") % 70).cast("int")).join(v, ["vec_id", "pos"], "left")
    return met.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("value"))


@query("G1_expand", "select vec_id, list_transform([label, 63, 70], lambda i: case when i < 64 then embedding[i + 1]::double else 0.0 end)::double[] as expanded from embeddings")
def expand(spark, sf):
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", geo.gather(values, F.array(F.col("label"), F.lit(63), F.lit(70)), F.lit(0.0)).alias("expanded"))


@query("G3_triangulate", f"with {CORNERS} select a.face, b.corner - 1 as triangle, a.x as ax, b.x as bx, c.x as cx from corners a join corners b on a.face = b.face join corners c on c.face = b.face and c.corner = b.corner + 1 where a.corner = 1 and b.corner > 1")
def triangulate(spark, sf):
    """Polygons have few corners, so a polygon is one row; its fan is exploded."""
    polygons = corners(spark, sf).groupBy("face").agg(F.array_sort(F.collect_list(F.struct("corner", "x"))).alias("c"))
    fans = polygons.select("face", F.posexplode(geo.fan(F.transform("c", lambda c: c.x))).alias("k", "t"))
    return fans.select("face", (F.col("k") + 1).alias("triangle"), F.col("t.a").alias("ax"), F.col("t.b").alias("bx"), F.col("t.c").alias("cx"))


def first_three(spark, sf):
    p = lambda k: F.max(F.when(F.col("corner") == k, F.struct("x", "y", "z"))).alias(f"p{k}")
    return corners(spark, sf).filter("corner <= 3").groupBy("face").agg(p(1), p(2), p(3))


THREE = f"""with {CORNERS}, t as (select a.face, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz from corners a left join corners b on b.face = a.face and b.corner = 2 left join corners c on c.face = a.face and c.corner = 3 where a.corner = 1),
n as (select *, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from t)
"""


@query("G5_face_normals", THREE + """select face, round(case when nx is null then 0.0 when nx * nx + ny * ny + nz * nz > 0 then nx / sqrt(nx * nx + ny * ny + nz * nz) else 0.0 end, 6) + 0.0 as x,
round(case when nx is null then 1.0 when nx * nx + ny * ny + nz * nz > 0 then ny / sqrt(nx * nx + ny * ny + nz * nz) else 0.0 end, 6) + 0.0 as y from n""")
def face_normals(spark, sf):
    n = first_three(spark, sf).select("face", geo.face_normal(F.col("p1"), F.col("p2"), F.col("p3")).alias("n"))
    return n.select("face", (F.round("n.x", 6) + 0.0).alias("x"), (F.round("n.y", 6) + 0.0).alias("y"))


@query("G14_triangle_area", THREE + "select face, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) as area from n where nx is not null")
def triangle_area(spark, sf):
    t = first_three(spark, sf).filter("p3 is not null")
    n = la.cross(la.sub(F.col("p2"), F.col("p1")), la.sub(F.col("p3"), F.col("p1")))
    return t.select("face", F.round(F.sqrt(la.dot(n, n)) / 2, 6).alias("area"))


BOX = ", ".join(f"{f}(a.{x}, b.{x}, c.{x}) as {name}_{x}" for name, f in (("min", "least"), ("max", "greatest")) for x in "xyz")


@query("G14_triangle_area_all", f"""with {CORNERS}, t as (select a.face, b.corner - 1 as triangle, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz, a.x + b.x + c.x as sx, a.y + b.y + c.y as sy, a.z + b.z + c.z as sz, {BOX}
  from corners a join corners b on a.face = b.face join corners c on c.face = b.face and c.corner = b.corner + 1 where a.corner = 1 and b.corner > 1),
n as (select *, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz, max_x - min_x as dx, max_y - min_y as dy, max_z - min_z as dz from t)
select face, triangle, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) as area, min_x, min_y, min_z, max_x, max_y, max_z, round(sx / 3, 6) as center_x, round(sy / 3, 6) as center_y, round(sz / 3, 6) as center_z,
  2 * (dx * dy + dy * dz + dz * dx) as box_area, case when dx >= dy and dx >= dz then 0 when dy >= dz then 1 else 2 end as longest_axis from n""")
def triangle_area_all(spark, sf):
    """Area, box, centroid, surface of the box and its longest axis (0 to 2) of each triangle of each polygon's fan."""
    polygons = corners(spark, sf).groupBy("face").agg(F.array_sort(F.collect_list(F.struct("corner", "x", "y", "z"))).alias("c"))
    fans = polygons.select("face", F.posexplode(geo.fan(F.col("c"))).alias("k", "t"))
    return fans.select("face", (F.col("k") + 1).alias("triangle"), geo.triangle(F.col("t.a"), F.col("t.b"), F.col("t.c")).alias("g")).select("face", "triangle", "g.*")


@query("G6_smooth_normals", f"""with {CORNERS}, c as (select face % 20 as mesh, face * 100 + corner as corner, x, y, z, case (face + corner) % 3 when 0 then 1.0 else 0.0 end as nx, case (face + corner) % 3 when 1 then 1.0 else 0.0 end as ny from corners),
d as (select *, case when nx = 0 and ny = 0 then 1.0 else 0.0 end as nz from c),
k as (select distinct mesh, x, y, z, nx, ny, nz from d),
s as (select a.mesh, a.x, a.y, a.z, a.nx, a.ny, a.nz, a.nx as mx, a.ny as my from k a)
select d.mesh, d.corner, round(mx, 6)::double as x, round(my, 6)::double as y from d join s using (mesh, x, y, z, nx, ny, nz)""")
def smooth_normals(spark, sf):
    which = (F.col("face") + F.col("corner")) % 3
    unit = la.vec(F.when(which == 0, 1.0).otherwise(0.0), F.when(which == 1, 1.0).otherwise(0.0), F.when(which == 2, 1.0).otherwise(0.0))
    c = corners(spark, sf).select((F.col("face") % 20).alias("mesh"), (F.col("face") * 100 + F.col("corner")).alias("corner"), la.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"), unit.alias("n"))
    return geo.smooth_normals(c, 60.0).select("mesh", "corner", F.round("normal.x", 6).alias("x"), F.round("normal.y", 6).alias("y"))


@query("G7_curve_lines", f"with {CORNERS}, n as (select face, count(*) as n from corners group by 1) select c.face, c.corner, c.x as x0, d.x as x1, round((c.corner - 1)::double / n.n, 9) as u from corners c join corners d on d.face = c.face and d.corner = c.corner + 1 join n on n.face = c.face")
def curve_lines(spark, sf):
    w = Window.partitionBy("face").orderBy("corner")
    c = corners(spark, sf).withColumn("x1", F.lead("x").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("face")))
    return c.filter("x1 is not null").select("face", "corner", F.col("x").alias("x0"), "x1", F.round((F.col("corner") - 1) / F.col("n"), 9).alias("u"))


@query("G8_points_widths", "select p_partkey, case when p_size % 3 = 0 then 0.02::double else p_size::double end as width from part")
def points_widths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")), F.lit(0.02)).alias("width"))


@query("G10_xform_matrix", "select p_partkey, round(cos(radians(p_size)) * 2 + 0.0, 6) as m00, round(sin(radians(p_size)) * 2 + 0.0, 6) as m01, round(-sin(radians(p_size)) * 3, 6) + 0.0 as m10, (p_partkey % 10)::double as tx from part")
def xform_matrix(spark, sf):
    op = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), F.array(*(x.cast("double") for x in v)).alias("values"))
    ops = F.array(op(1, F.col("p_partkey") % 10, F.lit(0), F.lit(0)), op(6, F.col("p_size")), op(0, F.lit(2), F.lit(3), F.lit(4)))
    e = lambda k: F.round(F.element_at("m", F.lit(k)), 6) + 0.0
    return table(spark, sf, "part").withColumn("m", la.ops_matrix(ops)).select("p_partkey", e(1).alias("m00"), e(2).alias("m01"), e(5).alias("m10"), e(13).alias("tx"))


@query("G12_trs", "select p_partkey, (p_partkey % 10)::double as tx, 2.0::double as sx, 3.0::double as sy, round(p_size::double, 4) as rz from part")
def trs(spark, sf):
    op = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), F.array(*(x.cast("double") for x in v)).alias("values"))
    ops = F.array(op(1, F.col("p_partkey") % 10, F.lit(0), F.lit(0)), op(6, F.col("p_size")), op(0, F.lit(2), F.lit(3), F.lit(4)))
    t = la.trs(F.col("m"))
    return table(spark, sf, "part").withColumn("m", la.ops_matrix(ops)).select("p_partkey", *(F.round(t[c], 4).alias(c) for c in ("tx", "sx", "sy", "rz")))


@query("G12_quaternion", "select p_partkey, round(sin(radians(p_size) / 2), 6) as z, round(cos(radians(p_size) / 2), 6) as w from part")
def quaternion(spark, sf):
    q = la.quaternion(la.rotation("z", F.col("p_size").cast("double")))
    return table(spark, sf, "part").withColumn("q", q).select("p_partkey", F.round("q.z", 6).alias("z"), F.round("q.w", 6).alias("w"))


@query("X1_metadata_roundtrip", "select p_partkey, 'a=b' || p_brand as k, 'x;y\\z' || p_name as v from part")
def metadata_roundtrip(spark, sf):
    m = F.create_map(F.concat(F.lit("a=b"), "p_brand"), F.concat(F.lit("x;y\\z"), "p_name"))
    back = F.map_entries(text.text_to_metadata(text.metadata_to_text(m)))[0]
    return table(spark, sf, "part").select("p_partkey", back.key.alias("k"), back.value.alias("v"))


@query("O1_sorted_metadata", "select p_partkey, 'a=' || p_type || ';b=' || p_name || ';c=' || p_brand as metadata from part")
def sorted_metadata(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.metadata_to_text(F.create_map(F.lit("c"), "p_brand", F.lit("a"), "p_type", F.lit("b"), "p_name")).alias("metadata"))


@query("X2_path_functions", "select p_partkey, split_part(p_brand || '/' || p_type || '/' || p_name, '/', -1) as name from part")
def path_functions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.last_component(F.concat_ws("/", "p_brand", "p_type", "p_name")).alias("name"))


@query("X3_path_material", """with recursive c as (select p_partkey, p_name as s, 1 as i, 0::bigint as h from part union all select p_partkey, s, i + 1, (h * 31 + ascii(s[i])) % 4294967296 from c where i <= length(s))
select p_partkey, case when contains(s, 'metal') or contains(s, 'bolt') or contains(s, 'rim') or contains(s, 'steel') or contains(s, 'iron') then 'metal' else ['glass', 'metal', 'plastic', 'leather', 'rubber'][h % 5 + 1] end as material from c where i = length(s) + 1""")
def path_material(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.path_material(F.col("p_name")).alias("material"))


@query("X5_version", "select p_partkey, (p_partkey + 10700) // 10000 || '.' || (p_partkey + 10700) // 100 % 100 || '.' || (p_partkey + 10700) % 100 as version from part")
def version(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.version_text(F.col("p_partkey") + 10700).alias("version"))


@query("X7_codes", "select p_partkey, ['hidden', 'visible', 'deferred'][p_partkey % 3 + 1] as visibility, ['none', 'bezier', 'bspline', 'catmull-rom', 'hermite', 'power'][p_partkey % 6 + 1] as basis from part")
def codes(spark, sf):
    vis = text.code_names(F.element_at(F.array(F.lit(0), F.lit(1), F.lit(-1)), (F.col("p_partkey") % 3 + 1).cast("int")), text.VISIBILITY, "deferred")
    return table(spark, sf, "part").select("p_partkey", vis.alias("visibility"), text.code_names((F.col("p_partkey") % 6).cast("int"), text.BASIS, "none").alias("basis"))


@query("X8_map_functions", "select p_partkey, p_brand as got, 2 as n from part")
def map_functions(spark, sf):
    m = F.map_concat(F.create_map(F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string")), F.create_map(F.lit("type"), "p_type"))
    less = F.map_filter(m, lambda k, v: k != "size")
    return table(spark, sf, "part").select("p_partkey", F.try_element_at(less, F.lit("brand")).alias("got"), F.size(F.map_keys(less)).alias("n"))


@query("X9_box_math", "select vec_id, round((list_min(embedding)::double + list_max(embedding)::double) / 2, 9) as center, round(list_max(embedding)::double - list_min(embedding)::double, 9) as size from embeddings")
def box_math(spark, sf):
    lo, hi = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round((lo + hi) / 2, 9).alias("center"), F.round(hi - lo, 9).alias("size"))


@query("X10_shader_param", "select p_partkey, case p_size % 3 when 0 then 'float' when 1 then 'color' else 'string' end as kind, case when p_size % 3 = 2 then p_type else null end as s from part")
def shader_param(spark, sf):
    k = F.col("p_size") % 3
    value = F.struct(F.when(k == 0, "float").when(k == 1, "color").otherwise("string").alias("kind"), F.when(k == 2, F.col("p_type")).alias("s"))
    return table(spark, sf, "part").withColumn("v", value).select("p_partkey", "v.kind", "v.s")


# the name under which the query on all boxes was first registered
QUERIES["A4_bounds_union_all"], ORACLES["A4_bounds_union_all"] = QUERIES["A4_bounds_union"], ORACLES["A4_bounds_union"]
