"""Queries on attributes, cameras, listings and stored scenes."""

import uuid

from pyspark.sql import functions as F

from tesserae.functions import linalg as la
from tesserae.functions import text
from tesserae.functions import timesampling as ts
from tesserae.operators import content
from tesserae.operators import geometry as geo
from tesserae.operators import hierarchy as tree
from tesserae.operators import selection as sel
from tesserae.plans.array_queries import E, point
from tesserae.plans.bindings import CORNERS, OBJECTS, SAMPLES, corners, objects, samples, shared_folder, table
from tesserae.plans.time_queries import RUNS, SELECTED, selected
from tesserae.plans.tree_queries import WORLD, placed
from tesserae.sources import scene

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def embedded(spark, sf):
    """Vectors with their numbers as doubles: flat."""
    return table(spark, sf, "embeddings").withColumn("flat", F.transform("embedding", lambda x: x.cast("double")))


@query("P9_indexed_reader", "select vec_id, (len(embedding) // 3)::int as n_values, embedding[61]::double as last_x, case when label % 2 = 0 then [label, 70]::int[] end as indices from embeddings")
def indexed_reader(spark, sf):
    indices = F.when(F.col("label") % 2 == 0, F.array("label", F.lit(70)))
    return embedded(spark, sf).withColumn("values", geo.tuples(F.col("flat"), 3)).select("vec_id", F.size("values").alias("n_values"), F.element_at("values", -1)[0].alias("last_x"), indices.alias("indices"))


@query("G2_expand_uvs_normals", """with i as (select *, case when label % 3 > 0 then [label * 4, 31, 32, 40] end as places from embeddings)
select vec_id, case when places is null then list_transform(range(0, 32), lambda k: embedding[2 * k + 2]::double) else list_transform(places, lambda k: case when k < 32 then embedding[2 * k + 2]::double else 0.0 end) end::double[] as v,
  case when places is null then list_transform(range(0, 21), lambda k: embedding[3 * k + 2]::double) else list_transform(places, lambda k: case when k < 21 then embedding[3 * k + 2]::double else 1.0 end) end::double[] as ny from i""")
def expand_uvs_normals(spark, sf):
    """Texture coordinates and normals, indexed in two of three meshes."""
    at = F.when(F.col("label") % 3 > 0, F.array(F.col("label") * 4, F.lit(31), F.lit(32), F.lit(40)))
    uv, n = geo.expanded(F.col("flat"), 2, at, [0.0, 0.0]), geo.expanded(F.col("flat"), 3, at, [0.0, 1.0, 0.0])
    return embedded(spark, sf).select("vec_id", F.transform(uv, lambda x: x[1]).alias("v"), F.transform(n, lambda x: x[1]).alias("ny"))


@query("G4_pick_normals", """with c as (select l_orderkey as face, count(*) as n from lineitem group by 1), t as (select face, n, unnest(range(1, n - 1)) as triangle from c),
v as (select face, triangle, face % 9 as k, 0 as i0, triangle * 2 % 5 as i1, (triangle + 1) * 2 % 5 as i2 from t)
select face, triangle, case when k > triangle + 1 then 0.0 when k > i2 then 0.0 else -1.0 end::double as n0, case when k > triangle + 1 then triangle * 1.5 when k > i2 and k > i1 then i1 * 1.5 else -1.0 end::double as n1,
  case when k > triangle + 1 then (triangle + 1) * 1.5 when k > i2 then i2 * 1.5 else -1.0 end::double as n2 from v""")
def pick_normals(spark, sf):
    """Triangles of fans; a polygon has as many values as its number modulo 9."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("face")).agg(F.count("*").alias("n"))
    t = n.filter("n > 2").select("face", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 2)).alias("triangle"))
    k = F.col("face") % 9
    values = F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), lambda x: x * 1.5))
    zero, i = F.lit(0).cast("long"), F.col("triangle")
    picked = geo.picked(values, [zero, i, i + 1], [zero, i * 2 % 5, (i + 1) * 2 % 5], F.lit(-1.0))
    return t.select("face", "triangle", *(c.alias(f"n{x}") for x, c in enumerate(picked)))


@query("G9_decode_ops", """select p_partkey, case when k < 3 then 0 when k = 3 then 1 when k < 7 then 2 else 3 end as n_ops, case when k < 3 then 0 when k = 3 then 3 when k < 7 then 4 else 7 end as n_values,
  case when k < 3 then [] when k = 3 then [1] when k < 7 then [1, 6] else [1, 6, 0] end::int[] as kinds from (select p_partkey, p_size % 9 as k from part)""")
def decode_ops(spark, sf):
    """Translate, an unknown code, rotate about z, scale; as many values as the size modulo 9."""
    codes = F.array((F.lit(0x10) + F.col("p_partkey") % 16).cast("int"), F.lit(0x70), F.lit(0x60), F.lit(0x00))
    values = F.slice(F.array(*(F.lit(float(x)) for x in range(1, 9))), F.lit(1), (F.col("p_size") % 9).cast("int"))
    ops = la.decode_ops(codes, values)
    return table(spark, sf, "part").withColumn("ops", ops).select("p_partkey", F.size("ops").alias("n_ops"), F.aggregate("ops", F.lit(0), lambda a, x: a + F.size(x["values"])).alias("n_values"), F.transform("ops", lambda x: x.kind).alias("kinds"))


@query("G13_world_triangles", f"""with {CORNERS}, t as (select a.face, b.corner - 1 as triangle, a.x, a.y, c.z, 1.0::double / (a.face % 3 + 1) as ix, 0.5::double as iy, 1.0::double as iz from corners a join corners b on a.face = b.face join corners c on c.face = b.face and c.corner = b.corner + 1 where a.corner = 1 and b.corner > 1)
select face, triangle, x * (face % 3 + 1) + face % 10 as ax, y * 2 as ay, z + 1.0 as cz, round(ix / sqrt(ix * ix + iy * iy + iz * iz), 6) as nx, round(iy / sqrt(ix * ix + iy * iy + iz * iz), 6) as ny, round(iz / sqrt(ix * ix + iy * iy + iz * iz), 6) as nz from t""")
def world_triangles(spark, sf):
    """Triangles of fans in the world, with the normal (1, 1, 1) turned by the transposed inverse."""
    polygons = corners(spark, sf).groupBy("face").agg(F.array_sort(F.collect_list(F.struct("corner", la.vec(F.col("x"), F.col("y"), F.col("z")).alias("p")))).alias("c"))
    fans = polygons.select("face", F.posexplode(geo.fan(F.transform("c", lambda c: c.p))).alias("k", "t"))
    k, one = F.col("face"), F.lit(1)
    m = la.matmul(la.translation(k % 10, F.lit(0), one), la.scaling(k % 3 + 1, F.lit(2), one))
    a, c = (la.transform_point(F.col("m"), F.col(f"t.{x}")) for x in "ac")
    n = la.transform_normal(F.col("m"), la.vec(one, one, one))
    rows = fans.withColumn("m", m).select("face", (F.col("k") + 1).alias("triangle"), a.alias("a"), c.alias("c"), n.alias("n"))
    return rows.select("face", "triangle", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("c.z").alias("cz"), *(F.round(f"n.{x}", 6).alias(f"n{x}") for x in "xyz"))


TURNED = f"{CORNERS}, d as (select face % 20 as mesh, face * 100 + corner as corner, x, y, z, (face + corner) % 3 as turn from corners), k as (select mesh, x, y, z, turn, count(*) as times from d group by all), m as (select a.mesh, a.x, a.y, a.z, a.turn, b.turn as near, b.times from k a join k b using (mesh, x, y, z) where abs(a.turn - b.turn) <= 1)"


def turned(spark, sf):
    """Corners with normals at 0, 40 and 80 degrees about z."""
    angle = F.radians(40.0 * ((F.col("face") + F.col("corner")) % 3))
    return corners(spark, sf).select((F.col("face") % 20).alias("mesh"), (F.col("face") * 100 + F.col("corner")).alias("corner"), la.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"), la.vec(F.cos(angle), F.sin(angle), F.lit(0)).alias("n"))


@query("J7_coincident", f"with {TURNED} select mesh, x, y, z, turn, count(*) as normals, sum(times)::bigint as corners from m group by all")
def coincident(spark, sf):
    met = geo.coincident(turned(spark, sf), 60.0)
    turn = F.round(F.degrees(F.atan2("n.y", "n.x")) / 40).cast("long")
    return met.groupBy("mesh", *((F.col(f"cell.{a}") / 10000).alias(a) for a in "xyz"), turn.alias("turn")).agg(F.count("*").alias("normals"), F.sum("times").alias("corners"))


@query("G6_smooth_means", f"""with {TURNED}, s as (select mesh, x, y, z, turn, sum(cos(radians(40.0 * near)) * times) as sx, sum(sin(radians(40.0 * near)) * times) as sy from m group by all)
select d.mesh, d.corner, round(sx / sqrt(sx * sx + sy * sy), 6) + 0.0 as x, round(sy / sqrt(sx * sx + sy * sy), 6) + 0.0 as y from d join s using (mesh, x, y, z, turn)""")
def smooth_means(spark, sf):
    """Means over normals of which neighbours, 40 degrees apart, count together."""
    return geo.smooth_normals(turned(spark, sf), 60.0).select("mesh", "corner", (F.round("normal.x", 6) + 0.0).alias("x"), (F.round("normal.y", 6) + 0.0).alias("y"))


@query("J8_as_of", SELECTED + "select event_id, floor_idx, floor_t::double as floor_t from g")
def as_of(spark, sf):
    return selected(spark, sf).select("event_id", "floor_idx", "floor_t")


@query("W3_changes", f"with {SAMPLES} select event_id, idx > 0 and event_type is distinct from lag(event_type) over (partition by key order by idx) as changed from samples")
def changes(spark, sf):
    return sel.changes(samples(spark, sf).select("key", "idx", "event_id", F.col("event_type").alias("value"))).select("event_id", "changed")


@query("O4_distinct", "select min(doc_id) as doc_id from documents where text is not null group by text")
def distinct_content(spark, sf):
    return content.distinct_content(table(spark, sf, "documents").filter("text is not null"), "doc_id", "text").select("doc_id")


@query("S14_keyed_write", "select doc_id, min(doc_id) over (partition by text, lang) as stored_at, doc_id = min(doc_id) over (partition by text, lang) as written from documents")
def keyed_write(spark, sf):
    return content.keyed_store(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id", "text", "lang").select("doc_id", "stored_at", "written")


@query("X4_string_codec", "select p_partkey, (strlen(p_brand) + strlen(p_name) + 3)::int as size, [p_brand, p_name] as strings from part")
def string_codec(spark, sf):
    raw = text.strings_to_bytes(F.array("p_brand", F.lit(""), "p_name"))
    return table(spark, sf, "part").withColumn("raw", raw).select("p_partkey", F.octet_length("raw").alias("size"), text.strings_of(F.col("raw")).alias("strings"))


@query("X6_vector_math", f"""with p as (select vec_id, {E.format(1)} as ax, {E.format(2)} as ay, {E.format(3)} as az, {E.format(4)} as bx, {E.format(5)} as bb, {E.format(6)} as bz from embeddings)
select vec_id, round(ax * bx + ay * bb + az * bz, 9) as dot, round(ay * bz - az * bb, 9) as cross_x, round(coalesce(ax / nullif(sqrt(ax * ax + ay * ay + az * az), 0), 0), 9) as unit_x, round(degrees(atan2(ay, ax)), 6) as angle, greatest(-0.1, least(0.1, ax)) as clamped from p""")
def vector_math(spark, sf):
    a, b = point(0), point(1)
    p = table(spark, sf, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(la.dot(a, b), 9).alias("dot"), F.round(la.cross(a, b).x, 9).alias("cross_x"), F.round(la.normalize(a).x, 9).alias("unit_x"), F.round(F.degrees(F.atan2(a.y, a.x)), 6).alias("angle"), F.greatest(F.lit(-0.1), F.least(F.lit(0.1), a.x)).alias("clamped"))


@query("S19_json_dump", WORLD + """select path, '{"path":"' || path || '","matrix":[' || sx::bigint || ',0,0,0,0,' || sy::bigint || ',0,0,0,0,' || sz::bigint || ',0,' || tx::bigint || ',' || ty::bigint || ',' || tz::bigint || ',1],"translation":[' || tx::bigint || ',' || ty::bigint || ',' || tz::bigint || ']}' as json from w""")
def json_dump(spark, sf):
    """World matrices and translations; all are whole numbers here."""
    t = la.trs(F.col("world"))
    row = F.struct("path", F.transform("world", lambda x: F.round(x).cast("long")).alias("matrix"), F.array(*(F.round(t[c]).cast("long") for c in ("tx", "ty", "tz"))).alias("translation"))
    return tree.world_transforms(placed(spark, sf)).select("path", F.to_json(row).alias("json"))


@query("X11_json", """select p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"tags":["' || p_brand || '","' || p_type || '"]}' as json from part""")
def json(spark, sf):
    row = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags"))
    return table(spark, sf, "part").select("p_partkey", F.to_json(row).alias("json"))


@query("O2_write_order", "select p_partkey, row_number() over (partition by p_brand order by p_size % 3, p_partkey) - 1 as place from part")
def write_order(spark, sf):
    p = table(spark, sf, "part").withColumn("rank", F.col("p_size") % 3)
    return content.write_order(p, "p_brand", ["rank", "p_partkey"]).select("p_partkey", F.col("place").cast("long").alias("place"))


def named_properties(spark, sf):
    """Orders as properties of customers, a third of them below .geom/.arbGeomParams."""
    o = table(spark, sf, "orders")
    where = F.when(F.col("o_orderkey") % 3 == 0, ".geom/.arbGeomParams/").otherwise(".geom/.userProperties/")
    return o.select(F.col("o_custkey").alias("object"), F.concat(where, F.lit("p"), F.col("o_orderkey") % 7).alias("prop_path"), F.col("o_orderkey").alias("ord"))


@query("P11_arb_params", "select c_custkey as object, count(o_orderkey) > 0 as present, coalesce(string_agg('p' || o_orderkey % 7, ',' order by o_orderkey), '') as names from customer left join orders on o_custkey = c_custkey and o_orderkey % 3 = 0 group by 1")
def arb_params(spark, sf):
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("object"))
    return content.compound_names(o, named_properties(spark, sf), ".geom/.arbGeomParams").withColumn("names", F.array_join("names", ","))


@query("P13_trim_curves", """with c as (select vec_id, embedding, label, case label % 4 when 0 then 0 when 1 then 2 * label + 1 + 2 - label when 2 then 2 * label + 3 + 5 end as k, case label % 4 when 0 then 0 when 1 then label + 1 when 2 then 2 * label + 3 end as f,
  case label % 4 when 0 then label + 1 when 1 then label + 2 when 2 then label + 3 end as n, case label % 4 when 1 then 3 when 3 then null else 2 end as o from embeddings)
select vec_id, n + o as n_knots, embedding[k + 1]::double as first_knot, n as n_u, embedding[f + 1]::double as first_u, embedding[label + 2]::double as loop_u from c""")
def trim_curves(spark, sf):
    """Three curves in loops of one and two; every fourth label asks for one too many."""
    i, label = F.col("label") % 4, F.col("label")
    counts, orders = F.array(label + 1, label + 2, label + 3), F.array(F.lit(2), F.lit(3), F.lit(2))
    of = lambda k: geo.trim_curve(counts, orders, F.col("flat"), F.col("flat"), k)
    in_loop = of(geo.curve_in_loop(F.array(F.lit(1), F.lit(2)), 1, F.lit(0)))
    rows = embedded(spark, sf).select("vec_id", of(i).alias("c"), in_loop.alias("d"))
    return rows.select("vec_id", F.when(F.col("c").isNotNull(), F.size("c.knots")).alias("n_knots"), F.col("c.knots")[0].alias("first_knot"), F.when(F.col("c").isNotNull(), F.size("c.u")).alias("n_u"), F.col("c.u")[0].alias("first_u"), F.col("d.u")[0].alias("loop_u"))


@query("P16_film_back", "select p_partkey, [sx, 2 * sx, 2 * tx, 0, sy, 2 * ty, 0, 0, 2]::double[] as m from (select p_partkey, p_size % 5 as tx, p_size % 3 as ty, p_size % 4 + 1 as sx, p_size % 2 + 1 as sy from part)")
def film_back(spark, sf):
    k = F.col("p_size")
    op = lambda kind, *v: F.struct(F.lit(kind).alias("kind"), F.array(*(x.cast("double") for x in v)).alias("values"))
    ops = F.array(op("translate", k % 5, k % 3), op("scale", k % 4 + 1, k % 2 + 1), op("matrix", *map(F.lit, (1, 2, 0, 0, 1, 0, 0, 0, 2))))
    return table(spark, sf, "part").select("p_partkey", la.film_back(ops).alias("m"))


@query("F11_collection_members", f"with {OBJECTS}, c as (select c_mktsegment as name, '/r' || c_nationkey % 7 as path from customer) select distinct name, path, path in (select path from objects) as exists from c where path in ('/r1', '/r6')")
def collection_members(spark, sf):
    """Collections that hold either of two paths, and whether there is such an object."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.concat(F.lit("/r"), F.col("c_nationkey") % 7).alias("path")).filter("path in ('/r1', '/r6')").distinct()
    there = objects(spark, sf).select("path").withColumn("exists", F.lit(True))
    return c.join(there, "path", "left").select("name", "path", F.coalesce("exists", F.lit(False)).alias("exists"))


KINDS = ("Xform", "PolyMesh", "SubD", "Curves", "Points", "Camera", "Light")


@query("A2_stats_lines", """with c as (select o_orderkey as k, count(l_orderkey) as n, count(distinct l_linestatus) as s from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select k, case k % 7 when 0 then case when s <= 1 then '- static, ' else '- animated, ' end || s || ' samples' when 1 then '- ' || n || ' verts, 1 faces, ' || s || ' samples' when 2 then '- ' || n || ' verts, 1 faces, ' || s || ' samples' when 3 then '- 1 curves, ' || s || ' samples'
  when 4 then '- ' || n || ' points, ' || s || ' samples' when 5 then printf('- focal=%.1fmm, ', k % 50 + 0.5) || s || ' samples' else '' end as line from c""")
def stats_lines(spark, sf):
    """Orders as objects of seven classes, their line items as vertices."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("s"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).join(n, "k", "left").na.fill(0, ["n", "s"])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 7 + 1).cast("int"))
    return o.select("k", text.stats_line(kind, F.col("n"), F.lit(1), F.col("s"), F.col("k") % 50 + 0.5, F.col("s") <= 1).alias("line"))


BOXED = ", ".join(f"min({E.format(i)} - w) as min_{a}, max({E.format(i)} + w) as max_{a}" for i, a in ((1, "x"), (2, "y"), (3, "z")))


@query("A5_archive_bounds", f"""with s as (select vec_id % 10 as object, vec_id // 10 as idx, case when vec_id % 2 = 0 then 1.0 else 0.0 end as w, embedding from embeddings), n as (select object, count(*) as n from s group by 1),
q as (select 'index 3' as chosen, object, 3 as idx from n union all select 'time 0.5', object, least(12, n - 1) from n union all select 'time 1e6', object, n - 1 from n)
select chosen, {BOXED} from q join s using (object, idx) group by 1""")
def archive_bounds(spark, sf):
    """Bounds at an index and at two times; every second sample has its own, wider than its point."""
    p, w = point(), F.lit(1.0)
    own = F.when(F.col("vec_id") % 2 == 0, F.struct(*((p[a] - w).alias(f"min_{a}") for a in "xyz"), *((p[a] + w).alias(f"max_{a}") for a in "xyz")))
    s = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("object"), F.floor(F.col("vec_id") / 10).alias("idx"), own.alias("own"), F.array(p).alias("points"))
    s = s.join(s.groupBy("object").agg(F.count("*").alias("n")), "object")
    at = lambda t: ts.frame_at_24(F.lit(t), F.col("n"))
    chosen = (("index 3", F.lit(3)), ("time 0.5", at(0.5)), ("time 1e6", at(1e6)))
    found = [geo.archive_bounds(s, index).withColumn("chosen", F.lit(name)) for name, index in chosen]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("A7_scene_stats", f"with {CORNERS}, n as (select face, count(*) as n, min(x) as x0, min(y) as y0, min(z) as z0, max(x) as x1, max(y) as y1, max(z) as z1 from corners group by 1) select count(*) as meshes, sum(n)::bigint as vertices, sum(greatest(n - 2, 0))::bigint as triangles, min(x0) as min_x, min(y0) as min_y, min(z0) as min_z, max(x1) as max_x, max(y1) as max_y, max(z1) as max_z from n")
def scene_stats(spark, sf):
    c = corners(spark, sf)
    boxes = geo.bounds(c, ["face"]).withColumn("all", F.lit(1))
    n = c.groupBy("face").agg(F.count("*").alias("n")).agg(F.count("*").alias("meshes"), F.sum("n").alias("vertices"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("triangles"))
    return n.withColumn("all", F.lit(1)).join(geo.union_boxes(boxes, ["all"]), "all").drop("all")


@query("A1_mesh_totals", f"""with {OBJECTS}, c as (select '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '/o' || o_orderkey as path, count(l_orderkey) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join lineitem on l_orderkey = o_orderkey group by 1)
select case depth when 1 then 'Xform' when 3 then 'Curves' else 'PolyMesh' end as class, count(*) as n, coalesce(sum(c.n), 0)::bigint as vertices, count(c.path) as faces from objects left join c using (path) where depth <> 2 group by 1""")
def mesh_totals(spark, sf):
    """Objects of each class (groups don't count), with the vertices and faces of meshes; an order is a mesh of one face."""
    d = F.size(F.split("path", "/")) - 1
    schema = F.when(d == 1, "AbcGeom_Xform_v3").when(d == 2, "").when(d == 3, "AbcGeom_Curve_v2").otherwise("AbcGeom_PolyMesh_v1")
    o = objects(spark, sf).select("path", text.schema_class(schema).alias("class")).filter("class <> 'Group'")
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.count("*").alias("n"))
    met = o.withColumn("key", F.when(F.col("class") == "PolyMesh", F.substring_index("path", "/o", -1))).join(n, "key", "left")
    mesh = F.col("class").isin("PolyMesh", "SubD")
    return met.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.when(mesh, F.coalesce("n", F.lit(0))).otherwise(0)).alias("vertices"), F.count_if(mesh).alias("faces"))


@query("T11_stored_counts", RUNS + "select r.key, count(*) filter (r.n > 0) > 0 as stored, max(case when first_changed = 0 and last_changed = 0 then 1 else last_changed - first_changed + 2 end)::bigint as n_stored from r group by 1")
def stored_counts(spark, sf):
    """How many samples of each property are stored: those from the first change to the last, and the one before."""
    s = sel.changes(samples(spark, sf).select("key", "idx", F.col("event_type").alias("value")))
    runs = sel.change_runs(samples(spark, sf).select("key", "idx", F.col("event_type").alias("value")))
    at = ts.stored_index(F.col("idx"), F.col("first_changed"), F.col("last_changed"))
    return s.join(runs, "key").groupBy("key").agg((F.count("*") > 0).alias("stored"), F.count_distinct(at).alias("n_stored"))


def stored_scene(spark, sf):
    """Folder of a scene: the tree as objects, nations as time samplings (of which 15 differ), customers as properties."""
    folder = f"{shared_folder(spark)}/scene-{uuid.uuid4().hex}"
    empty = F.lit(None).cast("map<string,string>")
    o = objects(spark, sf).select(F.lit("a").alias("archive_id"), "path", "parent_path", text.last_component(F.col("path")).alias("name"), (F.size(F.split("path", "/")) - 1).alias("depth"), F.col("ord").cast("int").alias("ord"), F.lit("AbcGeom_Xform_v3").alias("schema"), empty.alias("metadata"))
    k = F.col("n_nationkey").cast("int")
    t = table(spark, sf, "nation").select(F.lit("a").alias("archive_id"), k.alias("ts_index"), F.lit("uniform").alias("kind"), ((k % 5 + 1) / 24.0).alias("tpc"), (k % 3).cast("double").alias("start"), F.array().cast("array<double>").alias("times"), (k + 1).alias("max_samples"))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    p = table(spark, sf, "customer").select(F.lit("a").alias("archive_id"), F.concat(F.lit("/c"), "c_custkey").alias("object_path"), F.lit("P").alias("prop_path"), null("parent_prop", "string"), F.lit("P").alias("name"), null("ord", "int"), null("kind", "string"), null("pod", "string"), null("extent", "int"), F.col("c_nationkey").cast("int").alias("ts_index"), null("num_samples", "int"), null("first_changed", "int"), null("last_changed", "int"), empty.alias("metadata"))
    scene.write_scene({"objects": o, "time_samplings": t, "properties": p}, folder)
    return folder


@query("C6_copy", f"with {OBJECTS} select path, parent_path, split_part(path, '/', -1) as name, depth, ord::int as ord from objects")
def copy(spark, sf):
    """The objects of a scene that was stored and copied."""
    source = stored_scene(spark, sf)
    scene.copy_scene(spark, source, f"{source}-copy")
    return scene.read_scene(spark, f"{source}-copy", "objects").select("path", "parent_path", "name", "depth", "ord")


@query("C7_copy_merged", """with p as (select '/c' || c_custkey as object_path, c_nationkey % 15 as ts_index from customer), t as (select n_nationkey % 15 as ts_index, max(n_nationkey + 1) as max_samples from nation group by 1)
select object_path, ts_index::int as ts_index, max_samples::int as max_samples from p join t using (ts_index)""")
def copy_merged(spark, sf):
    """Properties of a copy in which equivalent time samplings were merged."""
    source = stored_scene(spark, sf)
    scene.copy_scene(spark, source, f"{source}-copy", merge_samplings=True)
    p, t = (scene.read_scene(spark, f"{source}-copy", name) for name in ("properties", "time_samplings"))
    return p.join(t.select("ts_index", "max_samples"), "ts_index").select("object_path", "ts_index", "max_samples")
