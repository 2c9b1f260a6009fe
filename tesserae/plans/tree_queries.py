"""Queries on object trees, filters, materials and collections."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import linalg as la
from tesserae.functions import text
from tesserae.operators import content
from tesserae.operators import geometry as geo
from tesserae.operators import hierarchy as tree
from tesserae.plans.bindings import OBJECTS, objects, shared_folder, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def kept(df):
    """Cuts lineage in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


@query("R1_tree", f"with {OBJECTS}, n as (select parent_path as path, count(*) as n from objects group by 1) select o.path, o.depth, coalesce(n.n, 0) as n_children from objects o left join n on o.path = n.path")
def walk(spark, sf):
    return tree.walk(objects(spark, sf)).select("path", "depth", "n_children")


@query("C2_tree_listing", f"with {OBJECTS} select path, depth, row_number() over (order by string_split(path, '/')[2], depth > 1, lpad(regexp_extract(path, '/n([0-9]+)', 1), 10, '0'), depth > 2, lpad(regexp_extract(path, '/c([0-9]+)', 1), 10, '0'), depth > 3, lpad(regexp_extract(path, '/o([0-9]+)', 1), 10, '0')) as line from objects")
def tree_listing(spark, sf):
    """Preorder lines of the whole tree."""
    return tree.numbered(tree.preorder(objects(spark, sf)), "sort_key", "line", cut=kept).select("path", "depth", "line")


def placed(spark, sf):
    """Objects with a local transform: translate then scale; every seventh doesn't inherit."""
    k = F.col("ord")
    local = la.matmul(la.translation(k % 10, k % 4, F.lit(1)), la.scaling(k % 3 + 1, F.lit(2), F.lit(1)))
    return objects(spark, sf).withColumn("local", local).withColumn("inherits", k % 7 != 0)


WORLD = f"""
with recursive {OBJECTS},
l as (select *, (ord % 10)::double as tx, (ord % 4)::double as ty, 1.0::double as tz, (ord % 3 + 1)::double as sx, 2.0::double as sy, 1.0::double as sz, ord % 7 <> 0 as inherits from objects),
w as (
  select path, tx, ty, tz, sx, sy, sz from l where depth = 1
  union all
  select l.path, case when inherits then w.tx + w.sx * l.tx else l.tx end, case when inherits then w.ty + w.sy * l.ty else l.ty end, case when inherits then w.tz + w.sz * l.tz else l.tz end,
    case when inherits then w.sx * l.sx else l.sx end, case when inherits then w.sy * l.sy else l.sy end, case when inherits then w.sz * l.sz else l.sz end
  from l join w on l.parent_path = w.path)
"""


@query("R2_world_transform", WORLD + "select * from w")
def world_transform(spark, sf):
    e = lambda k: F.element_at("world", F.lit(k))
    return tree.world_transforms(placed(spark, sf)).select("path", e(13).alias("tx"), e(14).alias("ty"), e(15).alias("tz"), e(1).alias("sx"), e(6).alias("sy"), e(11).alias("sz"))


@query("A6_world_bounds", WORLD + "select string_split(path, '/')[2] as top, min(tx) as min_x, min(ty) as min_y, min(tz) as min_z, max(tx + sx) as max_x, max(ty + sy) as max_y, max(tz + sz) as max_z from w group by 1")
def world_bounds(spark, sf):
    """Each object holds the unit cube; the bounds of its eight corners in the world, by top-level object."""
    lo, hi = la.vec(F.lit(0), F.lit(0), F.lit(0)), la.vec(F.lit(1), F.lit(1), F.lit(1))
    w = tree.world_transforms(placed(spark, sf))
    p = w.select(F.element_at(F.split("path", "/"), 2).alias("top"), F.explode(F.transform(la.corners(lo, hi), lambda c: la.transform_point(F.col("world"), c))).alias("p"))
    return geo.bounds(p.select("top", "p.*"), ["top"])


@query("C5_dump_json", WORLD + "select path, '{\"path\":\"' || path || '\",\"t\":[' || tx::bigint || ',' || ty::bigint || ',' || tz::bigint || '],\"s\":[' || sx::bigint || ',' || sy::bigint || ',' || sz::bigint || ']}' as json from w")
def dump_json(spark, sf):
    t = la.trs(F.col("world"))
    whole = lambda *names: F.array(*(F.round(t[n]).cast("long") for n in names))
    return tree.world_transforms(placed(spark, sf)).select("path", F.to_json(F.struct("path", whole("tx", "ty", "tz").alias("t"), whole("sx", "sy", "sz").alias("s"))).alias("json"))


@query("G11_identity", f"with {OBJECTS} select path, ord % 10 = 0 and ord % 4 = 0 and ord % 3 = 0 as is_identity from objects")
def identity(spark, sf):
    k = F.col("ord")
    ops = F.array(F.struct(F.lit(1).alias("kind"), F.array((k % 10).cast("double"), (k % 4).cast("double"), F.lit(0.0)).alias("values")), F.struct(F.lit(0).alias("kind"), F.array((k % 3 + 1).cast("double"), F.lit(1.0), F.lit(1.0)).alias("values")))
    return objects(spark, sf).select("path", (la.ops_matrix(ops) == la.identity()).alias("is_identity"))


@query("R3_visibility", f"""with {OBJECTS}, v as (select *, case when ord % 11 = 3 then 0 when ord % 5 = 1 then 1 else -1 end as vis from objects),
h as (select path from v where vis = 0)
select path, case vis when 1 then true when 0 then false else not (regexp_extract(path, '^(/r[0-9]+)/', 1) in (select path from h) or regexp_extract(path, '^(/r[0-9]+/n[0-9]+)/', 1) in (select path from h)
  or regexp_extract(path, '^(/r[0-9]+/n[0-9]+/c[0-9]+)/', 1) in (select path from h)) end as visible from v""")
def visibility(spark, sf):
    vis = F.when(F.col("ord") % 11 == 3, 0).when(F.col("ord") % 5 == 1, 1).otherwise(-1)
    return tree.visible(objects(spark, sf).withColumn("vis", vis)).select("path", "visible")


@query("R4_material_inherit", """
with recursive m as (select s_suppkey as key, case when s_suppkey = 0 then null else s_suppkey // 2 end as parent, case when s_suppkey % 3 = 0 then s_suppkey end as color, case when s_suppkey % 5 = 0 then s_suppkey end as rough from supplier),
u as (select key, parent, color, rough, 0 as level from m union all select u.key, m.parent, coalesce(u.color, m.color), coalesce(u.rough, m.rough), level + 1 from u join m on u.parent = m.key where level < 10)
select key, arg_max(color, level) filter (color is not null) as color, arg_max(rough, level) filter (rough is not null) as rough from u group by key""")
def material_inherit(spark, sf):
    k = F.col("s_suppkey")
    m = table(spark, sf, "supplier").select(k.alias("key"), F.when(k > 0, F.floor(k / 2)).alias("parent"), F.when(k % 3 == 0, k).alias("color"), F.when(k % 5 == 0, k).alias("rough"))
    return tree.inherit(m, ["color", "rough"])


@query("R5_material_merge", """
with p as (select s_suppkey as key, 0 as rank, 'p' || s_suppkey % 4 as name, s_suppkey % 10 as value from supplier union all select s_suppkey // 2, 1, 'p' || s_suppkey % 5, s_suppkey % 10 from supplier)
select key, name, arg_min(value, (rank, value)) as value from p group by key, name""")
def material_merge(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    row = lambda key, rank, mod: s.select(key.alias("key"), F.lit(rank).alias("rank"), F.concat(F.lit("p"), k % mod).alias("name"), (k % 10).alias("value"))
    p = row(k, 0, 4).unionByName(row(F.floor(k / 2), 1, 5))
    return p.groupBy("key", "name").agg(F.min_by("value", F.struct("rank", "value")).alias("value"))


@query("R6_reachable", """
with recursive e as (select s_suppkey as src, s_suppkey // 2 as dst from supplier union select s_suppkey, s_suppkey // 3 from supplier),
r as (select max(s_suppkey) as node from supplier union select e.dst from r join e on e.src = r.node) select node from r""")
def reachable(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"))
    edges = s.withColumn("dst", F.floor(F.col("src") / 2)).unionByName(s.withColumn("dst", F.floor(F.col("src") / 3))).distinct()
    return tree.reachable(edges, s.agg(F.max("src").alias("node")), cut=kept)


@query("R7_flatten_network", "select 'node' || p_size || '.' || p_type as name, count(*) as n from part group by 1 union all select 'surface.node' || p_size || '.' || p_brand, count(*) from part group by 1")
def flatten_network(spark, sf):
    p = table(spark, sf, "part")
    node = F.concat(F.lit("node"), "p_size")
    names = p.select(F.concat_ws(".", node, "p_type").alias("name")).unionByName(p.select(F.concat_ws(".", F.lit("surface"), node, "p_brand").alias("name")))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query("R8_terminals", "select n_nationkey, case n_nationkey % 3 when 0 then 'surface' when 1 then 'displacement' else 'volume' end as terminal, s_name as shader from nation join supplier on s_suppkey = n_nationkey")
def terminals(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("surface", "displacement", "volume"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("n_nationkey")).select("n_nationkey", kinds.alias("terminal"), F.col("s_name").alias("shader"))


@query("R9_property_merge", "select coalesce(s_suppkey, p_partkey) as path, coalesce(s_name, p_name) as value from supplier full join part on s_suppkey = p_partkey")
def property_merge(spark, sf):
    one = lambda t, k, v: table(spark, sf, t).select(F.col(k).alias("path"), F.lit("v").alias("name"), F.col(v).alias("value"))
    return content.merge_properties(one("supplier", "s_suppkey", "s_name"), one("part", "p_partkey", "p_name")).select("path", "value")


@query("R10_compound_walk", f"""with {OBJECTS}, u as (select regexp_extract(path, '^(/r[0-9]+)/', 1) as path from objects where depth > 1 union all select regexp_extract(path, '^(/r[0-9]+/n[0-9]+)/', 1) from objects where depth > 2
  union all select regexp_extract(path, '^(/r[0-9]+/n[0-9]+/c[0-9]+)/', 1) from objects where depth > 3), n as (select path, count(*) as n from u group by 1)
select path, coalesce(n, 0) as n_below from objects left join n using (path)""")
def compound_walk(spark, sf):
    o = objects(spark, sf)
    below = o.select(F.explode(text.ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return o.join(below, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_below"))


@query("R11_merkle", f"""with {OBJECTS}, x as (select path, parent_path, sha256('|' || ord || '|' || split_part(path, '/', 5)) as digest from objects where depth = 4),
c as (select o.path, o.parent_path, sha256(coalesce(string_agg(x.digest, '' order by x.path), '') || '|' || o.ord || '|' || split_part(o.path, '/', 4)) as digest from objects o left join x on x.parent_path = o.path where o.depth = 3 group by o.path, o.parent_path, o.ord),
n as (select o.path, o.parent_path, sha256(coalesce(string_agg(c.digest, '' order by c.path), '') || '|' || o.ord || '|' || split_part(o.path, '/', 3)) as digest from objects o left join c on c.parent_path = o.path where o.depth = 2 group by o.path, o.parent_path, o.ord),
r as (select o.path, o.parent_path, sha256(coalesce(string_agg(n.digest, '' order by n.path), '') || '|' || o.ord || '|' || split_part(o.path, '/', 2)) as digest from objects o left join n on n.parent_path = o.path where o.depth = 1 group by o.path, o.parent_path, o.ord)
select path, digest from x union all select path, digest from c union all select path, digest from n union all select path, digest from r""")
def merkle(spark, sf):
    return tree.merkle(objects(spark, sf).withColumn("data", F.col("ord").cast("string")), cut=kept).select("path", "digest")


@query("F1_schema_match", "select p_partkey from part where p_type = 'ECONOMY'")
def schema_match(spark, sf):
    return table(spark, sf, "part").filter("p_type = 'ECONOMY'").select("p_partkey")


IDS = ("AbcGeom_Xform_v3", "AbcGeom_PolyMesh_v1", "AbcGeom_Curve_v2", "AbcGeom_Points_v1", "", "Other_v1")


@query("F2_schema_class", "select p_partkey, ['Xform', 'PolyMesh', 'Curves', 'Points', 'Group', 'Other_v1'][p_partkey % 6 + 1] as class from part")
def schema_class(spark, sf):
    ids = F.element_at(F.array(*map(F.lit, IDS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.schema_class(ids).alias("class"))


@query("F3_find_object", f"with {OBJECTS} select path, ord from objects where path = '/r1'")
def find_object(spark, sf):
    return objects(spark, sf).filter("path = '/r1'").select("path", "ord")


@query("F4_has_object", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def has_object(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("F5_child_by_index", f"with {OBJECTS}, c as (select parent_path, path, row_number() over (partition by parent_path order by ord) as nth from objects) select parent_path, path from c where nth = 2")
def child_by_index(spark, sf):
    nth = F.row_number().over(Window.partitionBy("parent_path").orderBy("ord"))
    return objects(spark, sf).withColumn("nth", nth).filter("nth = 2").select("parent_path", "path")


@query("F6_pattern", f"with {OBJECTS} select path from objects where contains(path, 'c1') or contains(split_part(path, '/', -1), 'c1')")
def pattern(spark, sf):
    return objects(spark, sf).filter(F.col("path").contains("c1") | text.last_component(F.col("path")).contains("c1")).select("path")


@query("F7_wildcard", "select p_partkey from part where regexp_matches(lower(p_name), '^s.*i.*g$')")
def wildcard(spark, sf):
    return table(spark, sf, "part").filter(text.wildcard_match(F.col("p_name"), "s*i*g")).select("p_partkey")


@query("F8_desc_match", f"with {OBJECTS}, h as (select path from objects where path like '%/o7%') select path from objects o where exists (select 1 from h where h.path = o.path or h.path like o.path || '/%')")
def desc_match(spark, sf):
    return tree.self_or_descendant(objects(spark, sf), F.col("path").contains("/o7")).select("path")


@query("F9_metadata_subset", "select p_partkey from part where p_type = 'ECONOMY' and p_brand = 'Brand#2'")
def metadata_subset(spark, sf):
    m = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("name"), "p_name")
    wanted = F.create_map(F.lit("type"), F.lit("ECONOMY"), F.lit("brand"), F.lit("Brand#2"))
    return table(spark, sf, "part").filter(text.metadata_has(m, wanted)).select("p_partkey")


@query("F10_faceset_contains", "select l_orderkey, bool_or(l_partkey % 10 = 3) as contains from lineitem group by 1")
def faceset_contains(spark, sf):
    faces = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("faces"))
    return faces.select("l_orderkey", F.array_contains("faces", F.lit(3).cast("long")).alias("contains"))


@query("F12_parent_path", f"with {OBJECTS} select path, parent_path from objects")
def parent_path(spark, sf):
    return objects(spark, sf).select("path", text.parent_path(F.col("path")).alias("parent_path"))


@query("F13_unassigned", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def unassigned(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J1_material_assign", "select p_partkey, s_name as material from part left join supplier on s_suppkey = p_partkey % 150")
def material_assign(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 150).alias("m"))
    return p.join(table(spark, sf, "supplier"), F.col("m") == F.col("s_suppkey"), "left").select("p_partkey", F.col("s_name").alias("material"))


@query("J2_metadata_index", "with d as (select p_type, row_number() over (order by p_type) as i from (select distinct p_type from part)) select p_partkey, d.p_type as metadata from part join d on d.i = p_partkey % 6 + 1")
def metadata_index(spark, sf):
    p = table(spark, sf, "part")
    d = p.select("p_type").distinct().select(F.col("p_type").alias("metadata"), F.row_number().over(Window.orderBy("p_type")).alias("i"))
    return p.select("p_partkey", (F.col("p_partkey") % 6 + 1).alias("i")).join(d, "i").select("p_partkey", "metadata")


@query("J5_faceset_material", "select n_nationkey, r_name as material from nation join region on n_regionkey = r_regionkey")
def faceset_material(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("material"))


@query("J6_collection_resolve", f"with {OBJECTS}, c as (select '/r' || (c_custkey % 7) as path, c_custkey as ord from customer) select c.ord, c.path from c where c.path in (select path from objects)")
def collection_resolve(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("/r"), F.col("c_custkey") % 7).alias("path"))
    return c.join(objects(spark, sf), "path", "left_semi").select("ord", "path")


@query("A1_object_counts", f"with {OBJECTS} select case depth when 1 then 'Xform' when 2 then 'Group' when 3 then 'Curves' else 'PolyMesh' end as class, count(*) as n from objects group by 1")
def object_counts(spark, sf):
    d = tree.depth_of(F.col("path"))
    schema = F.when(d == 1, "AbcGeom_Xform_v3").when(d == 2, "").when(d == 3, "AbcGeom_Curve_v2").otherwise("AbcGeom_PolyMesh_v1")
    return objects(spark, sf).groupBy(text.schema_class(schema).alias("class")).agg(F.count("*").alias("n"))


@query("C1_info", "select case when l_orderkey % 4 = 0 then 'PolyMesh' when l_orderkey % 4 = 1 then 'SubD' else 'Points' end as class, count(*) as objects, sum(case when l_orderkey % 4 < 2 then n else 0 end)::bigint as vertices, sum(case when l_orderkey % 4 < 2 then 1 else 0 end)::bigint as faces from (select l_orderkey, count(*) as n from lineitem group by 1) group by 1")
def info(spark, sf):
    m = F.col("l_orderkey") % 4
    kind = F.when(m == 0, "PolyMesh").when(m == 1, "SubD").otherwise("Points")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(kind.alias("class")).agg(F.count("*").alias("objects"), F.sum(F.when(m < 2, F.col("n")).otherwise(0)).alias("vertices"), F.sum(F.when(m < 2, 1).otherwise(0)).alias("faces"))


@query("C3_stats", "select o_custkey as path, count(*) as samples, sum(cast(o_totalprice as decimal(18,2)))::double as total, max(o_orderkey) as last from orders group by 1")
def stats(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("samples"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max("o_orderkey").alias("last"))


@query("C4_meta", "select p_partkey, 'brand=' || p_brand || ';name=' || p_name || ';type=' || p_type as metadata from part where contains(p_name, 'ring')")
def meta(spark, sf):
    m = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("name"), "p_name")
    return table(spark, sf, "part").filter(F.col("p_name").contains("ring")).select("p_partkey", text.metadata_to_text(m).alias("metadata"))


@query("A8_distinct_targets", "select distinct split_part(p_brand || '.' || p_type, '.', 1) as target from part")
def distinct_targets(spark, sf):
    return table(spark, sf, "part").select(F.substring_index(F.concat_ws(".", "p_brand", "p_type"), ".", 1).alias("target")).distinct()


@query("A9_copy_stats", "select p_type, count(*) as n from part group by 1")
def copy_stats(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))


@query("A10_material_histogram", "select c_mktsegment as material, count(*) as n from customer group by 1")
def material_histogram(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("material")).agg(F.count("*").alias("n"))


@query("O5_chain_union", "select s_suppkey, len(list_distinct([s_suppkey % 3, s_suppkey % 4, s_suppkey % 5]))::int as n from supplier")
def chain_union(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.size(F.array_union(F.array(k % 3, k % 4), F.array(k % 5))).alias("n"))


@query("C8_materialize", """with u as (select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)) select count(*) as unassigned, count(distinct c_name) as names from u""")
def materialize(spark, sf):
    return unassigned(spark, sf).join(table(spark, sf, "customer"), "c_custkey").agg(F.count("*").alias("unassigned"), F.count_distinct("c_name").alias("names"))


# names under which the queries on whole tables were first registered
for _name in ("C2_tree_listing", "R10_compound_walk", "R11_merkle"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]
