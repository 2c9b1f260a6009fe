"""Paths, names, metadata and codes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent_path(path: Column) -> Column:
    """Text before the last slash; '/' for a top-level path."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def last_component(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column) -> Column:
    """Proper ancestors of an absolute path, nearest last, without the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n <= 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.concat_ws("/", F.slice(parts, 1, k))))


def schema_class(schema: Column) -> Column:
    """Short class of a schema id, by the first of these parts that it holds; an empty id is a group, any other stays."""
    classes = ("Xform", "PolyMesh", "SubD", "Curve", "Points", "Camera", "Light", "FaceSet", "NuPatch", "Material")
    return F.coalesce(*(F.when(schema.contains(c), F.lit("Curves" if c == "Curve" else c)) for c in classes), F.when(schema == "", F.lit("Group")), schema)


def wildcard_match(name: Column, pattern: str) -> Column:
    """Name in lower case matched by a pattern with *: anchored at both ends unless * stands there; without *, anywhere."""
    if not pattern:
        return F.lit(True)
    lower, parts = F.lower(name), pattern.split("*")
    if len(parts) == 1:
        return lower.contains(pattern)
    import re

    # first hit of each part in turn, as a lazy regular expression finds it
    body = ".*?".join(re.escape(p) for p in parts)
    return lower.rlike(f"(?s)^{body}" + ("" if pattern.endswith("*") else "$"))


def path_material(path: Column) -> Column:
    """Kind of material that a path suggests: by keyword, else by a hash of its bytes."""
    # fixed values
    keywords = (
        ("glass", ("glass", "windshield", "window")),
        ("metal", ("chrome", "metal", "rim", "nuts", "bolt", "steel", "aluminum", "iron", "brake_disc", "baraban")),
        ("rubber", ("tire", "tyre", "rubber")),
        ("leather", ("leather", "seat", "interior")),
        ("plastic", ("plastic", "grill", "bumper")),
        ("metal", ("paint", "body")),
    )
    kinds = ("glass", "metal", "plastic", "leather", "rubber")
    lower = F.lower(path)
    found = [F.when(reduce(lambda a, b: a | b, (lower.contains(w) for w in words)), F.lit(kind)) for kind, words in keywords]
    return F.coalesce(*found, F.element_at(F.array(*map(F.lit, kinds)), (polynomial_hash(path) % len(kinds) + 1).cast("int")))


def polynomial_hash(text: Column) -> Column:
    """Sum of bytes times powers of 31, modulo 2^32."""
    digits = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, h: (a * 31 + F.conv(h, 16, 10).cast("long")).bitwiseAND(F.lit(4294967295)))


ESCAPED = r"([;=\\])"


def metadata_to_text(m: Column) -> Column:
    """key=value;... by key, with backslashes before ; = and backslash."""
    escape = lambda s: F.regexp_replace(s, ESCAPED, r"\\$1")
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(escape(e.key), F.lit("="), escape(e.value))), ";")


def text_to_metadata(text: Column) -> Column:
    """Inverse of metadata_to_text. Entries without = are skipped; of equal keys the last counts."""
    plain = lambda s: F.regexp_replace(s, r"\\(.)", "$1")
    entries = F.filter(F.regexp_extract_all(text, F.lit(r"((?:[^;\\]|\\.)+)"), F.lit(1)), lambda e: e.rlike(r"^(?:[^=\\]|\\.)*="))
    pairs = F.transform(entries, lambda e: F.struct(plain(F.regexp_extract(e, r"^((?:[^=\\]|\\.)*)=", 1)).alias("key"), plain(F.regexp_extract(e, r"^(?:[^=\\]|\\.)*=(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q.key == p.key))
    return F.map_from_entries(last)


def metadata_has(m: Column, wanted: Column) -> Column:
    """Every entry of wanted is in m."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.try_element_at(m, e.key) == e.value, F.lit(False)))


def version_text(version: Column) -> Column:
    """AABBCC as 'a.b.c'."""
    return F.format_string("%d.%d.%d", F.floor(version / 10000), F.floor(version / 100) % 100, version % 100)


def strings_of(raw: Column) -> Column:
    """Non-empty parts of text with NUL ends."""
    return F.filter(F.split(raw, "\\x00"), lambda s: s != "")


def code_names(code: Column, names: dict[int, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code), F.lit(other))


# fixed values: codes and their names
VISIBILITY = {-1: "deferred", 0: "hidden", 1: "visible"}
CURVE_TYPE = {0: "cubic", 1: "linear", 2: "variable"}
BASIS = {0: "none", 1: "bezier", 2: "bspline", 3: "catmull-rom", 4: "hermite", 5: "power"}
SCOPE = {"con": "constant", "uni": "uniform", "var": "varying", "vtx": "vertex", "fvr": "face-varying"}
PODS = {0: "bool_t", 1: "uint8_t", 2: "int8_t", 3: "uint16_t", 4: "int16_t", 5: "uint32_t", 6: "int32_t", 7: "uint64_t", 8: "int64_t", 9: "float16_t", 10: "float32_t", 11: "float64_t", 12: "string", 13: "wstring"}
POD_SPARK = {"bool_t": "boolean", "uint8_t": "smallint", "int8_t": "tinyint", "uint16_t": "int", "int16_t": "smallint", "uint32_t": "bigint", "int32_t": "int", "uint64_t": "decimal(20,0)", "int64_t": "bigint", "float16_t": "float", "float32_t": "float", "float64_t": "double", "string": "string", "wstring": "string"}


def strings_to_bytes(strings: Column) -> Column:
    """The inverse of strings_of: each string with a NUL after it."""
    return F.array_join(F.transform(strings, lambda x: F.concat(x, F.lit("\0"))), "")


def stats_line(kind: Column, points: Column, faces: Column, samples: Column, focal: Column, constant: Column) -> Column:
    """What a listing says of an object of a class: its sizes at the first sample and the number of samples; of other classes nothing."""
    tail = F.concat(samples.cast("string"), F.lit(" samples"))
    return (
        F.when(kind.isin("PolyMesh", "SubD"), F.concat(F.lit("- "), points.cast("string"), F.lit(" verts, "), faces.cast("string"), F.lit(" faces, "), tail))
        .when(kind == "Curves", F.concat(F.lit("- "), faces.cast("string"), F.lit(" curves, "), tail))
        .when(kind == "Points", F.concat(F.lit("- "), points.cast("string"), F.lit(" points, "), tail))
        .when(kind == "Camera", F.concat(F.format_string("- focal=%.1fmm, ", focal), tail))
        .when(kind == "Xform", F.concat(F.when(constant, F.lit("- static, ")).otherwise(F.lit("- animated, ")), tail))
        .otherwise(F.lit(""))
    )
