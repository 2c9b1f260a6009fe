"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A narrow pass hashes each text's word shingles; the k smallest hash values
   are its sketch, a digest of all of them its class (equal sets link without
   comparison, so copies of any number count once from here on).
2. Inverted lists of the retained values generate overlaps. What a document
   shares with the smallest document of its lists is counted without any
   comparison, and connects most copies. Only lists that still hold several
   parts are compared sketch by sketch, on each document's rarest values, so
   a passage that very many documents share generates nothing by itself. The
   union sketch estimates; what can't reach the threshold goes.
3. Groups of candidates are verified on their full sets: first in tiles of
   bounded size, each also with its group's first tile; then, in groups that
   this leaves in parts, lists of the values that several parts hold tell
   which documents can have a link to another part, and only these meet.

A document of up to WHOLE shingles has its whole set as a sketch, so its
overlaps are exact and need no third step. Documents that are larger, or
could be similar to a larger one, have sketches of K. A pair at the threshold
fails step 2 only if fewer than NEED of the K smallest values of its union
are in both, which has a probability of 7e-9 at most. Links are confirmed on
64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read
from tesserae.llm.components import connected_components
from tesserae.llm.tokens import texts_of

#: Retained values of a sketch, and how many two sketches of similar documents share at least.
K, NEED = 48, 21
#: Least similarity for which NEED holds.
LEAST_PERCENT = 80
#: Sets up to this size are retained whole and compared exactly, as a passage that many short documents share is most of such a set.
WHOLE = 160
#: Documents, and shingles, of a tile.
TILE_DOCS, TILE_SHINGLES = 256, 400_000
#: Rows of four numbers, counted beforehand, that go to all executors (about 30 MB) so that the texts needn't be shuffled to them.
BROADCAST_ROWS = 500_000

_A = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words than width, of the whole sequence; of no words, none."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()  # of bytes: A to Z only, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    s = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        s = s * _A + h[k : len(words) - n + 1 + k]
    s = np.sort(_mixed(s))  # and not np.unique, which hashes before it sorts
    return s[np.append(True, s[1:] != s[:-1])]


def sketches(docs: DataFrame, width: int, k: int, whole: int) -> DataFrame:
    """id, n (size of the set), digest (of the whole set; null if empty), sketch (its k smallest hash values, or all of up to `whole`)."""
    id_type = docs.dtypes[0][1]

    def sketch(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            n, digests, lists = [], [], []
            for text in texts_of(batch.column(1)):
                s = shingle_hashes(text or b"", width)
                n.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                lists.append(s[: k if len(s) > whole else whole].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["id", "n", "digest", "sketch"])

    return docs.mapInArrow(sketch, f"id {id_type}, n long, digest binary, sketch array<long>")


def _groups(batches, keys: list[str]):
    """Tables of the consecutive rows with equal keys; rows must come sorted by them."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        key = tuple(c[0] for c in columns)
        if held and held[0] != key:
            yield pa.Table.from_batches(held[1:])
            held = []
        bounds = [0, *starts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            if lo:
                yield pa.Table.from_batches(held[1:])
                held = []
            held = held or [tuple(c[lo] for c in columns)]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held[1:])


def overlaps(sets: list[np.ndarray], of: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the intersections of sets; a row for each position in `of`, or for each set."""
    sizes = np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(code, minlength=len(values)) > 1  # the others meet nothing
    keep = often[code]
    code, row = (np.cumsum(often) - 1)[code[keep]], row[keep]
    of, step = np.arange(len(sets)) if of is None else of, 8192
    total = np.zeros((len(of), len(sets)), np.float64)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(code, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[lo:hi], code[lo:hi] - at] = 1
        total += m[of] @ m.T
    total = total.astype(np.int64)
    total[np.arange(len(of)), of] = sizes[of]
    return total


def across(comp: np.ndarray) -> np.ndarray:
    """Positions of what isn't in the most frequent part; a pair of different parts has one of them."""
    parts, code, times = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(code != times.argmax())


def forest(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> list[int]:
    """Positions of links (a, b) that join groups which neither start nor earlier links join."""
    parent = {x: x for x in start.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(start[a].tolist(), start[b].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept


def union_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of sorted full sketches: how many of the k smallest values of the union both have."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = both[:, 1:] == both[:, :-1]
    rank = np.cumsum(~twice, axis=1)  # of the distinct value
    return (twice & (rank <= a.shape[1])).sum(axis=1)


def _likely(sketch: list[np.ndarray], n: np.ndarray, comp: np.ndarray, whole: bool, percent: int, k: int, need: int):
    """Pairs of documents of different parts that may reach the threshold; if whole, sketches are sets, and they do."""
    of = across(comp)
    shared = overlaps(sketch, of)
    x, y = np.minimum(n[of][:, None], n), np.maximum(n[of][:, None], n)
    able = (100 * shared >= percent * (x + y - shared)) & (shared > 0) if whole else (shared >= need) & (100 * x >= percent * y)
    a, b = np.nonzero(able & (comp[of][:, None] != comp))
    a = of[a]
    if len(a) and not whole:
        block = np.array(sketch)
        rich = np.concatenate([union_estimates(block[a[at : at + 4096]], block[b[at : at + 4096]]) for at in range(0, len(a), 4096)]) >= need
        a, b = a[rich], b[rich]
    return a, b


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K, need: int = NEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of word shingles have a Jaccard similarity of percent/100 at least, directly or in steps.

    Returns one row for each input row: id_col, n_shingles (size of its set),
    component_id (smallest id reachable, its own included), kept (id equals
    component_id). Sets without words (null, empty or blank text) link with
    nothing. Rows with a null id take no part: component_id null, kept true.
    Rows that share an id are one document: a link of any of them counts.
    Other columns are not read. Needs integer ids, and a percent of 80 at
    least, for which K and NEED are chosen.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent must be {LEAST_PERCENT} at least, as sketches of {K} values lose links below")
    spark, cuts = docs.sparkSession, Cuts(docs.sparkSession, "near-dup")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = cuts.write(sketches(rows, width, k, WHOLE))
    named = s.filter("n > 0 and id is not null")
    classes = cuts.write(named.groupBy("digest").agg(F.min("id").alias("rep")))
    reps = named.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    reps = cuts.write(reps.select(F.col("id").alias("rep"), F.xxhash64("digest").alias("row"), "n", "sketch"))

    sure, groups = _candidates(reps, cuts, percent, k, need)
    links = _verified(rows, reps, sure, groups, cuts, width, percent)
    found = connected_components(links, cuts)
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    of_class = cuts.write(of_class)
    linked = named.join(of_class, "digest").select("id", "n", "component_id")
    rest = s.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def _candidates(reps: DataFrame, cuts: Cuts, percent: int, k: int, need: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that whole sets confirm, and (node, component) of documents that estimates connect."""
    # documents as whole sets, and those that may be similar to one beyond WHOLE by sketches of k
    small = reps.filter(F.col("n") <= WHOLE).select("rep", "row", "n", F.lit(True).alias("whole"), "sketch")
    large = reps.filter(100 * F.col("n") > percent * WHOLE).select("rep", "row", "n", F.lit(False).alias("whole"), F.slice("sketch", 1, k).alias("sketch"))
    postings = small.unionByName(large).select("rep", "row", "n", "whole", F.explode("sketch").alias("v"))
    lists = postings.groupBy("v", "whole").agg(F.count("*").alias("df"), F.min("rep").alias("leader"), F.min_by("row", "rep").alias("lead_row"), F.min_by("n", "rep").alias("lead_n"))
    lists = cuts.write(lists.filter("df > 1"))
    postings = cuts.write(postings.join(lists, ["v", "whole"]))
    # what shares enough with the leader of its lists; what this misses, the lists below find
    stars = postings.filter("leader <> rep").groupBy("rep", "row", "leader", "lead_row", "whole").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("lead_n").alias("lead_n"))
    shared, x, y = F.col("shared"), F.least("n", "lead_n"), F.greatest("n", "lead_n")
    enough = F.when(F.col("whole"), 100 * shared >= percent * (x + y - shared)).otherwise((shared >= need) & (100 * x >= percent * y))
    stars = cuts.write(stars.filter(enough).select(F.col("rep").alias("a"), F.col("leader").alias("b"), "whole"))
    exact, first = (cuts.write(connected_components(stars.filter(F.col("whole") == w), cuts).select(F.col("node").alias("rep"), F.col("component").alias("comp"), F.lit(w).alias("whole"))) for w in (True, False))

    # each document's rarest values suffice: similar documents share one of them
    of_row = Window.partitionBy("rep", "row", "whole")
    short = F.when(F.col("whole"), F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).otherwise(k - need + 1)
    # values that no other document shares come first
    alone = F.when(F.col("whole"), F.col("n")).otherwise(k) - F.count("*").over(of_row)
    rare = postings.withColumn("at", F.row_number().over(of_row.orderBy("df", "v")) + alone).filter(F.col("at") <= short).select("rep", "row", "n", "whole", "v", "at")
    rare = rare.join(exact.unionByName(first), ["rep", "whole"], "left").withColumn("comp", F.coalesce("comp", "rep"))
    rare = cuts.write(rare)
    mixed = cuts.write(rare.groupBy("v", "whole").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v", "whole"))
    rare = cuts.write(rare.join(mixed, ["v", "whole"]))
    sets = _able(rare.filter("whole"), ["v", "whole"], cuts, percent).select(rare.columns)
    tiled = _dealt(cuts.write(rare.filter("not whole").unionByName(sets)), ["v", "whole"], cuts).join(reps.select("rep", "row", "sketch"), ["rep", "row"])
    tiled = tiled.withColumn("sketch", F.when(F.col("whole"), F.col("sketch")).otherwise(F.slice("sketch", 1, k)))

    def compare(batches):
        for g in _groups(batches, ["v", "whole", "ti", "tj"]):
            ids, comp, n, whole = (*(np.asarray(g[c]) for c in ("rep", "comp", "n")), g["whole"][0].as_py())
            if comp.min() == comp.max():
                continue
            sketch = [np.array(x, np.int64).view(np.uint64) for x in g["sketch"].to_pylist()]
            a, b = _likely(sketch, n, comp, whole, percent, k, need)
            kept = forest(a, b, comp)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]]), pa.array([whole] * len(kept))], names=["a", "b", "whole"])

    dealt = tiled.select("v", "whole", "ti", "tj", "rep", "comp", "n", "sketch").repartition("v", "ti", "tj").sortWithinPartitions("v", "whole", "ti", "tj", "rep")
    found = cuts.write(dealt.mapInArrow(compare, "a long, b long, whole boolean"))
    edges = lambda comps, w: found.filter(F.col("whole") == w).select("a", "b").unionByName(comps.select(F.col("rep").alias("a"), F.col("comp").alias("b")))
    return edges(exact, True), cuts.write(connected_components(edges(first, False), cuts))


def _able(rare: DataFrame, keys: list[str], cuts: Cuts, percent: int) -> DataFrame:
    """Postings of rare values (keys, rep, comp, n, and `at`, the place of the value in its document's order) that may begin a link to another part.

    Where two documents first meet at places i and j, no more than the smaller
    of n - i + 1 and m - j + 1 values are in both. A link needs percent /
    (100 + percent) of n + m, so i allows sizes m up to a most; a posting
    stays if another part of its list has a document so small whose own most
    it doesn't exceed. Sums of parts decide; no postings meet.
    """
    most = F.floor((100 + percent) * (F.col("n") - F.col("at") + 1) / percent) - F.col("n")
    rare = rare.withColumn("most", most)
    parts = cuts.write(rare.groupBy(*keys, "comp").agg(F.min("n").alias("n"), F.max("most").alias("most")))
    best = cuts.write(parts.groupBy(*keys).agg(F.min(F.struct("n", "comp")).alias("small"), F.max(F.struct("most", "comp")).alias("wide")))
    met = parts.join(best, keys)
    other = lambda of, c: F.when(F.col("comp") != F.col(f"{of}.comp"), F.col(c))
    second = met.groupBy(*keys).agg(F.min(other("small", "n")).alias("next_n"), F.max(other("wide", "most")).alias("next_most"))
    least = F.coalesce(other("small", "small.n"), "next_n")
    widest = F.coalesce(other("wide", "wide.most"), "next_most")
    return rare.join(best.join(second, keys), keys).filter((F.col("most") >= least) & (F.col("n") <= widest))


def _dealt(rows: DataFrame, keys: list[str], cuts: Cuts, most: int = TILE_DOCS) -> DataFrame:
    """Adds ti and tj to rows (keys, rep, comp): tiles so that documents of different parts of a list meet, TILE_DOCS of a side at most.

    The largest part of a list is cut into tiles of its own, and meets only
    the rest; so rows repeat as often as the rest of their list, or for a row
    of the rest the list, fills tiles. A list that fits one tile isn't cut.
    """
    parts = cuts.write(rows.groupBy(*keys, "comp").agg(F.count("*").alias("size")))
    plan = parts.groupBy(*keys).agg(F.sum("size").alias("total"), F.max(F.struct("size", "comp")).alias("main"))
    ceil = lambda c: F.ceil(c / most).cast("long")
    plan = plan.select(*keys, F.col("main.comp").alias("main"), ceil(F.col("total")).alias("tiles"), ceil(F.col("main.size")).alias("mains"), ceil(F.col("total") - F.col("main.size")).alias("rests"))
    met = rows.join(cuts.write(plan), keys)
    tile = F.pmod(F.xxhash64("rep"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    met = met.withColumn("tile", tile)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    pair = lambda i, j: F.struct(i.alias("ti"), j.alias("tj"))
    of_main = F.transform(upto(F.col("rests")), lambda i: pair(i, F.col("rests") + F.col("tile")))
    others = F.filter(upto(F.col("rests")), lambda i: i != F.col("tile"))
    of_rest = F.concat(F.transform(others, lambda i: pair(F.least(F.col("tile"), i), F.greatest(F.col("tile"), i))), F.transform(upto(F.col("mains")), lambda j: pair(F.col("tile"), F.col("rests") + j)))
    whole = F.array(pair(F.lit(0).cast("long"), F.lit(0).cast("long")))
    places = F.when(F.col("tiles") == 1, whole).when(F.col("comp") == F.col("main"), of_main).otherwise(of_rest)
    return met.withColumn("place", F.explode(places)).withColumns({"ti": F.col("place.ti"), "tj": F.col("place.tj")}).drop("place", "tile", "main", "tiles", "mains", "rests")


def _near_tiles(rows: DataFrame) -> DataFrame:
    """Adds ti and tj to rows (grp, rep, tiles): each tile of a group with itself, and with the group's first."""
    tile, zero = F.pmod(F.xxhash64("rep"), F.col("tiles")), F.lit(0).cast("long")
    firsts = F.sequence(zero, F.col("tiles") - 1)
    others = F.when(F.col("tile") == 0, F.transform(firsts, lambda j: F.struct(zero.alias("ti"), j.alias("tj"))))
    others = others.otherwise(F.array(F.struct(zero.alias("ti"), F.col("tile").alias("tj")), F.struct(F.col("tile").alias("ti"), F.col("tile").alias("tj"))))
    return rows.withColumn("tile", tile).withColumn("at", F.explode(others)).withColumns({"ti": F.col("at.ti"), "tj": F.col("at.tj")}).drop("at", "tile")


def _verified(rows: DataFrame, reps: DataFrame, sure: DataFrame, groups: DataFrame, cuts: Cuts, width: int, percent: int) -> DataFrame:
    """Links (a, b) that hold on full sets and, with those that are sure, connect what all such links connect."""
    known = lambda links: cuts.write(connected_components(links, cuts).select(F.col("node").alias("rep"), F.col("component").alias("known")))
    sure = cuts.write(sure)
    sized = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(reps.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    sized = cuts.write(sized.join(known(sure), "rep", "left").select("rep", "grp", "n", F.coalesce("known", "rep").alias("comp")))
    count = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    sized = cuts.write(sized.join(cuts.write(count.filter("lo < hi").select("grp", "tiles")), "grp"))
    sized = sized.select("rep", "grp", "tiles", "comp")
    texts = cuts.write(rows.withColumnRenamed("id", "rep").join(F.broadcast(sized) if sized.count() <= BROADCAST_ROWS else sized, "rep"))

    def verify(batches):
        for g in _groups(batches, ["grp", "ti", "tj"]):
            ids, comp = (np.asarray(g[c]) for c in ("rep", "comp"))
            if comp.min() == comp.max():
                continue
            sets = [shingle_hashes(x or b"", width) for x in g["text"].cast(pa.binary()).to_pylist()]
            a, b = _likely(sets, np.array([len(x) for x in sets]), comp, True, percent, 0, 0)
            kept = forest(a, b, comp)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]])], names=["a", "b"])

    def run(tiled):
        dealt = tiled.select("grp", "ti", "tj", "rep", "comp", "text").repartition("grp", "ti", "tj").sortWithinPartitions("grp", "ti", "tj", "rep")
        return cuts.write(dealt.mapInArrow(verify, "a long, b long"))

    links = sure.unionByName(run(_near_tiles(texts)))
    large = texts.filter("tiles > 1")
    if large.isEmpty():
        return links
    large = large.drop("comp").join(known(links), "rep", "left").withColumn("comp", F.coalesce("known", "rep")).drop("known")
    split = cuts.write(large.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("grp"))
    left = cuts.write(large.join(split, "grp"))
    able = _across_parts(left, cuts, width, percent)
    return links.unionByName(run(_dealt(left.drop("tiles").join(able, ["grp", "rep"]), ["grp"], cuts)))


def _across_parts(texts: DataFrame, cuts: Cuts, width: int, percent: int) -> DataFrame:
    """(grp, rep) of the documents (grp, rep, comp, text) whose full sets allow a link to another part of their group.

    Only values that several parts of the group hold can be in such a link;
    a document's others come first in its order, then the rarest.
    """
    kinds = dict(texts.dtypes)

    def values(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                part = batch.slice(row, 64)
                sets = [shingle_hashes(x or b"", width) for x in part.column("text").cast(pa.binary()).to_pylist()]
                n = np.array([len(x) for x in sets])
                at = np.repeat(np.arange(len(sets)), n)
                ids = part.select(["grp", "rep", "comp"]).take(pa.array(at))
                row_hash = pa.array(np.repeat([int(x.sum(dtype=np.uint64).astype(np.int64)) for x in sets], n), pa.int64())
                yield pa.RecordBatch.from_arrays([*ids.columns, row_hash, pa.array(n[at], pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], names=["grp", "rep", "comp", "row", "n", "v"])

    held = cuts.write(texts.select("grp", "rep", "comp", "text").mapInArrow(values, f"grp {kinds['grp']}, rep long, comp long, row long, n long, v long"))
    lists = held.groupBy("grp", "v").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("grp", "v", "df")
    of_row = Window.partitionBy("grp", "rep", "row")
    met = held.join(cuts.write(lists), ["grp", "v"]).withColumn("c", F.count("*").over(of_row)).filter(100 * F.col("c") >= percent * F.col("n"))
    ranked = met.withColumn("at", F.row_number().over(of_row.orderBy("df", "v")) + F.col("n") - F.col("c")).filter(F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    ranked = cuts.write(ranked.select("grp", "v", "rep", "comp", "n", "at"))
    return cuts.write(_able(ranked, ["grp", "v"], cuts, percent).select("grp", "rep").distinct())


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=4)
