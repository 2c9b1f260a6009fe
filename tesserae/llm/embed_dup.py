"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned to the principal axes of all vectors, so that the leading
dimensions hold most of what tells them apart, and ordered by cells of the
first ones into tiles. Tiles meet by neighbouring cells, so that those far
apart never do, and are left out if their boxes are too far apart. Within
a pair of tiles products accumulate over the leading dimensions; a pair of
vectors is dropped as soon as its partial product plus the product of the
norms of what remains can't reach the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read
from tesserae.llm.components import connected_components
from tesserae.llm.near_dup import forest
from tesserae.llm.vectors import matrix, trusted, unit, usable, usable_vectors

#: Vectors of a tile, leading dimensions that order tiles, and those that bound them.
TILE, ORDERING, BOXED = 1024, 4, 8
#: Products this close to the threshold are settled on the original vectors.
CLOSE = 1e-9


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the axes (columns, by falling variance) of the unit vectors; d*d sums reach the driver."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for d in np.unique(dims).tolist():
                x = unit(matrix(batch.column(1).filter(pa.array(dims == d))))
                total[d] = total.get(d, 0) + x.T @ x
        for d, t in total.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(i), pa.array(j), pa.array(t.ravel())], names=["dim", "i", "j", "s"])

    found: dict[int, np.ndarray] = {}
    for d, i, j, s in vectors.select("dim", "vec").mapInArrow(sums, "dim int, i long, j long, s double").groupBy("dim", "i", "j").agg(F.sum("s")).collect():
        found.setdefault(d, np.zeros((d, d)))[i, j] = s
    return {d: np.linalg.eigh(t)[1][:, ::-1] for d, t in found.items()}


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the rows of a and b whose cosine is threshold at least."""
    ua, ub = unit(a), unit(b)
    x, y = ua @ axes, ub @ axes
    d = x.shape[1]
    cuts = sorted({min(d, c) for c in (8, 16, 32, d)})

    def rest(z, c):
        return np.sqrt(np.maximum((z[:, c:] ** 2).sum(axis=1), 0))

    c = cuts[0]
    part = x[:, :c] @ y[:, :c].T
    i, j = np.nonzero(part + np.outer(rest(x, c), rest(y, c)) >= threshold - CLOSE)
    p = part[i, j]
    for lo, c in zip(cuts, cuts[1:]):
        kept_i, kept_j, kept_p = [], [], []
        rx, ry = rest(x, c), rest(y, c)
        for at in range(0, len(i), 1 << 18):
            s = slice(at, at + (1 << 18))
            q = p[s] + np.einsum("nd,nd->n", x[i[s], lo:c], y[j[s], lo:c])
            on = q + rx[i[s]] * ry[j[s]] >= threshold - CLOSE
            kept_i.append(i[s][on])
            kept_j.append(j[s][on])
            kept_p.append(q[on])
        if kept_i:
            i, j, p = map(np.concatenate, (kept_i, kept_j, kept_p))
    sure = p >= threshold + CLOSE
    near = np.flatnonzero(~sure)
    if len(near):
        va, vb = a[i[near]], b[j[near]]
        with np.errstate(all="ignore"):
            norms = np.sqrt((va * va).sum(1)) * np.sqrt((vb * vb).sum(1))
            cosine = (va * vb).sum(1) / norms
        cosine = np.where(trusted(norms) & np.isfinite(cosine), cosine, (ua[i[near]] * ub[j[near]]).sum(1))
        sure[near] = cosine >= threshold
    return i[sure], j[sure]


def _near_tiles(tiles: DataFrame, reach: float) -> DataFrame:
    """(tile_a, tile_b, dim): each pair of tiles, and of a tile with itself, of one label whose boxes are within reach; once.

    A tile's level is the number of leading axes on which it lies in one
    cell, as wide as reach; as tiles follow the order of cells, few are of a
    low level. Of two tiles the one of the lower level gives its cell at that
    level, the other the neighbours of its own.
    """
    cells = [[F.floor(F.col(end)[k] / reach) for k in range(ORDERING)] for end in ("lo", "hi")]
    level = F.lit(ORDERING)
    for k in reversed(range(ORDERING)):
        level = F.when(cells[0][k] != cells[1][k], F.lit(k)).otherwise(level)
    boxes = tiles.select("label", "dim", "tile", "lo", "hi", F.array(*cells[0]).alias("cells"), level.alias("level"))
    around = lambda near, c: F.flatten(F.transform(near, lambda x: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.concat(x, F.array(c + d)))))
    nothing = F.array(F.array().cast("array<bigint>"))
    a = boxes.select("label", "dim", "level", F.slice("cells", F.lit(1), F.col("level")).alias("cell"), *(F.col(c).alias(f"{c}_a") for c in ("tile", "lo", "hi")))
    b = boxes.withColumn("own", F.col("level")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("level"))))
    b = b.withColumn("cell", F.explode(F.aggregate(F.slice("cells", F.lit(1), F.col("level")), nothing, around)))
    b = b.select("label", "dim", "level", "cell", "own", *(F.col(c).alias(f"{c}_b") for c in ("tile", "lo", "hi")))
    apart = F.aggregate(F.zip_with(F.arrays_zip("lo_a", "hi_a"), F.arrays_zip("lo_b", "hi_b"), lambda p, q: F.greatest(F.lit(0.0), p.lo_a - q.hi_b, q.lo_b - p.hi_a)), F.lit(0.0), lambda s, g: s + g * g)
    met = a.join(b, ["label", "dim", "level", "cell"]).filter((F.col("level") < F.col("own")) | (F.col("tile_a") <= F.col("tile_b")))
    return met.filter(apart <= reach * reach).select("tile_a", "tile_b", "dim")


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine, in double precision, is threshold at least.

    Returns one row for each input row: id_col, n_links (other vectors linked
    directly), component_id (smallest id reachable, its own included), kept
    (id equals component_id). Vectors that are null, zero or hold null or
    non-finite components, vectors without a label and rows without an id
    link with nothing, as do vectors of different dimensions. Equal vectors
    of one label count once in all comparisons and link with each other;
    rows that share an id link like rows of different ids. Other columns are
    not read. Needs integer ids and a threshold above 0.
    """
    spark, cuts = vectors.sparkSession, Cuts(vectors.sparkSession, "embed-dup")
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    named = usable_vectors(every.filter("label is not null"), "id", "vec", ("label",))
    named = cuts.write(named.withColumn("class", F.sha2(F.concat(F.to_json(F.struct("label")).cast("binary"), F.lit(b"\0"), F.col("vec")), 256)))
    classes = cuts.write(named.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = named.join(classes.select("class", F.col("rep").alias("id")), ["class", "id"], "left_semi").dropDuplicates(["class"])
    reps = cuts.write(reps.join(classes.select("class", "copies"), "class"))
    axes = principal_axes(reps)

    def place(batches):
        for batch in batches:
            dims, out = np.asarray(batch.column("dim")), np.zeros((batch.num_rows, ORDERING))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = unit(matrix(batch.column("vec").take(pa.array(at)))) @ axes[d][:, :ORDERING]
                out[at, : x.shape[1]] = x
            cell = np.floor(out / reach)
            cells = [pa.array(cell[:, k].astype(np.int32)) for k in range(ORDERING)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells, pa.array(out[:, 0])], names=[*batch.schema.names, *(f"c{k}" for k in range(ORDERING)), "first"])

    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    label_type = dict(reps.dtypes)["label"]
    order = ["label", "dim", *(f"c{k}" for k in range(ORDERING)), "first", "class"]
    placed = reps.select("class", "label", "dim", "vec", "copies").mapInArrow(place, f"class string, label {label_type}, dim int, vec binary, copies long, " + "".join(f"c{k} int, " for k in range(ORDERING)) + "first double")
    sorted_rows = cuts.write(placed).repartitionByRange(*order).sortWithinPartitions(*order)

    def gather(batches):
        label, dim, n, base, held = None, None, 0, TaskContext.get().partitionId() << 32, []

        def tiled():
            x = unit(np.frombuffer(b"".join(v for _, v, _ in held), np.float64).reshape(len(held), -1)) @ axes[dim]
            lo, hi = np.zeros(BOXED), np.zeros(BOXED)
            lo[: x.shape[1]], hi[: x.shape[1]] = x[:, :BOXED].min(0), x[:, :BOXED].max(0)
            columns = [base + n], [label], [dim], [lo.tolist()], [hi.tolist()], [[c for c, _, _ in held]], [[k for _, _, k in held]], [b"".join(v for _, v, _ in held)]
            types = pa.int64(), kind, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tile", "label", "dim", "lo", "hi", "ids", "copies", "vecs"])

        for batch in batches:
            kind = batch.column("label").type
            for c, lab, d, v, k in zip(*(batch.column(x).to_pylist() for x in ("class", "label", "dim", "vec", "copies"))):
                if held and ((lab, d) != (label, dim) or len(held) >= tile):
                    yield tiled()
                    held, n = [], n + 1
                label, dim = lab, d
                held.append((c, v, k))
        if held:
            yield tiled()

    tiles = cuts.write(sorted_rows.mapInArrow(gather, f"tile long, label {label_type}, dim int, lo array<double>, hi array<double>, ids array<string>, copies array<long>, vecs binary"))
    pairs = cuts.write(_near_tiles(tiles, reach))
    sides = [tiles.select(*(F.col(c).alias(f"{c}_{side}") for c in ("tile", "ids", "copies", "vecs"))) for side in "ab"]
    met = pairs.join(sides[0], "tile_a").join(sides[1], "tile_b").select("tile_a", "tile_b", "dim", "ids_a", "copies_a", "vecs_a", "ids_b", "copies_b", "vecs_b")

    def compare(batches):
        for batch in batches:
            for ta, tb, dim, ia, ka, va, ib, kb, vb in zip(*(batch.column(k) for k in range(9))):
                ia, ib = np.array(ia.as_py(), object), np.array(ib.as_py(), object)
                ka, kb = np.array(ka.as_py()), np.array(kb.as_py())
                d, same = dim.as_py(), ta.as_py() == tb.as_py()
                i, j = tile_links(*(np.frombuffer(v.as_py(), np.float64).reshape(-1, d) for v in (va, vb)), axes[d], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                n_a, n_b = (np.bincount(i, kb[j], len(ia)), np.bincount(j, ka[i], len(ib)))
                at_a, at_b = np.flatnonzero(n_a), np.flatnonzero(n_b)
                links = np.concatenate([n_a[at_a], n_b[at_b]]).astype(np.int64)
                nodes = np.concatenate([ia[at_a], ib[at_b]])
                kept = forest(i, (j if same else j + len(ia)), np.arange(len(ia) + len(ib)))
                left, right = ia[i[kept]], ib[j[kept]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes, left]), pa.string()), pa.array([None] * len(nodes) + right.tolist(), pa.string()), pa.array(np.concatenate([links, np.zeros(len(left), np.int64)]))],
                    names=["a", "b", "links"],
                )

    found = cuts.write(met.mapInArrow(compare, "a string, b string, links long"))
    links = cuts.write(found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links")))
    numbers = classes.select("class", "rep")
    edges = found.filter("b is not null").join(numbers.select(F.col("class").alias("a"), F.col("rep").alias("ra")), "a").join(numbers.select(F.col("class").alias("b"), F.col("rep").alias("rb")), "b")
    components = connected_components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")), cuts).withColumnRenamed("node", "rep")
    of_class = classes.join(links, "class", "left").join(components, "rep", "left")
    of_class = cuts.write(of_class.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = named.select("id", "class").join(of_class, "class").select("id", "n_links", "component_id")
    rest = every.filter(~(F.col("label").isNotNull() & usable("id", "vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def op1_embedding_duplicates(spark, sf_dir):
    return embedding_duplicates(read(spark, sf_dir, "embeddings"))
