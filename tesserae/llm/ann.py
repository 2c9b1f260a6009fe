"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in their order. It is posted in
the inverted files of the first of them; a query reads the files of its own
nearest pivots, ranks what they hold by the footrule distance of the ordered
pivots, and reranks the front by cosine on the original vectors. The number
of pivots grows with the square root of the vectors, so the share of them
that a query reads falls as they grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import Cuts, read
from tesserae.llm.near_dup import _groups
from tesserae.llm.vectors import matrix, trusted, unit, usable_vectors

#: Pivots: so many times the square root of the vectors, but one for 4 vectors and PIVOTS at most; the vectors with the smallest hashes, a bounded sample.
A_ROOT, PIVOTS = 6, 16_384
#: Nearest pivots whose order is compared.
ORDERED = 32
#: Files that a vector is posted in, files that a query reads, part of a file that is reranked.
POSTED, PROBED, RERANKED = 4, 128, 0.6
#: Vectors of one block of a file, and queries compared with it at a time; values of a step of the comparison.
BLOCK, QUERIES, STEP = 8192, 2048, 1 << 22


def ordered_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """For each row of x its n nearest pivots, nearest first, ties to the first pivot."""
    c = unit(x) @ pivots.T
    near = np.sort(np.argpartition(-c, n - 1, axis=1)[:, :n], axis=1) if n < c.shape[1] else np.broadcast_to(np.arange(n), c.shape)
    order = np.argsort(-np.take_along_axis(c, near, axis=1), axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1).astype(np.int32)


def footrule(q: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """Footrule distances between rows of ordered pivots (of m); a pivot that isn't listed counts as next after the list. A row for each of q; a constant is left out."""
    n = q.shape[1]
    place = np.full((len(q), m), n, np.int16)
    np.put_along_axis(place, q, np.broadcast_to(np.arange(n, dtype=np.int16), q.shape), axis=1)
    at = place[:, x]
    return (np.abs(at - np.arange(n, dtype=np.int16)) + at - n).sum(axis=2, dtype=np.int64)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row of q with each row of the same place in x (queries, rows, components), in double precision; equal rows have equal cosines."""
    q = q[:, None, :]
    with np.errstate(all="ignore"):
        norms = np.sqrt((q * q).sum(axis=2)) * np.sqrt((x * x).sum(axis=2))
        c = (x * q).sum(axis=2) / norms
    bad = ~(trusted(norms) & np.isfinite(c))
    if bad.any():
        i, j = np.nonzero(bad)
        c[i, j] = (unit(x[i, j]) * unit(q[i, 0])).sum(axis=1)
    return c


def copies(ids: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct ids of each code (0, 1, ..), most at most: all in one array, and where those of a code begin."""
    order = np.lexsort((ids, code))
    c, i = code[order], ids[order]
    new = np.append(True, (c[1:] != c[:-1]) | (i[1:] != i[:-1]))
    c, i = c[new], i[new]
    few = np.arange(len(c)) - np.searchsorted(c, c) < most
    c, i = c[few], i[few]
    return i, np.searchsorted(c, np.arange(c[-1] + 2))


def choose_pivots(vectors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Unit pivots of each dimension: its distinct vectors with the smallest hashes, most at most."""
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}
    found = {}
    for d, n in counts.items():
        m = max(1, min(most, n // 4, int(A_ROOT * n**0.5)))
        rows = vectors.filter(F.col("dim") == d).groupBy("vec").agg(F.count("*")).select("vec").orderBy(F.xxhash64("vec"), "vec").limit(m).collect()
        found[d] = unit(np.array([np.frombuffer(r["vec"], np.float64) for r in rows]))
    return found


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, reranked: float = RERANKED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest other vectors by cosine of each vector whose id is divisible by `every`.

    Returns query_id, rank (from 1, nearest first, ties to the smaller id),
    vec_id, score (cosine in double precision, on the original vectors). All
    candidates if they are fewer than k. Vectors that are null, zero or hold
    null or non-finite components, and rows without an id, take no part;
    vectors of another dimension than the query's are no candidates. Rows
    that share an id are one candidate: its best. Other columns are not
    read. Needs integer ids. Every vector is indexed; pivots are a bounded
    sample. Equal vectors of a block are ranked once, so copies push nothing
    out of the front. Queries that find fewer than k read all files instead.
    """
    cuts = Cuts(vectors.sparkSession, "permutation-index")
    rows = cuts.write(usable_vectors(vectors, id_col, vec_col))
    chosen = choose_pivots(rows, pivots)
    queries = rows.filter(F.col("id") % every == 0)
    found = cuts.write(_search(rows, queries, chosen, k, posted, probed, reranked))
    lacking = queries.select(F.col("id").alias("query_id")).distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k), "query_id", "left_anti")
    lacking = cuts.write(lacking)
    if not lacking.isEmpty():
        again = queries.join(lacking.withColumnRenamed("query_id", "id"), "id", "left_semi")
        found = found.join(lacking, "query_id", "left_anti").unionByName(_search(rows, again, chosen, k, 1, pivots, 1.0))
    return found.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, queries: DataFrame, chosen: dict, k: int, posted: int, probed: int, reranked: float) -> DataFrame:
    def post(files):
        def of(batches):
            for batch in batches:
                dims = np.asarray(batch.column("dim"))
                for d in np.unique(dims).tolist():
                    part, m = batch.filter(pa.array(dims == d)), len(chosen[d])
                    order = ordered_pivots(matrix(part.column("vec")), chosen[d], min(m, max(files, ORDERED)))
                    pivot = order[:, :files]
                    taken = part.take(pa.array(np.repeat(np.arange(len(order)), pivot.shape[1])))
                    near = [x.tobytes() for x in order[:, :ORDERED]]
                    near = pa.array(near, pa.binary()).take(pa.array(np.repeat(np.arange(len(order)), pivot.shape[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(pivot.ravel()), *taken.columns, near], names=["pivot", *taken.schema.names, "near"])

        return of

    schema = "pivot int, id long, dim int, vec binary, near binary"
    lists = rows.mapInArrow(post(posted), schema)
    reads = queries.mapInArrow(post(probed), schema)
    # large files and many queries are met in blocks
    keys = ["dim", "pivot"]
    sizes = lists.groupBy(keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = reads.groupBy(keys).agg(F.ceil(F.count("*") / QUERIES).alias("tiles"))
    table = Cuts(rows.sparkSession, "permutation-files").write(sizes.join(asked, keys))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lists.join(table, keys).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("tile", numbers("tiles")).withColumn("asks", F.lit(False))
    dealt_q = reads.join(table, keys).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).withColumn("block", numbers("blocks")).withColumn("asks", F.lit(True))
    columns = ["dim", "pivot", "block", "tile", "asks", "id", "vec", "near"]
    both = dealt.select(columns).unionByName(dealt_q.select(columns)).repartition("dim", "pivot", "block", "tile").sortWithinPartitions("dim", "pivot", "block", "tile", "asks", "id")
    sizes = {d: len(p) for d, p in chosen.items()}

    def compare(batches):
        for g in _groups(batches, ["dim", "pivot", "block", "tile"]):
            asks = np.asarray(g["asks"].combine_chunks())
            if asks.all() or not asks.any():
                continue
            ids, m = np.asarray(g["id"]), sizes[g["dim"][0].as_py()]
            near = np.frombuffer(b"".join(g["near"].to_pylist()), np.int32).reshape(len(ids), -1)
            # equal vectors count once, with as many ids as can be among the nearest; those with smaller ids come first
            vec = g["vec"].filter(pa.array(~asks)).combine_chunks().dictionary_encode()
            code = np.asarray(vec.indices)
            held, starts = copies(ids[~asks], code, k + 1)
            x, first = matrix(vec.dictionary), np.unique(code, return_index=True)[1]
            order = near[~asks][first]
            q_ids, qx, q_order = ids[asks], matrix(g["vec"].filter(pa.array(asks))), near[asks]
            front, place = max(1, int(np.ceil(reranked * len(x)))), np.arange(len(x))
            step = max(1, STEP // (len(x) * max(order.shape[1], x.shape[1])))
            for at in range(0, len(q_ids), step):
                part = slice(at, at + step)
                if front < len(x):
                    far = footrule(q_order[part], order, m) * len(x) + place
                    chosen_x = np.argpartition(far, front - 1, axis=1)[:, :front]
                else:
                    chosen_x = np.broadcast_to(place, (len(q_ids[part]), len(x)))
                c = cosines(qx[part], x[chosen_x])
                yield best_of(q_ids[part], chosen_x, c, held, starts, k)

    met = both.mapInArrow(compare, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_of(q_ids: np.ndarray, code: np.ndarray, c: np.ndarray, held: np.ndarray, starts: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest other ids of each query (a row of code and c), ties to smaller ids; each code stands for the ids held[starts[code] : starts[code + 1]]."""
    flat = code.ravel()
    times = starts[flat + 1] - starts[flat]
    row = np.repeat(np.repeat(np.arange(len(q_ids)), code.shape[1]), times)
    ids = held[np.repeat(starts[flat] - np.cumsum(times) + times, times) + np.arange(times.sum())]
    score = np.repeat(c.ravel(), times)
    other = ids != q_ids[row]
    row, ids, score = row[other], ids[other], score[other]
    order = np.lexsort((-score, ids, row))
    row, ids, score = row[order], ids[order], score[order]
    new = np.append(np.full(min(1, len(row)), True), (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))
    row, ids, score = row[new], ids[new], score[new]
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row[few]]), pa.array(ids[few]), pa.array(score[few])], names=["query_id", "vec_id", "score"])


def op10_nearest(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"))
