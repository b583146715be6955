"""Problem 1: the k most similar vectors of every vector, by a permutation index.

A vector is represented by the ordered list of its nearest pivots. It is posted in an inverted
file under each pair of its first pivots; in every posting list each vector's others are ranked by
the footrule distance of their pivot lists, and the best RERANKED of them are reranked by cosine on
8-bit vectors, at last on the stored ones. The number of pivots grows with the square root of the
number of vectors, so that a posting list keeps its length. A list over the limit is worked on by
pairs of chunks, so all its members still meet; vectors of one direction form a class, posted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from muster.llm.buckets import bucket_runs
from muster.llm.shingles import mix
from muster.plans.lineage import cut, cut_counted, settled

#: Pivots are a sample of the vectors, by hash: about PIVOTS_PER_ROOT times the root of their number.
PIVOTS_PER_ROOT = 3
#: Length of the ordered pivot lists, and how many of the first pivots are posted by twos.
LIST, POSTED = 8, 5
#: Longer posting lists are worked on by pairs of chunks.
POSTING = 1024
#: Of each list, so many by footrule distance (and those that tie with the last) are reranked for each vector.
RERANKED = 64
#: Kept beyond k until the exact rerank.
SPARE = 6
BROADCAST_IDS = 1_000_000


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors of length one) of the usable vectors: of dim finite numbers, not all zero."""
    sizes = np.diff(column.offsets.to_numpy())
    ok = np.flatnonzero((sizes == dim) & ~column.is_null().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls come as NaN
    fine = np.isfinite(x).all(axis=1)
    top = np.abs(x).max(axis=1, initial=0.0)
    fine &= top > 0
    ok, x = ok[fine], x[fine] / top[fine, None]
    return ok, x / np.linalg.norm(x, axis=1, keepdims=True)


def _quantise(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            q = np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8) if len(ok) else np.empty((0, dim), np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "q"])

    return run


def _unit(q: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _number(n_pivots: int) -> type:
    return np.uint16 if n_pivots <= 1 << 16 else np.uint32


def _post(pivots: np.ndarray, dim: int):
    """(key, cid, q, pivot list) for each posting of a vector."""
    pairs = list(combinations(range(min(POSTED, len(pivots))), 2)) or [(0, 0)]
    length = min(LIST, len(pivots))
    number = _number(len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            raw = batch.column(1).to_pylist()
            x = _unit(np.frombuffer(b"".join(raw), np.int8).reshape(n, dim))
            order = np.empty((n, length), number)
            for k in range(0, n, 2048):
                sim = x[k : k + 2048] @ pivots.T
                near = np.argpartition(-sim, length - 1, axis=1)[:, :length]
                rank = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
                order[k : k + 2048] = np.take_along_axis(near, rank, 1)
            two = np.sort(order[:, pairs].astype(np.uint64), axis=2)
            keys = mix((two[:, :, 0] << np.uint64(32)) + two[:, :, 1] + np.uint64(1)).view(np.int64)
            lists = [r.tobytes() for r in order]
            m = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), m)), pa.array([v for v in raw for _ in range(m)], pa.binary()), pa.array([v for v in lists for _ in range(m)], pa.binary())], ["key", "cid", "q", "pivots"])

    return run


def footrule(lists: np.ndarray) -> np.ndarray:
    """lists (runs, rows, length) of pivots: footrule distances (runs, rows, rows), a missing pivot standing after the last."""
    runs, rows, length = lists.shape
    shared = np.zeros((runs, rows, rows), np.int16)
    for i in range(length):
        for j in range(length):
            shared += (lists[:, :, None, i] == lists[:, None, :, j]) * np.int16(length - max(i, j))
    return length * (length + 1) - 2 * shared


def _rank(k: int, floor: float, number: type, reranked: int):
    def run(cols: list[np.ndarray], idx: np.ndarray) -> list[np.ndarray]:
        m = idx.shape[1]
        x = _unit(cols[2][idx].view(np.int8))
        sim = x @ x.transpose(0, 2, 1)
        far = footrule(cols[3][idx].view(number))
        far[:, np.arange(m), np.arange(m)] = np.iinfo(far.dtype).max
        last = min(reranked, m - 1) - 1
        bound = np.partition(far, last, axis=2)[:, :, last]
        sim[far > bound[:, :, None]] = -2
        sim[:, np.arange(m), np.arange(m)] = -2
        sim[sim < floor] = -2
        if m > k + 1:
            edge = -np.partition(-sim, k - 1, axis=2)[:, :, k - 1]
            sim[sim < edge[:, :, None]] = -2
        run_, a, b = np.nonzero(sim > -2)
        return [cols[1][idx[run_, a]], cols[1][idx[run_, b]], sim[run_, a, b].astype(np.float32)]

    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float32())])


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.float64).reshape(n, dim) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((both[0] * both[1]).sum(axis=1))], ["a", "b", "cosine"])

    return run


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["cid", "unit"])

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


@settled
def most_similar(vectors: DataFrame, id_col: str, vec_col: str, k: int = 10, dim: int = 64, min_cosine: float = -1.0, posting: int = POSTING, reranked: int = RERANKED) -> DataFrame:
    """(id, other, cosine): for each id the k most similar other ids with at least min_cosine; ties go to the lesser id.

    Vectors that are null, zero, not finite or not of dim numbers don't count. An id with several
    vectors counts once for each direction; ids of one direction (equal once rounded to 8 bits)
    are most similar to each other. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.select(id_col).dtypes[0][1]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    held = cut(rows.mapInArrow(_quantise(dim), f"id {kind}, q binary").withColumn("cid", F.xxhash64("q")), "quantised")
    classes = held.groupBy("cid").agg(F.first("q").alias("q"), F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    classes, n = cut_counted(classes, "classes")
    chance = min(1.0, PIVOTS_PER_ROOT * n**0.5 / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 30)) < int(chance * (1 << 30))).select("q").collect() or classes.select("q").limit(1).collect()
    pivots = _unit(np.array([np.frombuffer(r.q, np.int8) for r in drawn]).reshape(-1, dim)) if drawn else np.eye(1, dim, dtype=np.float32)

    posts = classes.select("cid", "q").mapInArrow(_post(pivots, dim), "key long, cid long, q binary, pivots binary")
    rank = _rank(k + SPARE, min_cosine - 0.02, _number(len(pivots)), reranked)
    out_schema = "big boolean, a long, b long, sim float, key long, cid long, q binary, pivots binary"
    out = cut(bucket_runs(posts, posting, rank, _FOUND, [0, 1, 2, 3], out_schema), "posted")
    found = out.where(~F.col("big")).select("a", "b", "sim")
    big = out.where("big").select("key", "cid", "q", "pivots")
    if not big.isEmpty():  # every chunk of a long list meets every other, and itself
        chunks = big.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (posting / 2)).cast("int").alias("chunks"))
        own, other = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"), F.col("other")
        spread = big.join(chunks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = spread.select(F.xxhash64("key", F.least("own", other), F.greatest("own", other)).alias("key"), "cid", "q", "pivots")
        out = cut(bucket_runs(met, 1 << 30, rank, _FOUND, [0, 1, 2, 3], out_schema), "posted")
        found = found.unionByName(out.select("a", "b", "sim"))

    near = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
    best = found.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + SPARE)
    best = cut(best.select("a", "b"), "best")
    ids = classes.select("cid", "id", "n")
    ends = best.select(F.col("a").alias("cid")).unionByName(best.select(F.col("b").alias("cid"))).distinct()
    wanted = cut(ids.join(_small(ends), "cid").select("cid", "id"), "wanted")
    units = rows.join(_small(wanted), "id").select("cid", "v").mapInArrow(_units(dim), "cid long, unit binary").groupBy("cid").agg(F.first("unit").alias("unit"))
    units = cut(units, "units")
    scored = best.join(units.select(F.col("cid").alias("a"), F.col("unit").alias("x")), "a").join(units.select(F.col("cid").alias("b"), F.col("unit").alias("y")), "b")
    scored = scored.select("a", "b", "x", "y").mapInArrow(_cosines(dim), "a long, b long, cosine double").where(F.col("cosine") >= min_cosine)

    # From classes back to ids: first those of its own class, then class by class while there is room.
    size = ids.select(F.col("cid").alias("a"), F.col("n").alias("na")), ids.select(F.col("cid").alias("b"), F.col("n").alias("nb"))
    before = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b").rowsBetween(Window.unboundedPreceding, -1)
    sized = scored.join(size[0], "a").join(size[1], "b").withColumn("room", F.lit(k) - (F.col("na") - 1) - F.coalesce(F.sum("nb").over(before), F.lit(0)))
    links = sized.where("room > 0").select("a", "b", "room", "cosine")
    own = ids.where("n > 1").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(k + 1).alias("room"), F.lit(1.0).alias("cosine"))
    links = links.unionByName(own)
    members = held.select("cid", "id").distinct()
    first = Window.partitionBy("cid").orderBy("id")
    firsts = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    pairs = links.join(firsts.select(F.col("cid").alias("b"), F.col("id").alias("other"), "r"), "b").where(F.col("r") <= F.col("room")).select("a", "other", "cosine")
    pairs = members.select(F.col("cid").alias("a"), "id").join(pairs, "a").where(F.col("id") != F.col("other"))
    last = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    pairs = pairs.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(last))
    return pairs.where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, k: int = 10, min_cosine: float = 0.9, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs where one is among the k most similar of the other and the cosine is at least min_cosine."""
    found = most_similar(vectors, id_col, vec_col, k=k, dim=dim, min_cosine=min_cosine)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


#: Query vectors compared with all rows in one pass.
BLOCK = 2_000


def exact_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, dim: int = 64, min_cosine: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(id, other, cosine) of the k most similar others of each id in queries, by comparing blocks of queries with all rows.

    The measure of most_similar, for a stated set of queries; each pass holds `block` query vectors
    and keeps k rows a query and partition.
    """
    kind = vectors.select(id_col).dtypes[0][1]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    asked = rows.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").mapInArrow(_ids_and_units(dim), f"id {kind}, unit binary")
    asked = cut(asked.groupBy("id").agg(F.first("unit").alias("unit")), "asked")
    n = asked.count()
    parts = max(1, -(-n // block))
    numbered = cut(asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))), "asked")
    found = None
    for p in range(parts):
        held = numbered.where(F.col("part") == p).select("id", "unit").collect()  # about `block` rows
        if not held:
            continue
        ids, q = [r.id for r in held], np.stack([np.frombuffer(r.unit, np.float64) for r in held])
        near = cut(rows.mapInArrow(_against(ids, q, k, dim, min_cosine), f"id {kind}, other {kind}, cosine double"), "exact")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine")).where(F.lit(False))
    last = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    return found.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).drop("r")


def _ids_and_units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "unit"])

    return run


def _against(ids: list, q: np.ndarray, k: int, dim: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _matrix(batch.column(1), dim)
            if not len(ok):
                continue
            other = batch.column(0).take(pa.array(ok))
            for a in range(0, len(x), 4096):
                s = q @ x[a : a + 4096].T
                if s.shape[1] > k + 1:
                    edge = -np.partition(-s, k, axis=1)[:, k]
                    s[s < edge[:, None]] = -2
                i, j = np.nonzero(s >= floor)
                one, two = pa.array([ids[x_] for x_ in i], other.type), other.take(pa.array(j + a))
                keep = pa.array([x_ != y_ for x_, y_ in zip(one.to_pylist(), two.to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([one, two, pa.array(s[i, j])], ["id", "other", "cosine"]).filter(keep)

    return run


def measured_recall(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, min_cosine: float = 0.9, dim: int = 64) -> DataFrame:
    """(n_queries, n_true, n_found, recall) of most_similar against exact_neighbours over the queries."""
    truth = exact_neighbours(vectors, queries, id_col, vec_col, k, dim, min_cosine).select("id", "other")
    got = most_similar(vectors, id_col, vec_col, k, dim, min_cosine).select("id", "other").withColumn("hit", F.lit(1))
    n = queries.select(F.count_distinct(id_col).alias("n_queries"))
    sums = truth.join(got, ["id", "other"], "left").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
    return n.crossJoin(sums).select("n_queries", "n_true", "n_found", F.try_divide("n_found", "n_true").alias("recall"))  # one row each
