"""Problem 6: groups of texts that are edited copies of each other, by chosen paths.

Texts with the same set of word shingles form a class, which counts once from then on. A class
follows paths: at each step it goes where one of its shingles, drawn by a random order shared by
all (the least in it), leads, so that two classes stay together over a step with a probability
equal to their similarity. A path ends, after two steps at the least, as soon as its bucket is
small, and the bucket is compared pair by pair; in buckets still too large, where comparing is not cheaper, the classes start anew
with paths one step longer. For paths of d steps as many runs are made as it takes for a pair at
the threshold to meet in one of them with the wanted recall, so each pair is sought at a depth at
which its buckets end, with enough runs for that depth.

Rows that meet are told apart by how many of 64 draws they share, and pairs that pass are
verified on their whole sets. First each class is compared with its best partner only, and what
is verified is joined; from then on only pairs between groups still apart are compared, so a large
group of copies costs no more than its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.buckets import bucket_runs
from muster.llm.components import connected_components
from muster.llm.shingles import mix, shingle_runs, shingle_sets
from muster.plans.lineage import cut, cut_counted, release, settled

#: Random orders a class is drawn by; each gives 16 bits of its least shingle, of which four go along with a row.
ORDERS = 64
#: Steps of the first paths: their ends are told by 32 bits.
STEPS = 2
#: Wanted probability that a pair at the threshold is found by itself (without links through others).
RECALL = 0.99
#: Buckets up to this size are compared pair by pair.
BUCKET = 128
#: Comparisons within a bucket that cost about as much as one more row of a path.
PAIRS_A_ROW = 32
#: Sides of a join up to this many ids are broadcast.
BROADCAST_IDS = 1_000_000

_MUL = (mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Paths of so many steps after which a pair at the threshold has met with probability recall."""
    return max(1, ceil(log(1 - recall) / log(1 - min(threshold, 0.999) ** depth)))


def least_shared(threshold: float, recall: float) -> int:
    """The most draws a pair at the threshold shares with probability recall or more."""
    below, k = 0.0, 0
    while k < ORDERS:
        below += comb(ORDERS, k) * threshold**k * (1 - threshold) ** (ORDERS - k)
        if below > 1 - recall:
            break
        k += 1
    return k


def _paths(runs: int, depth: int) -> np.ndarray:
    rng = np.random.default_rng([6, depth])
    return np.stack([rng.choice(ORDERS, depth, replace=False) for _ in range(runs)])


def _signatures(min_chars: int):
    """Classes are told by the hashes of a text's shingles with their number of times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                doc, sh = shingle_runs([t if len(t.strip()) >= min_chars else "" for t in part.column(1).to_pylist()])
                if not len(sh):
                    continue
                starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                short = (sh >> np.uint64(32)).astype(np.uint32)
                draws = np.empty((len(starts), ORDERS), dtype=np.uint16)
                for j in range(ORDERS):
                    draws[:, j] = mix(np.minimum.reduceat((short ^ _XOR[j]) * _MUL[j], starts).astype(np.uint64)) & np.uint64(0xFFFF)
                cid = mix(np.add.reduceat(mix(sh), starts) ^ mix(np.add.reduceat(sh * (sh | np.uint64(1)), starts))).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[starts])), pa.array(cid), pa.array([x.tobytes() for x in draws], pa.binary())], ["id", "cid", "draws"])

    return run


def _short(draws: np.ndarray) -> list[bytes]:
    """Four bits of each draw, two draws a byte."""
    low = (draws & 15).astype(np.uint8)
    return [x.tobytes() for x in low[:, ::2] | (low[:, 1::2] << 4)]


def _posts(depth: int, runs: int):
    """(cid, colour, draws) to one row a run: (key of the path's end, cid, colour, four bits of each draw)."""
    paths = _paths(runs, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            draws = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(n, ORDERS)
            which = np.arange(runs, dtype=np.uint64)
            keys = np.full((n, runs), mix(np.array([depth], dtype=np.uint64))[0])
            for k in range(depth):
                keys = mix(keys ^ mix(draws[:, paths[:, k]].astype(np.uint64) + (which << np.uint64(20)) + np.uint64(1)))
            many = lambda c: pa.array(np.repeat(c.to_numpy(), runs))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), many(batch.column(0)), many(batch.column(1)), pa.array([x for x in _short(draws) for _ in range(runs)], pa.binary())], ["key", "cid", "colour", "draws"])

    return run


_POST = "key long, cid long, colour long, draws binary"


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            draws = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint16).reshape(-1, ORDERS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_short(draws), pa.binary())], ["key", "cid", "colour", "draws"])


def _close(shared: int, best: bool):
    """Pairs of a bucket of different colours that share enough draws; best: for each row only the best partner before it (after it, if none is before)."""

    def run(cols: list[np.ndarray], idx: np.ndarray) -> list[np.ndarray]:
        m = idx.shape[1]
        draws, colour, cid = cols[3][idx], cols[2][idx], cols[1][idx]
        same = np.zeros((len(idx), m, m), dtype=np.uint8)
        for j in range(ORDERS // 2):
            apart = draws[:, :, None, j] ^ draws[:, None, :, j]
            same += (apart & 15) == 0
            same += apart < 16
        same[(colour[:, :, None] == colour[:, None, :]) | (same < shared)] = 0
        if best:
            before = np.where(np.tril(np.ones((m, m), bool), -1), same, 0)
            none = before.max(axis=2, initial=0) == 0
            before[none] = same[none]
            run_, i = np.nonzero(before.max(axis=2, initial=0) > 0)
            j = before[run_, i].argmax(axis=1)
        else:
            run_, i, j = np.nonzero(np.triu(same, 1))
        a, b = cid[run_, i], cid[run_, j]
        return [np.minimum(a, b), np.maximum(a, b)]

    return run


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["cid", "shingles"])


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                xy = np.frombuffer(x + y, np.uint32).copy()
                xy.sort()
                both = int((xy[1:] == xy[:-1]).sum())
                keep.append(both >= threshold * (len(xy) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _usable(texts: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.where(F.length("text") >= min_chars)


@settled
def near_duplicate_groups(texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, min_chars: int = 30, bucket: int = BUCKET, recall: float = RECALL) -> DataFrame:
    """(id, group_id) of all texts near-duplicate to another, directly or through others.

    Similarity is the Jaccard index of the distinct runs of five words (runs of letters and
    digits, lower-cased). group_id is the least id of the group. A pair at the threshold is found
    by itself with probability recall; depth and number of paths follow from the two. Null, blank
    and short texts (under min_chars once trimmed) and texts of fewer than five words are in no
    group; a repeated id with the same text counts once. Copies join their class, however many
    they are. Ids may be strings or integers. An empty table gives an empty result; other columns
    are ignored.
    """
    kind = texts.select(id_col).dtypes[0][1]
    rows = _usable(texts, id_col, text_col, min_chars)
    each = 1 - (1 - recall) / 2  # half of what may be lost by the paths, half by the draws
    shared = least_shared(threshold, each)
    signed = cut(rows.mapInArrow(_signatures(min_chars), f"id {kind}, cid long, draws binary"), "signed")
    classes = cut(signed.groupBy("cid").agg(F.min("id").alias("id"), F.first("draws").alias("draws")), "classes")

    ids = cut(signed.select("id", "cid").distinct(), "ids")
    release(signed)

    def bucketed(posts: DataFrame, best: bool, limit: int = bucket, windows: bool = True) -> tuple[DataFrame, DataFrame]:
        """Pairs found, and (key, cid) of buckets over the limit."""
        out = bucket_runs(posts, limit, _close(shared, best), _PAIR, [0, 1], "big boolean, a long, b long, key long, cid long", "draws" if windows else None)
        out = cut(out.distinct(), "buckets")
        return out.where("NOT big").select("a", "b"), out.where("big").select("key", "cid")

    @settled
    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole shingle sets are similar enough; the sets come from the text of each class's least id."""
        ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = cut(classes.select("cid", "id").join(_small(cut(ends, "ends")), "cid"), "wanted")
        held = rows.join(_small(wanted), "id").select("cid", "text").mapInArrow(_sets, "cid long, shingles binary")
        sets = cut(held.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")
        one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        both = one.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_similar(threshold), "a long, b long")

    def tinted(which: DataFrame) -> DataFrame:
        """Rows of (.., cid) with the colour of their group so far."""
        return which.join(colour, "cid", "left").withColumn("colour", F.coalesce("colour", "cid"))

    def compared(mixed: DataFrame) -> DataFrame:
        """Pairs of different colours in mixed buckets, all: the rows outside a bucket's largest group with all its rows, chunk by chunk."""
        chunk = 2 * bucket
        nr, na = (F.ceil(F.col(c) / chunk).cast("int") for c in ("rest", "n"))
        place = lambda k, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), k).cast("int")
        fewer = mixed.where("colour <> main").withColumn("i", place(nr, 1)).withColumn("j", F.explode(F.sequence(F.lit(0), na - 1)))
        every = mixed.withColumn("j", place(na, 2)).withColumn("i", F.explode(F.sequence(F.lit(0), nr - 1)))
        keyed = fewer.unionByName(every).select(F.xxhash64("key", "i", "j").alias("key"), "cid", "colour").distinct()
        posts = keyed.join(classes.select("cid", "draws"), "cid").select("key", "cid", "colour", "draws").mapInArrow(_shortened, _POST)
        return bucketed(posts, False, limit=1 << 30, windows=False)[0]

    colour, depth = classes.select("cid", F.col("cid").alias("colour")), STEPS
    first = _posts(depth, runs_needed(threshold, each, depth))
    pairs, big = bucketed(classes.select("cid", F.col("cid").alias("colour"), "draws").mapInArrow(first, _POST), best=True)
    links = verified(pairs)
    again: DataFrame | None = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    while True:
        colour = connected_components(links, "a", "b").select(F.col("id").alias("cid"), F.col("group_id").alias("colour"))
        # A bucket over the limit whose rows are of one group needs no more; one with few others, or where it is cheaper, is compared whole.
        of = tinted(big)
        sizes = of.groupBy("key", "colour").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "colour")).alias("top"), F.sum("n").alias("n")).select("key", "n", (F.col("n") - F.col("top.n")).alias("rest"), F.col("top.colour").alias("main")).where("rest > 0")
        mixed, n_mixed = cut_counted(of.join(mixed, "key"), "mixed")
        found = None
        hot = None
        if n_mixed:
            deeper = mixed.where(F.col("rest") > bucket)
            hot = cut(deeper.select("cid").distinct(), "hot")
            cost = deeper.agg(F.sum(F.col("rest").cast("double"))).first()[0] or 0.0
            if cost <= hot.count() * runs_needed(threshold, each, depth + 1) * float(PAIRS_A_ROW):
                hot, whole = None, mixed
            else:
                whole = mixed.where(F.col("rest") <= bucket)
            found = compared(whole)
        if again is not None:  # the first buckets once more, all pairs between groups still apart
            posts = tinted(classes.join(again, "cid", "left_semi")).select("cid", "colour", "draws").mapInArrow(first, _POST)
            left, _ = bucketed(posts, False)
            found, again = left if found is None else found.unionByName(left), None
        if hot is not None:
            depth += 1
            posts = tinted(classes.join(hot, "cid", "left_semi")).select("cid", "colour", "draws").mapInArrow(_posts(depth, runs_needed(threshold, each, depth)), _POST)
            deep, big = bucketed(posts, False)
            found = deep if found is None else found.unionByName(deep)
        if found is not None:
            links = links.unionByName(verified(cut(found.distinct(), "pairs")))
        if hot is None:
            break

    colour = connected_components(links, "a", "b").select(F.col("id").alias("cid"), F.col("group_id").alias("g"))
    named = ids.join(colour, "cid", "left").withColumn("g", F.coalesce("g", "cid"))
    named = cut(named.select("id", "g"), "named")
    groups = named.groupBy("g").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(groups, "g").select("id", "group_id")


#: Query texts compared with all rows in one pass.
BLOCK = 2_000


def _against(ids: list, sets: list[np.ndarray], threshold: float, min_chars: int):
    """Near-duplicates of the query texts among a partition's texts, by counting shared shingles."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    sizes = np.array([len(s) for s in sets])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            texts = [t if len(t.strip()) >= min_chars else "" for t in batch.column(1).to_pylist()]
            for k, s in enumerate(shingle_sets(texts)):
                if not len(s):
                    continue
                a, b = np.searchsorted(every, s), np.searchsorted(every, s, "right")
                if not (b > a).any():
                    continue
                both = np.bincount(np.concatenate([owner[x:y] for x, y in zip(a, b) if y > x]), minlength=len(sets))
                for q in np.flatnonzero(both >= threshold * (sizes + len(s) - both)):
                    one.append(ids[q])
                    two.append(k)
            other = batch.column(0).take(pa.array(two, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(one, other.type), other], ["id", "other"])

    return run


def measured_recall(texts: DataFrame, queries: DataFrame, id_col: str, text_col: str, threshold: float = 0.5, min_chars: int = 30, block: int = BLOCK) -> DataFrame:
    """(n_queries, n_true, n_found, recall) of the groups, against comparing each text of queries with all others, in blocks."""
    rows = _usable(texts, id_col, text_col, min_chars).distinct()
    kind = texts.select(id_col).dtypes[0][1]
    asked = _usable(queries, id_col, text_col, min_chars).distinct()
    asked = cut(asked.withColumn("part", F.xxhash64("id")), "asked")
    parts = max(1, -(-asked.count() // block))
    true = rows.select("id", F.col("id").alias("other")).where(F.lit(False))
    for p in range(parts):
        held = asked.where(F.pmod("part", F.lit(parts)) == p).select("id", "text").collect()  # about `block` rows
        sets = [(r.id, s) for r, s in zip(held, shingle_sets([r.text if len(r.text.strip()) >= min_chars else "" for r in held])) if len(s)]
        if sets:
            near = rows.mapInArrow(_against([i for i, _ in sets], [s for _, s in sets], threshold, min_chars), f"id {kind}, other {kind}")
            true = true.unionByName(cut(near.where("id <> other").distinct(), "exact"))
    groups = near_duplicate_groups(texts, id_col, text_col, threshold, min_chars)
    g = groups.select(F.col("id").alias("other"), F.col("group_id").alias("h"))
    met = true.join(groups, "id", "left").join(g, "other", "left").agg(F.count(F.lit(1)).alias("n_true"), F.count_if(F.col("group_id") == F.col("h")).alias("n_found"))
    return asked.agg(F.count_distinct("id").alias("n_queries")).crossJoin(met).select("n_queries", "n_true", "n_found", F.try_divide("n_found", "n_true").alias("recall"))  # one row each
