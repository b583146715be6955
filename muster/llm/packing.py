"""Problem 8: items of varying length packed into containers of fixed capacity.

Only lengths matter for the plan. How many items there are of each length is counted over the
whole collection; the counts are dealt to cells (every cell gets its share of each length), and
each cell is planned by itself: an index of the lengths available answers which single, pair or
triple of them exactly fills a gap, and whole runs of equal containers are taken at once as far
as the counts allow. What no exact complement fills goes best-fit, largest first. The plan is
then laid over the items by their number within length and cell.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from muster.plans.lineage import cut, settled

CAPACITY = 2048
#: Items of one cell, about; a cell is planned in one task, from counts by length.
CELL_ITEMS = 100_000
#: Repeats of an item numbered at once.
REPEATS = 1_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_LOADED: dict = {}


def token_counts(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """(id, n_tokens, kept columns): tokens of each text by the tokenizer file, which every worker must have; null and empty texts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        if tokenizer not in _LOADED:
            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            _LOADED[tokenizer] = t
        for batch in batches:
            texts_ = [x or "" for x in batch.column(1).to_pylist()]
            lens = []
            for k in range(0, len(texts_), 256):
                lens += [len(e.ids) for e in _LOADED[tokenizer].encode_batch_fast(texts_[k : k + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lens, pa.int64()), *batch.columns[2:]], ["id", "n_tokens", *(keep or [])])

    kind = texts.select(id_col).dtypes[0][1]
    extra = "".join(f", {c} {texts.select(c).dtypes[0][1]}" for c in keep or [])
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(keep or [])).mapInArrow(run, f"id {kind}, n_tokens long{extra}")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers as (lengths, how many like it), for items of 1..capacity by length; every item is placed once.

    Largest length first: its gap is filled exactly by one, two or three lengths if there are any
    left, else by the best-fitting length, and so on while something fits.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []
    held = sum(1 << n for n in left)  # bit n: length n is left
    turned = sum(1 << (capacity - n) for n in left)

    def drop(n: int) -> None:
        nonlocal held, turned
        held ^= 1 << n
        turned ^= 1 << (capacity - n)
        del left[n]
        lengths.pop(bisect.bisect_left(lengths, n))

    def exact(gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        have = lambda n, more=0: left.get(n, 0) - used.get(n, 0) - more
        if have(gap) > 0:
            return (gap,)
        top = bisect.bisect_right(lengths, gap)
        for k in range(top - 1, -1, -1):  # the larger of a pair first
            n = lengths[k]
            if 2 * n < gap:
                break
            if have(n) > 0 and have(gap - n, int(gap - n == n)) > 0:
                return (n, gap - n)
        for k in range(top - 1, -1, -1):
            a = lengths[k]
            if 3 * a < gap:
                break
            if have(a) <= 0:
                continue
            rest = gap - a
            both = held & (turned >> (capacity - rest)) & ((2 << a) - 1)  # bit b: b, at most a, and rest - b are left
            while both:
                b = both.bit_length() - 1
                if 2 * b < rest:
                    break
                c = rest - b
                if have(b, int(a == b)) > 0 and have(c, int(a == c) + int(b == c)) > 0:
                    return (a, b, c)
                both ^= 1 << b
        return None

    while lengths:
        first = lengths[-1]
        inside, used, gap = [first], {first: 1}, capacity - first
        while gap:
            fill = exact(gap, used)
            if fill is None:
                k = bisect.bisect_right(lengths, gap) - 1
                while k >= 0 and left[lengths[k]] - used.get(lengths[k], 0) <= 0:
                    k -= 1
                if k < 0:
                    break
                fill = (lengths[k],)
            for n in fill:
                inside.append(n)
                used[n] = used.get(n, 0) + 1
                gap -= n
        times = min(left[n] // k for n, k in used.items())
        out.append((tuple(inside), times))
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                drop(n)
    return out


@settled
def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS) -> DataFrame:
    """(id, piece, n_tokens, container, offset): where each item, or piece of an item over the capacity, lies.

    An item over the capacity is cut into full pieces and a rest; no other is cut. Items of size
    null or 0 or less take no room and are left out. Repeated ids are items of their own. An empty
    table gives an empty result; other columns are ignored.
    """
    kind = items.select(id_col).dtypes[0][1]
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where(F.col("n") > 0)
    # Repeated items are told apart by their number, so that every run deals and names them alike, and repeats of one item are dealt to all cells.
    upto = lambda first, last: F.explode(F.sequence(first, last))
    copies = sized.groupBy("id", "n").agg(F.count(F.lit(1)).alias("copies"))
    blocks = copies.select("*", upto(F.lit(0), F.floor((F.col("copies") - 1) / REPEATS)).alias("block"))
    each = blocks.select("id", "n", upto(F.col("block") * REPEATS, F.least("copies", (F.col("block") + 1) * REPEATS) - 1).alias("copy"))
    pieces = each.select("id", "copy", "n", upto(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int")).alias("piece"))
    pieces = cut(pieces.select("id", "copy", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("n_tokens")), "pieces")
    total = pieces.count()
    cells = max(1, -(-total // cell_items))
    # Full pieces need no plan. The others are dealt to cells at random, evenly for each length.
    full = pieces.where(F.col("n_tokens") == capacity).select("id", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), F.col("id").cast("string"), "piece", F.col("copy").cast("string")).alias("container"), F.lit(0).alias("offset"))
    open_ = pieces.where(F.col("n_tokens") < capacity).withColumn("cell", F.pmod(F.xxhash64("id", "piece", "copy"), F.lit(cells)).cast("int"))
    counts = open_.groupBy("cell", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        """Slots of one cell: the k-th item of a length goes to a container and offset."""
        seen: dict[int, int] = {}
        rows: list[np.ndarray] = []
        box = 0
        for inside, times in plan(dict(zip(pdf["n_tokens"].tolist(), pdf["n"].tolist())), capacity):
            offset = 0
            for n in inside:
                k = seen.get(n, 0)
                rows.append(np.stack([np.full(times, n), np.arange(k, k + times), np.arange(box, box + times), np.full(times, offset)], axis=1))
                seen[n] = k + times
                offset += n
            box += times
        slots = np.concatenate(rows) if rows else np.empty((0, 4), dtype=np.int64)
        return pd.DataFrame({"cell": int(pdf["cell"].iloc[0]), "n_tokens": slots[:, 0].astype("int32"), "k": slots[:, 1].astype("int64"), "box": slots[:, 2].astype("int64"), "offset": slots[:, 3].astype("int32")})

    slots = counts.groupBy("cell").applyInPandas(lay, "cell int, n_tokens int, k long, box long, offset int")
    numbered = open_.withColumn("k", F.row_number().over(Window.partitionBy("cell", "n_tokens").orderBy("id", "piece", "copy")).cast("long") - 1)
    placed = numbered.join(slots, ["cell", "n_tokens", "k"]).select("id", "piece", "n_tokens", F.concat_ws("-", F.col("cell").cast("string"), F.col("box").cast("string")).alias("container"), "offset")
    return placed.unionByName(full).select(F.col("id").cast(kind), "piece", "n_tokens", "container", "offset")
