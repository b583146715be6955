"""Problem 3: values typed freely, mapped to the entries of a reference list.

The entries stand in a BK-tree under the Levenshtein distance, a true metric: at each node the
triangle inequality leaves only the children whose distance from the node can lie within the
radius. Many typed values walk the tree together. The list is cut into shards of about SHARD names;
each shard meets the distinct values in parts, one task a shard and part, which builds that shard's
tree only, and the winners of the shards are merged. Each distinct value is looked up once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from muster.plans.lineage import cut, cut_counted, settled

#: Names of one tree, and distinct values that meet it in one task, about.
SHARD, VALUES = 5_000, 5_000
#: A pair of values that at least one in HOT rows have is joined apart.
HOT = 1_000
#: Typing slips allowed (a slip: one character more, less or other, or two exchanged), by least length of the value.
SLIPS = ((8, 2), (5, 1))

#: Short forms people type, in full.
FIRST_WORDS = {"ft": "fort", "mt": "mount", "mtn": "mountain", "st": "saint", "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "lk": "lake", "l": "lake", "pt": "port"}
LAST_WORDS = {"jct": "junction", "jctn": "junction", "junct": "junction", "spgs": "springs", "spg": "springs", "spr": "springs", "sprgs": "springs", "hts": "heights"}
LEAD_IN = re.compile(r"^(?:the )?(?:city|town|village|township|borough|state|province|commonwealth) of ")
TRAILING = re.compile(r"(?: (?:area|rural|city limits|vicinity|usa|us))+$")


def plain(s: str) -> str:
    """Lower case, without accents, punctuation, digits and lead-ins; short forms in full; blanks single."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c)).lower()
    s = re.sub(r"(?<=\w)['’.](?=\w)", "", s)
    s = " ".join(re.findall(r"[^\W_]+", s))
    s = re.sub(r"(?: \d+)+$", "", s)
    s = TRAILING.sub("", LEAD_IN.sub("", s))
    w = s.split()
    if len(w) > 1:
        w[0] = FIRST_WORDS.get(w[0], w[0])
        w[-1] = LAST_WORDS.get(w[-1], w[-1])
    return " ".join(w)


def levenshtein_many(word: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distances of one word (codes) to many values (rows of codes, padded by 0)."""
    n, width = values.shape
    step = np.arange(width + 1, dtype=np.int16)
    row = np.broadcast_to(step, (n, width + 1)).copy()
    for i, c in enumerate(word, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        np.minimum(row[:, :-1] + (values != c), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[np.arange(n), lengths]


def slips(a: str, b: str) -> int:
    """Damerau's distance with unrestricted exchanges, a true metric."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = np.full((len(a) + 2, len(b) + 2), top, dtype=np.int64).tolist()
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            if a[i - 1] == b[j - 1]:
                cost, seen = 0, j
            else:
                cost = 1
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


class BKTree:
    """A BK-tree over distinct words, walked by many values at once."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.codes = [np.array([ord(c) for c in w], dtype=np.int32) for w in self.words]
        self.children: list[dict[int, int]] = [{} for _ in self.words]
        self.longest = max(map(len, self.words), default=0)
        codes, lengths = self._pad(self.words)
        todo = [np.arange(len(self.words))] if self.words else []
        while todo:  # the first of a group is its node; the others hang below it by their distance
            node, rest = todo[-1][0], todo.pop()[1:]
            if len(rest):
                far = levenshtein_many(self.codes[node], codes[rest], lengths[rest])
                for d in np.unique(far):
                    below = rest[far == d]
                    self.children[node][int(d)] = int(below[0])
                    todo.append(below)

    @staticmethod
    def _pad(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(v) for v in values])
        out = np.zeros((len(values), max(1, int(lengths.max(initial=0)))), dtype=np.int32)
        for k, v in enumerate(values):
            out[k, : len(v)] = [ord(c) for c in v]
        return out, lengths

    def within(self, values: list[str], radius: np.ndarray) -> list[list[str]]:
        """For each value all words within its radius."""
        found: list[list[str]] = [[] for _ in values]
        if not self.words or not values:
            return found
        able = [k for k, v in enumerate(values) if len(v) <= self.longest + radius[k]]  # longer ones are too far from every word
        if not able:
            return found
        some = [values[k] for k in able]
        for k, words in zip(able, self._walk(some, np.asarray(radius)[able])):
            found[k] = words
        return found

    def _walk(self, values: list[str], radius: np.ndarray) -> list[list[str]]:
        found: list[list[str]] = [[] for _ in values]
        codes, lengths = self._pad(values)
        todo = [(0, np.arange(len(values)))]
        while todo:
            node, who = todo.pop()
            d = levenshtein_many(self.codes[node], codes[who], lengths[who])
            for k in who[d <= radius[who]]:
                found[k].append(self.words[node])
            for at, child in self.children[node].items():
                near = who[np.abs(d - at) <= radius[who]]
                if len(near):
                    todo.append((child, near))
        return found


def _bare(s: str | None) -> str:
    return plain(s or "").replace(" ", "")


def _bared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_bare(x) for x in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], ["name", *batch.schema.names[1:]])


def _searched(allowed_by_length: tuple):
    """A shard's names and a part of the values: (value, name, slips) within the allowed slips."""

    def run(values: pa.Table, names: pa.Table) -> pa.Table:
        tree = BKTree(names.column("name").to_pylist())
        todo = sorted(values.column("value").to_pylist(), key=len)
        found: list[tuple[str, str, int]] = []
        for k in range(0, len(todo), 2_000):
            part = todo[k : k + 2_000]
            allowed = [slips_within(len(v), allowed_by_length) for v in part]
            for v, most, near in zip(part, allowed, tree.within(part, np.array([2 * n for n in allowed]))):  # an exchange is two Levenshtein steps
                found += [(v, w, n) for w in near if (n := slips(v, w)) <= most]
        return pa.table({"value": pa.array([f[0] for f in found], pa.string()), "name": pa.array([f[1] for f in found], pa.string()), "slips": pa.array([f[2] for f in found], pa.int32())})

    return run


def slips_within(n: int, allowed_by_length: tuple = SLIPS) -> int:
    return next((most for size, most in allowed_by_length if n >= size), 0)


def nearest_entries(values: DataFrame, names: DataFrame, allowed_by_length: tuple = SLIPS, shard: int = SHARD, part: int = VALUES) -> DataFrame:
    """(value, near): near the entries within the slips allowed, as (slips, entry), fewest slips first; values without any are left out.

    values: (value), distinct; names: (name, entry, exact), exact names being found by equal values
    only. A value equal to a name has that name's entries alone. Names and values may be many: shards
    of names meet parts of the values.
    """
    kind = dict(names.dtypes)["entry"]
    names = cut(names.where("name <> ''").distinct(), "names")
    equal = values.join(names, values["value"] == names["name"]).select("value", F.when(F.col("exact"), -1).otherwise(0).alias("slips"), "entry")
    equal = cut(equal, "equal")
    fewest = min((size for size, _ in allowed_by_length), default=1 << 30)
    far, n_far = cut_counted(values.where(F.length("value") >= fewest).join(equal.select("value").distinct(), "value", "left_anti"), "far")
    words, n_words = cut_counted(names.where("NOT exact").select("name").distinct(), "words")
    shards, parts = max(1, -(-n_words // shard)), max(1, -(-n_far // part))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    sides = (far.select("value", place("value", parts).alias("part"), each(shards).alias("shard")), words.select("name", each(parts).alias("part"), place("name", shards).alias("shard")))
    one, two = (x.repartition(min(shards * parts, 2_000), "shard", "part").groupBy("shard", "part") for x in sides)
    near = one.cogroup(two).applyInArrow(_searched(allowed_by_length), "value string, name string, slips int")
    found = equal.unionByName(near.join(names.where("NOT exact"), "name").select("value", "slips", F.col("entry").cast(kind)))
    return cut(found.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("slips", "entry"))).alias("near")), "near")


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plain values to look up for a typed city and state: city, city before its last comma, what follows it, state."""
    for batch in batches:
        c, h, t, s, open_ = [], [], [], [], []
        for city, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            head, comma, tail = (city or "").rpartition(",")
            c.append(_bare(city))
            s.append(_bare(state))
            h.append(_bare(head) if comma else None)
            t.append(_bare(tail) if comma else None)
            open_.append(bool(comma) and not plain(tail))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in (c, h, t, s)), pa.array(open_)], ["city", "state_prov", "n", "c", "h", "t", "s", "open"])


def _state(near: list[dict] | None) -> str:
    best = {x["entry"] for x in near or [] if x["slips"] == near[0]["slips"]}
    return best.pop() if len(best) == 1 else ""


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place and state meant, from what was found near each part."""
    for batch in batches:
        places, states = [], []
        for row in batch.to_pylist():
            code, near, hint = _state(row["near_s"]), row["near_c"] or [], ""
            if row["h"] is not None and (not near or near[0]["slips"] > 0):
                hint = _state(row["near_t"])
                if hint or row["open"]:
                    near = row["near_h"] or []
            where = code or hint
            pool = [x["entry"] for x in near if x["slips"] == near[0]["slips"]]
            here = [x for x in near if x["entry"]["state"] == where]
            if len({x["id"] for x in pool}) > 1 and here:
                pool = [x["entry"] for x in here if x["slips"] == min(y["slips"] for y in here)]
            places.append(str(min(pool, key=lambda x: (-x["population"], x["id"]))["id"]) if pool else "")
            states.append(code)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in ("city", "state_prov", "n")), pa.array(places, pa.string()), pa.array(states, pa.string())], ["city", "state_prov", "n", "place", "state"])


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "") != "")


@settled
def map_places(comments: DataFrame, places: DataFrame, states: DataFrame, allowed_by_length: tuple = SLIPS, shard: int = SHARD) -> DataFrame:
    """(id, field, ref_key): the entry meant by each filled city and state_prov of a comment, '' if none is.

    comments: id, city, state_prov; a repeated id with the same values counts once. A city is found
    under its name or former name; where the name has several entries, or several are equally near,
    the state given (in state_prov, or after a comma) decides, and without one the larger place.
    allowed_by_length: (least length, slips) from the longest down. Null and blank fields give no
    row; placeholders and unknown names give ''. Empty tables give an empty result (or ''
    throughout for empty reference lists); other columns are ignored.
    """
    spark = comments.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = comments.where(F.col("id").isNotNull() & (_filled("city") | _filled("state_prov"))).select("id", "city", "state_prov").distinct()
    typed = rows.groupBy("city", "state_prov").agg(F.count(F.lit(1)).alias("n")).repartition(tasks, "city", "state_prov")
    typed = cut(typed.mapInArrow(_parted, "city string, state_prov string, n long, c string, h string, t string, s string, open boolean"), "typed")

    entry = F.struct(F.col("place_id").alias("id"), F.col("state_code").alias("state"), F.coalesce("population", F.lit(0)).alias("population"))
    entry_kind = "struct<id:{0},state:string,population:{1}>".format(*(dict(places.dtypes)[c] for c in ("place_id", "population")))
    place_names = places.select(F.explode(F.array("city", "former_name")).alias("name"), entry.alias("entry")).where("name IS NOT NULL").mapInArrow(_bared, f"name string, entry {entry_kind}").withColumn("exact", F.lit(False))
    known = states.where(F.col("state_code").isNotNull() & F.col("state_name").isNotNull())
    state_names = known.select(F.col("state_name").alias("name"), F.col("state_code").alias("entry")).mapInArrow(_bared, "name string, entry string").withColumn("exact", F.lit(False))
    state_names = state_names.unionByName(known.select(F.lower("state_code").alias("name"), F.col("state_code").alias("entry"), F.lit(True).alias("exact")))

    def looked_up(names: DataFrame, *cols: str) -> DataFrame:
        values = typed.select(F.explode(F.array(*cols)).alias("value")).where("value <> ''").distinct()
        return nearest_entries(values, names, allowed_by_length, shard)

    by_place, by_state = looked_up(place_names, "c", "h"), looked_up(state_names, "s", "t")
    for c, found in (("c", by_place), ("h", by_place), ("s", by_state), ("t", by_state)):
        typed = typed.join(found.select(F.col("value").alias(c), F.col("near").alias(f"near_{c}")), c, "left")
    mapped = typed.repartition(tasks, "city", "state_prov").mapInArrow(_resolved, "city string, state_prov string, n long, place string, state string")
    mapped = cut(mapped, "mapped")

    # Pairs of values that many rows have (at most HOT of them) go to the rows; the others are joined on both values.
    total = mapped.agg(F.sum("n")).first()[0] or 0
    m = mapped.select(F.col("city").alias("c"), F.col("state_prov").alias("s"), "place", "state", (F.col("n") * HOT >= total).alias("hot"))
    same = F.col("city").eqNullSafe(F.col("c")) & F.col("state_prov").eqNullSafe(F.col("s"))
    marked = rows.join(F.broadcast(m.where("hot")), same, "left").select("id", "city", "state_prov", "place", "state", "hot")
    rest = marked.where("hot IS NULL").select("id", "city", "state_prov").join(m.where("NOT hot"), same)
    both = marked.where("hot").drop("hot").unionByName(rest.select("id", "city", "state_prov", "place", "state"))
    fields = F.array(
        F.when(_filled("city"), F.struct(F.lit("city").alias("field"), F.col("place").alias("ref_key"))),
        F.when(_filled("state_prov"), F.struct(F.lit("state_prov").alias("field"), F.col("state").alias("ref_key"))),
    )
    return both.select("id", F.explode(fields).alias("f")).where("f IS NOT NULL").select("id", "f.field", "f.ref_key").distinct()
