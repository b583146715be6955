"""Problem 7: spellings of one organisation or one person, linked.

Distinct spellings are cut into tokens. A symmetric-delete index over the distinct tokens (each
posted under all strings left by dropping up to two of its characters) gives the tokens within a
small edit distance; a rare token is taken for a slip of the nearest better attested one. Invented
and family names lie the closer the more of them there are, so one is a slip of another only beside
the same ordinary words or the same given name, and what makes a word ordinary is its share of all. After
that the spellings of one name meet under one key: an organisation's distinctive word with its
ordinary words (order, "and", scope words, legal forms and short forms set aside), a person's
surname with the given name (nicknames, initials and shortened names resolved among the full given
names attested with that surname). The spellings under one key are held against the fullest of them
by an optimal assignment of their tokens. Organisations under different keys that share a distinctive
token are candidates too: they are one where the assignment pairs all their tokens, as equal, slip,
initial or abbreviation, so that short forms in no list are found. Lists of short forms and nicknames
are priors for the common ones. What is linked, directly or through others, is one entity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from muster.llm.canonical import slips
from muster.llm.components import connected_components
from muster.plans.lineage import cut, settled

# What people type in place of a name.
PLACEHOLDERS = {"", "-", "--", "?", "n/a", "na", "none", "null", "nil", "self", "individual", "myself", "anonymous", "anon", "unknown", "not applicable", "private", "private citizen", "citizen", "test", "x", "xx", "xxx", "xxxx", "no organization", "not provided", "withheld", "prefer not to say", "retired"}
TITLES = {"dr", "mr", "mrs", "ms", "miss", "mx", "prof", "rev", "hon", "sir", "fr", "sen", "rep", "capt", "sgt", "esq", "phd", "md", "dds", "rn", "cpa", "jd"}
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
LEGAL = {"inc", "incorporated", "llc", "llp", "ltd", "limited", "plc", "pc"}
STOP = {"the", "of", "and", "for", "a", "an", "in"}
SCOPES = {"international", "national", "regional", "united", "american"}
SHORT_FORMS = {
    "intl": "international", "int": "international", "internatl": "international", "natl": "national", "nat": "national", "nationl": "national", "regl": "regional", "reg": "regional", "utd": "united", "untd": "united", "unitd": "united", "amer": "american", "amern": "american", "am": "american",
    "assn": "association", "assoc": "association", "asso": "association", "ass": "association", "soc": "society", "socty": "society", "socy": "society", "cmte": "committee", "comm": "committee", "cttee": "committee", "comte": "committee", "coop": "cooperative", "fdn": "foundation", "fndtn": "foundation", "found": "foundation", "fnd": "foundation", "inst": "institute", "instit": "institute", "insti": "institute", "coal": "coalition", "coaltn": "coalition", "coalit": "coalition",
    "all": "alliance", "allnce": "alliance", "alli": "alliance", "corp": "corporation", "corpn": "corporation", "co": "company", "comp": "company", "cpy": "company", "fed": "federation", "fedn": "federation", "fedtn": "federation", "coun": "council", "cncl": "council", "cncil": "council",
}
KINDS = {"association", "society", "committee", "cooperative", "foundation", "institute", "coalition", "alliance", "corporation", "company", "federation", "council"}
NICKNAMES = {
    "alexander": "alex sasha xander alec", "anthony": "tony", "benjamin": "ben benny benji", "charles": "charlie chuck chas chaz", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby", "dorothy": "dot dottie", "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betsy betty eliza bess", "frederick": "fred freddie freddy fritz", "gregory": "greg gregg",
    "henrietta": "hettie hetty etta hattie", "henry": "hank harry", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny", "jonathan": "jon jonny johnny", "joseph": "joe joey", "josephine": "jo josie", "katherine": "kate katie kathy kat kay kitty", "lawrence": "larry", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge madge greta", "matthew": "matt", "michael": "mike mick mickey",
    "nicholas": "nick nico nicky", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "samantha": "sam", "stephen": "steve", "susan": "sue susie suzy suzie", "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "victoria": "vicky vic tori vicki", "walter": "walt", "william": "wm bill will billy willie liam", "zachary": "zach zack zak",
}
FORMAL: dict[str, list[str]] = {}
for _full, _nicks in NICKNAMES.items():
    for _nick in _nicks.split():
        FORMAL.setdefault(_nick, []).append(_full)

#: Companions by which a token counts as a word of its own.
ATTESTED = 5
#: An ordinary word of organisations goes with one of so many companions at least; pieces of invented words, which also recur as names grow in number, with far fewer.
ORDINARY = 1000
#: Longer tokens are posted by parts instead of deletes: of two within two slips (an exchange being two edits) one of five parts is the same, moved by four at most.
MAX_TOKEN = 40
PARTS, MOVED = 5, 4


def slips_allowed(n: int) -> int:
    return 2 if n >= 9 else 1 if n >= 4 else 0


def deletes(token: str) -> set[str]:
    """token and what is left of it after dropping up to as many characters as slips are allowed."""
    out = {token}
    edge = {token}
    if len(token) <= MAX_TOKEN:
        for _ in range(slips_allowed(len(token))):
            edge = {t[:k] + t[k + 1 :] for t in edge for k in range(len(t))}
            out |= edge
    return out


def long_keys(token: str) -> set[str]:
    """Keys of a token that may be within two slips of one over MAX_TOKEN: the parts of a token of its own length or one near, wherever they can lie in it."""
    out = set()
    for n in range(max(MAX_TOKEN + 1, len(token) - 2), len(token) + 3):
        cuts = [n * k // PARTS for k in range(PARTS + 1)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for move in range(-MOVED, MOVED + 1) if n != len(token) else (0, *range(-MOVED, 0), *range(1, MOVED + 1)):
                if 0 <= a + move and b + move <= len(token):
                    out.add(f"{n}|{k}|{token[a + move : b + move]}")
    return out


def left_of(token: str) -> set[str]:
    """Two tokens within the slips allowed have one of these in common."""
    return deletes(token) | (long_keys(token) if len(token) + 2 > MAX_TOKEN else set())


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, rows = [], []
        for k, token in enumerate(batch.column(0).to_pylist()):
            left = left_of(token)
            keys += left
            rows += [k] * len(left)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns)], ["left", "token", "n", "m"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = [slips(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        ok = pa.array([k <= min(slips_allowed(len(a)), slips_allowed(len(b))) for k, a, b in zip(d, batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(d, pa.int32())], ["token", "other", "n", "slips"]).filter(ok)


def slip_roots(tokens: DataFrame, words: tuple[str, ...] = ()) -> DataFrame:
    """tokens: (token, n companions, m spellings it is in). (token, root): the token its slips lead to; its own root without any.

    A token is a slip of the nearest token that is in more spellings. One with ATTESTED companions
    or more is nobody's slip, unless the other has five times as many; nor is one of words.
    """
    posted = cut(tokens.select("token", F.col("n").cast("long"), F.col("m").cast("long")).mapInArrow(_post, "left string, token string, n long, m long"), "posted")
    rare = posted.select("left", F.col("token").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    if words:
        rare = rare.where(~F.col("x").isin(*words))
    pairs = rare.join(posted, "left").where((F.col("x") != F.col("token")) & ((F.col("nx") < ATTESTED) | (F.col("nx") * 5 <= F.col("n"))))
    better = (F.col("m") > F.col("mx")) | ((F.col("m") == F.col("mx")) & (F.col("token") < F.col("x")))
    pairs = pairs.where(better).groupBy("x", "token").agg(F.max("m").alias("n"))
    near = pairs.select("x", "token", "n").mapInArrow(_near, "token string, other string, n long, slips int")
    best = near.groupBy("token").agg(F.min(F.struct("slips", (-F.col("n")).alias("few"), "other")).alias("m")).select("token", F.col("m.other").alias("other"))
    groups = connected_components(cut(best, "slips"), "token", "other")
    named = groups.join(tokens.select(F.col("token").alias("id"), "m"), "id")
    roots = named.groupBy("group_id").agg(F.min(F.struct((-F.col("m")).alias("few"), "id")).alias("r"))
    found = groups.join(roots, "group_id").select(F.col("id").alias("token"), F.col("r.id").alias("root"))
    return cut(tokens.select("token").join(found, "token", "left").select("token", F.coalesce("root", "token").alias("root")), "roots")


def _post_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token, asks, tells, n, m) posted under each of its contexts and what is left of its token, in parts of bounded size."""
    for whole in batches:
        for batch in (whole.slice(k, 2_000) for k in range(0, whole.num_rows, 2_000)):
            keys, rows, asking = [], [], []
            for k, (token, asks, tells) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                left = left_of(token)
                for beside in {*asks, *tells}:
                    keys += [xxhash.xxh64_intdigest(f"{beside}\0{x}") for x in left]
                    rows += [k] * len(left)
                    asking += [beside in asks] * len(left)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), *(batch.column(c).take(at) for c in (0, 1, 4, 5)), pa.array(asking, pa.bool_())], ["left", "id", "token", "n", "m", "asking"])


def _near_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = list(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()))
        d = [slips(a, b) for a, b in pairs]
        ok = pa.array([k <= min(slips_allowed(len(a)), slips_allowed(len(b))) for k, (a, b) in zip(d, pairs)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(d, pa.int32())], ["id", "other", "m", "slips"]).filter(ok)


def roots_beside(nodes: DataFrame) -> DataFrame:
    """nodes: (id, token, asks, tells, n companions of the token, m spellings), one row an id. (id, root): the token its slips lead to; its own without any.

    A token is a slip of the nearest one, of those that tell a context it asks for, that is in more spellings.
    One with ATTESTED companions or more is nobody's slip, unless the other has five times as many.
    """
    nodes = nodes.select("id", "token", "asks", "tells", F.col("n").cast("long"), F.col("m").cast("long"))
    posted = cut(nodes.mapInArrow(_post_beside, "left long, id string, token string, n long, m long, asking boolean"), "posted")
    x = posted.where("asking").select("left", F.col("id").alias("x"), F.col("token").alias("tx"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    better = (F.col("m") > F.col("mx")) | ((F.col("m") == F.col("mx")) & (F.col("token") < F.col("tx")))
    pairs = x.join(posted, "left").where((F.col("tx") != F.col("token")) & ((F.col("nx") < ATTESTED) | (F.col("nx") * 5 <= F.col("n"))) & better).groupBy("x", "tx", "id", "token").agg(F.max("m").alias("m"))
    near = pairs.mapInArrow(_near_beside, "id string, other string, m long, slips int")
    best = near.groupBy("id").agg(F.min(F.struct("slips", (-F.col("m")).alias("few"), "other")).alias("b")).select("id", F.col("b.other").alias("other"))
    groups = connected_components(cut(best, "slips"), "id", "other")
    roots = groups.join(nodes.select("id", "token", "m"), "id").groupBy("group_id").agg(F.min(F.struct((-F.col("m")).alias("few"), "token")).alias("r"))
    found = groups.join(roots, "group_id").select("id", F.col("r.token").alias("root"))
    return cut(nodes.select("id", "token").join(found, "id", "left").select("id", F.coalesce("root", "token").alias("root")), "roots")


def word_roots(counts: DataFrame, ordinary: int) -> DataFrame:
    """counts: (token, n companions, m spellings). (token, root, ordinary): an ordinary word has so many companions or is a fixed one; a slip of one leads to it, any other token to itself."""
    fixed = sorted(KINDS | SCOPES)
    words = counts.where((F.col("n") >= ordinary) | F.col("token").isin(*fixed)).select("token", F.col("n").cast("long"), F.col("m").cast("long"))
    post = lambda df: df.select("token", F.col("n").cast("long"), F.col("m").cast("long")).mapInArrow(_post, "left string, token string, n long, m long")
    rare = post(counts).select("left", F.col("token").alias("x"), F.col("n").alias("nx"), F.col("m").alias("mx"))
    better = (F.col("m") > F.col("mx")) | ((F.col("m") == F.col("mx")) & (F.col("token") < F.col("x")))
    pairs = rare.join(F.broadcast(cut(post(words), "words")), "left").where((F.col("x") != F.col("token")) & ((F.col("nx") < ATTESTED) | (F.col("nx") * 5 <= F.col("n"))) & better)
    near = pairs.select("x", "token", F.col("m").alias("n")).distinct().mapInArrow(_near, "token string, other string, n long, slips int")
    best = cut(near.groupBy("token").agg(F.min(F.struct("slips", (-F.col("n")).alias("few"), "other")).alias("b")).select("token", F.col("b.other").alias("other")), "slips")
    # A word may be a slip of another.
    groups = connected_components(best, "token", "other")
    roots = groups.join(words.select(F.col("token").alias("id"), "m"), "id").groupBy("group_id").agg(F.min(F.struct((-F.col("m")).alias("few"), "id")).alias("r"))
    found = groups.join(roots, "group_id").select(F.col("id").alias("token"), F.col("r.id").alias("root"))
    known = words.select("token", F.lit(True).alias("word"))
    return cut(counts.select("token").join(found, "token", "left").join(known, "token", "left").select("token", F.coalesce("root", "token").alias("root"), (F.col("root").isNotNull() | F.col("word").isNotNull()).alias("ordinary")), "roots")


def normal(c):
    """Lower case, trimmed, inner blanks one space; null as ''."""
    c = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def org_tokens(name: str) -> list[str]:
    s = re.sub(r"\([^)]*\)", " ", name)
    s = re.sub(r"['’]s\b", "", s)
    s = re.sub(r"['’]", "", s).replace("co-op", "coop")
    s = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", s)
    words = [SHORT_FORMS.get(w, w) for w in re.findall(r"[^\W_]+", s)]
    words = [w for w in words if w not in LEGAL and w not in STOP]
    kinds = [k for k, w in enumerate(words) if w in KINDS]
    if len(kinds) > 1 and words[-1] == "company":  # a legal form after the name's own kind
        words.pop()
    return words


@lru_cache(maxsize=100_000)
def alike(a: str, b: str) -> float:
    """How well two tokens stand for each other: equal, slip, initial, short form."""
    if a == b:
        return 1.0
    short, long_ = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.7 if long_.startswith(short) else 0.0
    if long_ in FORMAL.get(short, []) or short in FORMAL.get(long_, []) or set(FORMAL.get(a, [])) & set(FORMAL.get(b, [])):
        return 0.9
    if slips(a, b) <= slips_allowed(len(short)):
        return 0.85
    letters = iter(long_)
    if len(short) >= 2 and short[0] == long_[0] and all(c in letters for c in short):
        return 0.8
    return 0.0


def assign(a: list[str], b: list[str]) -> float:
    """The best one-to-one assignment of the shorter list's tokens, as mean likeness (successive shortest paths)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n, m = len(a), len(b)
    cost = [[1.0 - alike(x, y) for y in b] for x in a]
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(1.0 - cost[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j]) / n


def _org_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [org_tokens(x) for x in batch.column(0).to_pylist()]
        longest = [max(t, key=lambda w: (w not in KINDS and w not in SCOPES, len(w), w), default="") for t in tokens]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string())), pa.array(longest, pa.string())], ["name", "tokens", "longest"])


def person_parts(name: str) -> tuple[str, str, str, list[str]] | None:
    """(given, surname, generation, all tokens) of 'first|last' as typed; None where it names nobody."""
    first, _, last = name.partition("|")
    first, last = ("" if x in PLACEHOLDERS else x for x in (first, last))
    if not first or not last:
        one = first or last
        if "," in one and not re.search(r",\s*(?:esq|jr|sr|i{2,3}|iv|ph\.?d|m\.?d)\b", one):
            last, _, first = one.partition(",")
        else:
            first, last = one, ""
    cut_up = lambda s: [w for w in re.findall(r"[^\W_]+(?:-[^\W_]+)*", re.sub(r"['’]", "", s))]
    generation = ""
    out = []
    for part in (first, last):
        words = []
        for w in cut_up(part):
            if w in GENERATIONS:
                generation = GENERATIONS[w]
            elif w not in TITLES:
                words.append(w)
        out.append(words)
    given, sur = out
    if not sur and len(given) >= 2:
        given, sur = given[:-1], given[-1:]
    if not given or not sur:
        return None
    return given[0], " ".join(sur), generation, given + sur


def _person_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [(x, p, n) for x, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := person_parts(x))]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in got], pa.string()), *(pa.array([p[k] for _, p, _ in got], pa.string()) for k in range(3)), pa.array([p[3] for _, p, _ in got], pa.list_(pa.string())), pa.array([n for _, _, n in got], pa.int64())], ["name", "given", "surname", "generation", "tokens", "rows"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names a full given name may be called by: (full, form, listed), listed for initials and nicknames, else its beginnings."""
    for batch in batches:
        out = []
        for g in batch.column(0).to_pylist():
            listed = {g[0], *NICKNAMES.get(g, "").split()}
            out += [(g, f, True) for f in listed] + [(g, g[:k], False) for k in range(3, len(g)) if g[:k] not in listed]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in out], pa.string()), pa.array([f for _, f, _ in out], pa.string()), pa.array([x for _, _, x in out], pa.bool_())], ["full", "form", "listed"])


def _assigned(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ok.append(assign(a, b) >= least or "".join(sorted("".join(a))) == "".join(sorted("".join(b))))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _fullest(keyed: DataFrame) -> DataFrame:
    """(key, rep, rep_tokens): of each key a spelling without slips if there is one, of these the one with most letters in its tokens, then the fewest tokens, then the least."""
    size = F.length(F.array_join("tokens", ""))
    return keyed.groupBy("key").agg(F.min(F.struct((~F.col("plain")).alias("slipped"), (-size).alias("few"), F.size("tokens").alias("cuts"), F.col("name").alias("rep"), F.col("tokens").alias("rep_tokens"))).alias("m")).select("key", "m.rep", "m.rep_tokens")


def _linked(keyed: DataFrame, least: float) -> DataFrame:
    """keyed: (name, key, tokens, plain). (a, b): each spelling with the fullest of its key, where their tokens can be assigned to each other."""
    pairs = keyed.join(_fullest(keyed), "key").where(F.col("name") != F.col("rep")).select("name", "rep", "tokens", "rep_tokens")
    return pairs.mapInArrow(_assigned(least), "name string, rep string").select(F.col("name").alias("a"), F.col("rep").alias("b"))


def one_for_one(a: list[str], b: list[str], known: set[str]) -> bool:
    """Can every token of the one stand for a token of the other: equal, or one of the two a short form or slip that is no word of its own?

    known: tokens of either that are words of their own; two of them differ.
    """
    a, b = ([w for w in x if w not in SCOPES] for x in (a, b))
    if len(a) != len(b) or not a:
        return False
    same = set(a) & set(b)
    left, right = [w for w in a if w not in same], [w for w in b if w not in same]
    if not same or len(left) != len(right) or len(left) > 2:
        return False
    if any(x in known and y in known for x in left for y in right):
        return False
    return not left or assign(left, right) >= 0.79


def _one_for_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [one_for_one(a, b, set(k)) for a, b, k in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _post_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, tokens, own) posted under the number of its tokens and each distinctive one, and under what slips leave of that with each other token."""
    for whole in batches:
        for batch in (whole.slice(k, 2_000) for k in range(0, whole.num_rows, 2_000)):
            keys, rows = [], []
            for k, (tokens, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                tokens = [w for w in tokens if w not in SCOPES]
                for at in own:
                    told = {f"{len(tokens)}\0{at}", *(f"{len(tokens)}\0{x}\0{w}" for x in left_of(at) for w in set(tokens) if w != at)}
                    keys += map(xxhash.xxh64_intdigest, told)
                    rows += [k] * len(told)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), batch.column(0).take(pa.array(rows, pa.int64()))], ["at", "rep"])


def org_links(comments: DataFrame, org_col: str) -> DataFrame:
    """(a, b): spellings of one organisation, each linked to a fuller one. Nulls, blanks and placeholders name nobody."""
    names = comments.select(normal(F.col(org_col)).alias("name")).where(~F.col("name").isin(*PLACEHOLDERS)).distinct()
    parts = cut(names.mapInArrow(_org_parts, "name string, tokens array<string>, longest string").where(F.size("tokens") > 0), "orgs")
    counts = cut(parts.select(F.explode("tokens").alias("token"), "longest").groupBy("token").agg(F.count_distinct("longest").alias("n"), F.count(F.lit(1)).alias("m")), "counts")
    ordinary = word_roots(counts, max(ATTESTED, parts.select("longest").distinct().count() // ORDINARY))
    placed = parts.select("name", F.posexplode("tokens").alias("pos", "token")).join(ordinary, "token")
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ordinary"), F.struct("pos", "token")))), lambda x: x["token"]), "")
    common = F.array_join(F.array_sort(F.collect_set(F.when(F.col("ordinary") & ~F.col("root").isin(*sorted(SCOPES)), F.col("root")))), " ")
    shaped = cut(placed.groupBy("name").agg(own.alias("own"), common.alias("common")).withColumn("id", F.concat_ws("|", "own", "common")), "shaped")
    stems = shaped.where("own <> ''").groupBy("id", F.col("own").alias("token"), F.array("common").alias("asks"), F.array("common").alias("tells")).agg(F.count(F.lit(1)).alias("m"))
    stems = roots_beside(stems.join(stems.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token"))
    keyed = shaped.join(stems, "id", "left").select("name", F.concat_ws("|", F.coalesce("root", F.lit("")), "common").alias("key"))
    keyed = cut(keyed.join(parts.select("name", "tokens"), "name").withColumn("plain", F.lit(True)), "keyed")
    # Keys that share a distinctive token (few others go with it, so few keys do), or a slip of one and another token: one organisation if their tokens pair off.
    reps = cut(_fullest(keyed), "reps")
    told = reps.select("rep", "rep_tokens", F.explode("rep_tokens").alias("token")).join(ordinary, "token")
    told = cut(told.groupBy("rep").agg(F.first("rep_tokens").alias("tokens"), F.collect_set(F.when(~F.col("ordinary"), F.col("token"))).alias("own"), F.collect_set(F.when(F.col("ordinary"), F.col("token"))).alias("known")), "told")
    posted = cut(told.mapInArrow(_post_told, "at long, rep string"), "posted")
    x, y = (posted.select("at", F.col("rep").alias(f"rep_{k}")) for k in "ab")
    near = x.join(y, "at").where(F.col("rep_a") < F.col("rep_b")).select("rep_a", "rep_b").distinct()
    for k in "ab":
        near = near.join(told.select(*(F.col(c).alias(f"{c}_{k}") for c in ("rep", "tokens", "known"))), f"rep_{k}")
    near = near.select("rep_a", "rep_b", "tokens_a", "tokens_b", F.concat("known_a", "known_b").alias("known"))
    merged = near.mapInArrow(_one_for_one, "a string, b string")
    return _linked(keyed, 0.6).unionByName(merged)


def _meant(at: DataFrame, by: str, bare) -> DataFrame:
    """at with g the full given name meant, where just one attested with the same by can be called so, and k how many can (null for none).

    Initials and nicknames (bare) may stand for it; a beginning of it may that has under ATTESTED companions, or a fifth of its companions.
    """
    full = at.where(~bare).select(by, "generation", F.col("g").alias("full"), F.col("gn").alias("fn")).distinct()
    forms = full.select("full").distinct().mapInArrow(_forms, "full string, form string, listed boolean")
    asked = at.select(by, "generation", F.col("g").alias("form"), bare.alias("listed"), "gn").distinct()
    meant = asked.join(full.join(forms, "full"), [by, "generation", "form", "listed"]).where(F.col("listed") | (F.col("gn") < ATTESTED) | (F.col("gn") * 5 <= F.col("fn")))
    meant = meant.groupBy(by, "generation", F.col("form").alias("g")).agg(F.count_distinct("full").alias("k"), F.min("full").alias("full"), F.max("fn").alias("fn"))
    left = [c for c in at.columns if c not in ("g", "gn", "k")]
    told = lambda c, other: F.when(F.col("k") == 1, F.col(c)).otherwise(F.col(other)).alias(other)
    return at.join(meant, [by, "generation", "g"], "left").select(*left, told("full", "g"), told("fn", "gn"), "k")


def person_links(comments: DataFrame, first_col: str, last_col: str) -> DataFrame:
    """(a, b): spellings first|last of one person, each linked to a fuller one. Names of fewer than two words name nobody."""
    names = comments.select(F.concat(normal(F.col(first_col)), F.lit("|"), normal(F.col(last_col))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    parts = cut(names.mapInArrow(_person_parts, "name string, given string, surname string, generation string, tokens array<string>, rows long"), "persons")
    # The fields changed places where the surname is a known given name and mostly one, and the given name is not known as one or mostly a surname.
    givens = parts.where(F.length("given") > 1).groupBy(F.col("given").alias("token")).agg(F.count_distinct("surname").alias("k"), F.sum("rows").alias("g"))
    surnames = parts.groupBy(F.col("surname").alias("token")).agg(F.sum("rows").alias("s"))
    stands = cut(givens.join(surnames, "token", "left").select("token", (F.col("k") >= ATTESTED).alias("known"), (F.col("g") - F.coalesce("s", F.lit(0))).alias("lean")), "stands")
    for part in ("given", "surname"):
        parts = parts.join(stands.select(F.col("token").alias(part), F.col("known").alias(f"{part}_known"), F.col("lean").alias(f"{part}_lean")), part, "left")
    turned = F.coalesce(F.col("surname_known") & (F.col("surname_lean") > 0) & (~F.col("given_known") | (F.col("given_lean") < 0)), F.lit(False))
    parts = cut(parts.select("name", F.when(turned, F.col("surname")).otherwise(F.col("given")).alias("given"), F.when(turned, F.col("given")).otherwise(F.col("surname")).alias("surname"), "generation", "tokens"), "persons")
    giv = cut(parts.where(F.length("given") > 1).groupBy(F.col("given").alias("token")).agg(F.count_distinct("surname").alias("n"), F.count(F.lit(1)).alias("m")), "givens")
    giv_roots = slip_roots(giv, tuple(sorted({*FORMAL, *NICKNAMES}))).select(F.col("token").alias("given"), F.col("root").alias("g"))
    at = parts.join(giv_roots, "given", "left").withColumn("g", F.coalesce("g", "given"))
    at = cut(at.join(giv.select(F.col("token").alias("g"), F.col("n").alias("gn")), "g", "left"), "at")
    bare = (F.length("g") == 1) | F.col("g").isin(*sorted(FORMAL))
    at = cut(_meant(at, "surname", bare), "at")
    nodes = at.groupBy("surname", "g").agg(F.count(F.lit(1)).alias("m"), F.max("k").alias("k")).withColumn("id", F.concat_ws("|", "surname", "g"))
    nodes = nodes.join(at.groupBy("surname").agg(F.count_distinct("given").alias("n")), "surname")
    formal = F.create_map(*[x for nick_, fulls in sorted(FORMAL.items()) for x in (F.lit(nick_), F.array(*map(F.lit, [nick_, *fulls])))])
    initial, beginning = F.concat(F.substring("g", 1, 1), F.lit(".")), F.concat(F.substring("g", 1, 3), F.lit("-"))
    named = F.try_element_at(formal, F.col("g"))
    # What several given names of its own surname may be called belongs to one of them, not to a near surname.
    asks = F.when((F.col("k") > 1) & bare, F.array().cast("array<string>")).when(F.length("g") == 1, F.array(initial)).otherwise(F.coalesce(named, F.array("g", beginning)))
    tells = F.when(F.length("g") == 1, F.array(initial)).otherwise(F.coalesce(named, F.array("g", beginning, initial)))
    sur_roots = roots_beside(nodes.select("id", F.col("surname").alias("token"), asks.alias("asks"), tells.alias("tells"), "n", "m"))
    at = cut(at.withColumn("id", F.concat_ws("|", "surname", "g")).join(sur_roots, "id").withColumnRenamed("root", "s"), "at")
    keyed = _meant(at.drop("k"), "s", bare)
    first_formal = F.create_map(*[F.lit(x) for nick_, fulls in sorted(FORMAL.items()) for x in (nick_, fulls[0])])
    keyed = keyed.withColumn("g", F.coalesce(F.try_element_at(first_formal, F.col("g")), F.col("g")))
    keyed = keyed.select("name", F.concat_ws("|", "s", "g", "generation").alias("key"), "tokens", ((F.col("given") == F.col("g")) & (F.col("surname") == F.col("s"))).alias("plain"))
    return _linked(cut(keyed, "keyed"), 0.5)


@settled
def name_entities(comments: DataFrame, org_col: str = "organization", first_col: str = "submitter_first", last_col: str = "submitter_last") -> DataFrame:
    """(kind, name, entity) of every spelling that has another spelling; entity is the least spelling of its entity.

    kind: 'org' or 'person'. A spelling is the value lower-cased, trimmed, inner blanks made one
    space; for persons first || '|' || last, null as ''. Nulls, blanks, placeholders and persons
    of fewer than two words name nobody. Empty tables give an empty result; other columns are ignored.
    """
    mark = lambda kind, df: df.select(*(F.concat(F.lit(f"{kind}:"), c).alias(c) for c in ("a", "b")))
    links = mark("org", org_links(comments, org_col)).unionByName(mark("person", person_links(comments, first_col, last_col)))
    groups = connected_components(cut(links, "links"), "a", "b")
    bare = lambda c: F.substring_index(F.col(c), ":", 1), lambda c: F.expr(f"substring({c}, instr({c}, ':') + 1)")
    return groups.select(bare[0]("id").alias("kind"), bare[1]("id").alias("name"), bare[1]("group_id").alias("entity"))


def name_pairs(entities: DataFrame) -> DataFrame:
    """(kind, name_a, name_b), name_a < name_b: the spellings of each entity by twos."""
    a, b = (entities.select("kind", "entity", F.col("name").alias(f"name_{x}")) for x in "ab")
    return a.join(b, ["kind", "entity"]).where("name_a < name_b").select("kind", "name_a", "name_b")
