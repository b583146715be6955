"""Style of texts: features of each, and how much tighter a cluster's are than the rest of its run's."""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from muster.functions import text as T
from muster.functions.fixed import DISCOURSE_MARKERS, FUNCTION_WORDS, GENERATED_WORDS, MARKS
from muster.plans.lineage import cut

BY = ["run_id", "cluster"]


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _spread(lengths: Column) -> Column:
    """(mean, population deviation) of an array of doubles."""
    return T.let(_mean(lengths), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(lengths)).alias("sd")))


def features(texts: DataFrame) -> DataFrame:
    """texts: id, text. (id, w words, s sentences, and the features that need no counting of words across rows)."""
    w = T.words(F.col("text"))
    base = texts.select("id", "text", w.alias("w"), F.transform(T.sentences(F.col("text")), lambda s: F.size(T.words(s)).cast("double")).alias("sl"))
    base = base.where(F.size("w") > 0)
    n, sents = F.size("w").cast("double"), F.greatest(F.lit(1.0), F.size("sl").cast("double"))
    letters = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.length(x))
    syllables = F.aggregate("w", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(1), F.size(F.regexp_extract_all(x, F.lit("[aeiouy]+"), F.lit(0)))))
    hard = F.size(F.filter("w", lambda x: F.size(F.regexp_extract_all(x, F.lit("[aeiouy]+"), F.lit(0))) >= 3)).cast("double")
    marks = F.array(*[F.length("text") - F.length(F.replace("text", F.lit(m), F.lit(""))) for m in MARKS])
    rate = lambda words: F.size(F.filter("w", lambda x: x.isin(*words))) / n
    f = base.select("*", _spread(F.col("sl")).alias("sp"))
    few = F.size("sl") < 2
    return f.select(
        "id", "w",
        F.when(few, 0.0).otherwise(F.coalesce(F.try_divide(F.col("sp.sd") - F.col("sp.mean"), F.col("sp.sd") + F.col("sp.mean")), F.lit(0.0))).alias("burstiness_sent"),
        F.when(few, 0.0).otherwise(F.coalesce(F.try_divide("sp.sd", "sp.mean"), F.lit(0.0))).alias("sent_len_cv"),
        (F.size(F.array_distinct("w")) / n).alias("ttr"),
        (letters / n).alias("avg_word_len"),
        T.entropy(marks).alias("punct_entropy"),
        ((F.length("text") - F.length(F.replace("text", F.lit("—"), F.lit("")))) / n).alias("emdash_rate"),
        (0.39 * n / sents + 11.8 * syllables / n - 15.59).alias("flesch_kincaid"),
        (5.8 * letters / n - 29.6 * sents / n - 15.8).alias("coleman_liau"),
        (0.4 * (n / sents + 100 * hard / n)).alias("gunning_fog"),
        rate(DISCOURSE_MARKERS).alias("discourse_marker_rate"),
        rate(GENERATED_WORDS).alias("llmism_rate"),
    )


def word_counts(texts: DataFrame, by: str = "id") -> DataFrame:
    return texts.select(by, F.explode(T.words(F.col("text"))).alias("word")).groupBy(by, "word").agg(F.count(F.lit(1)).alias("c"))


def function_word_chi2(texts: DataFrame, docket: str) -> DataFrame:
    """(id, chi2): function words of each text against the rates of its docket, words expected less than half a time left out.

    sum (O - E)^2 / E over all words = sum over used words of (O^2 / E - 2 O + E) + E of the unused
    ones, so words that a text lacks need no rows of their own.
    """
    words = texts.select("id", docket, F.explode(T.words(F.col("text"))).alias("word"))
    total = words.groupBy(docket).agg(F.count(F.lit(1)).alias("dn"))
    rates = words.where(F.col("word").isin(*FUNCTION_WORDS)).groupBy(docket, "word").agg(F.count(F.lit(1)).alias("dc")).join(total, docket).select(docket, "word", (F.col("dc") / F.col("dn")).alias("p"))
    lists = rates.groupBy(docket).agg(F.collect_list(F.struct("word", "p")).alias("rates"))  # 70 words at most
    used = words.where(F.col("word").isin(*FUNCTION_WORDS)).groupBy("id", "word").agg(F.count(F.lit(1)).alias("o")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "o"))).alias("o"))
    sizes = words.groupBy("id", docket).agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.join(lists, docket).join(used, "id", "left")

    def term(x: Column) -> Column:
        e, o = x["p"] * F.col("n"), F.coalesce(F.try_element_at("o", x["word"]), F.lit(0))
        return F.when(e > 0.5, (o - e) * (o - e) / e).otherwise(0.0)

    return rows.select("id", F.aggregate("rates", F.lit(0.0), lambda a, x: a + term(x)).alias("chi2"))


def word_runs(ws: list[str]) -> float:
    """Mean length of runs of words that keep a type-token ratio of 0.72, forwards and backwards; 0 under 50 words."""

    def one(ws) -> float:
        runs, seen, n = 0.0, set(), 0
        for w in ws:
            n += 1
            seen.add(w)
            if len(seen) / n <= 0.72:
                runs, seen, n = runs + 1, set(), 0
        if n:
            runs += (1 - len(seen) / n) / (1 - 0.72)
        return len(ws) / runs if runs else float(len(ws))

    return 0.0 if len(ws) < 50 else (one(ws) + one(ws[::-1])) / 2


@F.pandas_udf(DoubleType())
def mtld(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: word_runs(list(ws)))


CLOSED = {"DET": "a an the this that these those every any all", "PRON": "i you he she it we they me him her us them my your his its our their who which what", "ADP": "of in on at by for with from to into upon down up about over under", "CONJ": "and or but so if because while although when than as until unless", "AUX": "be been is are was were am do does did has have had can could will would shall should may might must", "ADV": "not now only also even more so then there"}
ENDINGS = (("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("tion", "NOUN"), ("ment", "NOUN"), ("ness", "NOUN"), ("ous", "ADJ"), ("ful", "ADJ"), ("able", "ADJ"), ("ive", "ADJ"), ("al", "ADJ"))
_TAG = {w: tag for tag, ws in CLOSED.items() for w in ws.split()}


def word_class(w: str) -> str:
    return _TAG.get(w) or next((t for end, t in ENDINGS if w.endswith(end)), "NOUN")


@F.pandas_udf(DoubleType())
def pos_entropy(words: pd.Series) -> pd.Series:
    """Entropy of word classes by a closed list and endings; a tagger may be put in its place."""
    return words.map(lambda ws: bits(Counter(map(word_class, ws)).values()))


def bits(counts) -> float:
    """Shannon entropy of counts; 0 when there are none."""
    n = sum(counts)
    return -sum(k / n * math.log2(k / n) for k in counts if k) if n else 0.0


@functools.cache
def letters() -> re.Pattern:
    """Runs of letters, as \\p{L}+ elsewhere."""
    runs: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]+")


_ASCII, _VOWELS, _ENDS = re.compile("[a-z]+"), re.compile("[aeiouy]+"), re.compile("[.!?]+[ \t\n\x0b\f\r\xa0]+")
_BLANK = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FUNCTION = {w: k for k, w in enumerate(FUNCTION_WORDS)}
_MEMO: dict[str, tuple] = {}
#: What text_features works out of a text alone, and what it adds for the whole matrix.
ALONE = ["burstiness_sent", "sent_len_cv", "ttr", "avg_word_len", "punct_entropy", "emdash_rate", "flesch_kincaid", "coleman_liau", "gunning_fog", "discourse_marker_rate", "llmism_rate", "yule_k", "hapax_ratio", "char_entropy", "clause_depth", "pos_entropy"]
MORE = ["mtld", "zlib_ratio"]


def words_of(low: str) -> list[str]:
    return (_ASCII if low.isascii() else letters()).findall(low)


def _known(w: str) -> tuple:
    """(length, syllables, hard, class, discourse marker, typical of generated text, number among the function words or -1)."""
    k = _MEMO.get(w)
    if k is None:
        if len(_MEMO) > 300_000:
            _MEMO.clear()
        v = len(_VOWELS.findall(w))
        k = _MEMO[w] = (len(w), max(1, v), int(v >= 3), word_class(w), int(w in DISCOURSE_MARKERS), int(w in GENERATED_WORDS), _FUNCTION.get(w, -1))
    return k


def _trigram_entropy(low: str) -> float:
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    g = np.sort(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    if not len(g):
        return 0.0
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    n = np.diff(at).astype(float)
    return math.log2(len(g)) - float((n * np.log2(n)).sum()) / len(g)


def _of_text(low: str) -> tuple[list[float], list[str], list[int]] | None:
    """(features ALONE, words, counts of function words) of a text in small letters; None where it has no word."""
    sents = [s for s in _ENDS.split(low) if s.strip(_BLANK)]
    find = (_ASCII if low.isascii() else letters()).findall
    w, sl = [], []
    for s in sents:
        found = find(s)
        w += found
        sl.append(float(len(found)))
    if not w:
        return None
    n, sn = float(len(w)), float(max(1, len(sl)))
    mean = sum(sl) / len(sl)
    sd = math.sqrt(sum((x - mean) * (x - mean) for x in sl) / len(sl))
    few = len(sl) < 2
    counts = Counter(w)
    chars = syllables = hard = markers = generated = squares = once = 0
    classes, o = Counter(), [0] * len(FUNCTION_WORDS)
    for x, c in counts.items():
        length, syl, is_hard, cls, marker, gen, f = _known(x)
        chars += length * c
        syllables += syl * c
        hard += is_hard * c
        classes[cls] += c
        markers += marker * c
        generated += gen * c
        squares += c * c
        once += c == 1
        if f >= 0:
            o[f] = c
    depth = sum(min(200, 1 + s.count(",") + s.count(";") + s.count("(") + s.count("[")) for s in sents) / len(sents)
    return [
        0.0 if few or sd + mean == 0 else (sd - mean) / (sd + mean),
        0.0 if few or mean == 0 else sd / mean,
        len(counts) / n,
        chars / n,
        bits([low.count(m) for m in MARKS]),
        low.count("—") / n,
        0.39 * n / sn + 11.8 * syllables / n - 15.59,
        5.8 * chars / n - 29.6 * sn / n - 15.8,
        0.4 * (n / sn + 100 * hard / n),
        markers / n,
        generated / n,
        10000 * (squares - n) / (n * n) if n >= 10 else 0.0,
        once / len(counts),
        _trigram_entropy(low),
        depth,
        bits(classes.values()),
    ], w, o


def text_features(texts: DataFrame, docket: str, more: bool = False) -> DataFrame:
    """texts: id, text and the docket. (id, docket, n words, o counts of the function words, ALONE and, if asked for, MORE), a row for each text with a word.

    Each text is read once and its words taken once for all the features, so no words are spread over rows.
    """
    cols = ALONE + MORE * more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keep = [], []
            raw = b.column(3).to_pylist() if more else None
            for k, low in enumerate(b.column(2).to_pylist()):
                if (found := _of_text(low)) is None:
                    continue
                f, w, o = found
                if more:
                    data = raw[k].encode()
                    f += [word_runs(w), len(zlib.compress(data)) / len(data)]
                rows.append((len(w), o, f))
                keep.append(k)
            keep = pa.array(keep, pa.int32())
            f = np.array([r[2] for r in rows], float).reshape(-1, len(cols))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), *(pa.array(f[:, k]) for k in range(len(cols)))], names=["id", docket, "n", "o", *cols])

    kinds = dict(texts.dtypes)
    return texts.select("id", docket, F.lower("text").alias("low"), *["text"] * more).mapInArrow(run, f"id {kinds['id']}, {docket} {kinds[docket]}, n int, o array<int>, " + ", ".join(f"{c} double" for c in cols))


def function_words_chi2(features: DataFrame, docket: str) -> DataFrame:
    """features of text_features with chi2: as function_word_chi2, from the counts of each text; 0 without a docket."""
    width = len(FUNCTION_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                key = b.column(0).dictionary_encode()
                at, n = key.indices.to_numpy(zero_copy_only=False), len(key.dictionary)
                sums = np.zeros((n, width + 1), np.int64)
                np.add.at(sums, at, np.column_stack((b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, width))))
                yield pa.RecordBatch.from_arrays([key.dictionary, pa.array(list(sums), pa.list_(pa.int64()))], names=[docket, "s"])

    kind = dict(features.dtypes)[docket]
    sums = features.where(F.col(docket).isNotNull()).select(docket, "n", "o").mapInArrow(run, f"{docket} {kind}, s array<long>")
    total = sums.select(docket, F.posexplode("s").alias("i", "c")).groupBy(docket, "i").agg(F.sum("c").alias("c")).groupBy(docket).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("s"))
    rates = total.select(docket, F.transform(F.slice("s", 2, width), lambda c: c / F.element_at("s", 1)).alias("rates"))
    term = lambda p, o: F.when(p * F.col("n") > 0.5, (o - p * F.col("n")) * (o - p * F.col("n")) / (p * F.col("n"))).otherwise(0.0)
    chi2 = F.aggregate(F.zip_with("rates", "o", term), F.lit(0.0), lambda a, x: a + x)
    return features.join(rates, docket, "left").select(*features.columns, F.coalesce(chi2, F.lit(0.0)).alias("chi2"))


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null, NaN and infinite values as their column's median, worked out for the columns that have such values."""
    fine = df.select(*[c for c in df.columns if c not in cols], *[T.finite(F.col(c)).alias(c) for c in cols])
    lacking = fine.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    med = [c for c in cols if lacking[c]]
    if not med:
        return fine
    one = fine.agg(*[F.median(c).alias(f"m_{c}") for c in med])
    return fine.crossJoin(F.broadcast(one)).select(*[c for c in df.columns if c not in cols], *[F.coalesce(c, f"m_{c}").alias(c) if c in med else F.col(c) for c in cols])  # one row


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"d_{c}") for c in cols])
    return df.crossJoin(F.broadcast(one)).select(*[c for c in df.columns if c not in cols], *[((F.col(c) - F.col(f"a_{c}")) / (F.col(f"d_{c}") + 1e-9)).alias(c) for c in cols])


def tightness(df: DataFrame, cols: list[str], full_size: float = 20.0) -> DataFrame:
    """df: run_id, cluster and features. How much less each cluster of three or more varies than the rest of its run.

    Variances of the rest come from the run's moments less the cluster's, so no row is read twice.
    """
    wide = df.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in cols], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cols])
    part = wide.select(*BY, "n", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q")) for c in cols])).alias("e")).select(*BY, "n", "e.f", "e.s", "e.q")
    w = Window.partitionBy("run_id", "f")
    part = part.withColumn("run_n", F.sum("n").over(w)).withColumn("run_s", F.sum("s").over(w)).withColumn("run_q", F.sum("q").over(w))
    part = part.where("cluster <> -1 AND n >= 3")
    var = lambda q, s, n: q / n - (s / n) * (s / n)
    c = F.col
    rest = F.when(c("run_n") - c("n") < 5, var(c("run_q"), c("run_s"), c("run_n"))).otherwise(var(c("run_q") - c("q"), c("run_s") - c("s"), c("run_n") - c("n")))
    ratio = F.greatest(F.lit(1e-9), var(c("q"), c("s"), c("n"))) / F.greatest(F.lit(1e-6), rest)
    part = part.withColumn("ratio", ratio)
    out = part.groupBy(*BY).agg(F.first("n").alias("n"), F.avg(F.log(F.sqrt("ratio") + 0.01)).alias("log"), F.sum(F.log("ratio")).alias("logs"), F.median("ratio").alias("median_ratio"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 1 - F.exp("log")))
    return out.select(*BY, "n", F.round(F.least(F.lit(1.0), c("n") / full_size) * raw, 4).alias("style_score"), F.greatest(F.lit(0.0), -(c("n") - 1) * c("logs")).alias("chi_stat"), "median_ratio")


def surprisal(texts: DataFrame, by: str = "id", k: float = 0.1) -> DataFrame:
    """(id, pos, s): bits of each word given the one before, by a bigram model of the corpus with add-k smoothing.

    Pairs and words are counted once over all texts and joined back by pair and by word.
    """
    w = T.words(F.col("text"))
    words = texts.select(by, F.posexplode(w).alias("pos", "word"))
    prev = F.lag("word").over(Window.partitionBy(by).orderBy("pos"))
    pairs = words.withColumn("prev", F.coalesce(prev, F.lit("^")))
    cp = pairs.groupBy("prev", "word").agg(F.count(F.lit(1)).alias("cp"))
    cw = pairs.groupBy("prev").agg(F.count(F.lit(1)).alias("cw"))
    v = cp.agg(F.count_distinct("word").alias("v"))
    table = cp.join(cw, "prev").crossJoin(F.broadcast(v)).select("prev", "word", (-F.log2((F.col("cp") + k) / (F.col("cw") + k * F.col("v")))).alias("s"))  # v is one row
    return pairs.join(table, ["prev", "word"]).select(by, "pos", "s")


def surprisal_features(s: DataFrame, by: str = "id") -> DataFrame:
    """Shape of each text's surprisal: moments, and those of its first and second differences; four words or more."""
    w = Window.partitionBy(by).orderBy("pos")
    d = s.withColumn("d1", F.col("s") - F.lag("s").over(w)).withColumn("d2", F.col("s") - 2 * F.lag("s").over(w) + F.lag("s", 2).over(w))
    d = d.withColumn("d2n", F.lead("d2").over(w))
    m = lambda c, p: F.avg(F.pow(c, F.lit(float(p))))
    a = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[m("s", p).alias(f"m{p}") for p in (1, 2, 3, 4)], F.avg("d1").alias("d1_mean"), m("d1", 2).alias("d1q"), F.avg("d2").alias("d2_mean"), m("d2", 2).alias("d2q"), F.sum(F.col("d2") * F.col("d2n")).alias("dd"), F.sum(F.when(F.col("d2n").isNotNull(), F.col("d2") + F.col("d2n"))).alias("ds"), F.count("d2").alias("k"), F.collect_list("d2").alias("d2s")).where("n >= 4")
    c = F.col
    var = c("m2") - c("m1") * c("m1")
    skew = (c("m3") - 3 * c("m1") * c("m2") + 2 * F.pow("m1", F.lit(3.0))) / (F.pow(F.greatest(F.lit(0.0), var), F.lit(1.5)) + 1e-9)
    kurt = (c("m4") - 4 * c("m1") * c("m3") + 6 * F.pow("m1", F.lit(2.0)) * c("m2") - 3 * F.pow("m1", F.lit(4.0))) / (var * var + 1e-9)
    lo, hi = F.array_min("d2s"), F.array_max("d2s")
    bins = F.transform("d2s", lambda x: F.when(hi > lo, F.least(F.lit(9), F.floor((x - lo) / (hi - lo) * 10))).otherwise(0))
    a = a.withColumn("bins", bins)
    among = lambda b: F.size(F.filter("bins", lambda x: x == b))
    entropy = T.entropy(F.array(*map(among, range(10))))
    denom = c("k") * (c("d2q") - c("d2_mean") * c("d2_mean"))
    auto = (c("dd") - c("d2_mean") * c("ds") + (c("k") - 1) * c("d2_mean") * c("d2_mean")) / (denom + 1e-9)
    return a.select(by, c("m1").alias("s_mean"), var.alias("s_var"), skew.alias("s_skew"), kurt.alias("s_kurt"), "d1_mean", (c("d1q") - c("d1_mean") * c("d1_mean")).alias("d1_var"), (c("d2q") - c("d2_mean") * c("d2_mean")).alias("d2_var"), entropy.alias("d2_entropy"), auto.alias("d2_ac"))


#: A chunk of texts that are worked on together ends at so many texts or words.
CHUNK_TEXTS, CHUNK_WORDS = 4_000, 1_000_000


def _shape(s: np.ndarray) -> list[float]:
    """SHAPES of a text's surprisals, four or more."""
    d1 = np.diff(s)
    d2 = np.diff(d1)
    m, v, dm = s.mean(), s.var(), d2.mean()
    x, dc = s - m, d2 - d2.mean()
    lo, hi = d2.min(), d2.max()
    n = np.bincount(np.minimum(9, (d2 - lo) / (hi - lo) * 10).astype(np.int64) if hi > lo else np.zeros(len(d2), np.int64))
    p = n[n > 0] / len(d2)
    x2 = x * x
    return [m, v, (x2 * x).mean() / (v**1.5 + 1e-9), (x2 * x2).mean() / (v * v + 1e-9), d1.mean(), d1.var(), d2.var(), -(p * np.log2(p)).sum() + 0.0, dc[:-1] @ dc[1:] / (dc @ dc + 1e-9)]


#: The features that surprisal_features and surprisal_shapes give.
SHAPES = ["s_mean", "s_var", "s_skew", "s_kurt", "d1_mean", "d1_var", "d2_var", "d2_entropy", "d2_ac"]


def surprisal_shapes(texts: DataFrame, k: float = 0.1) -> DataFrame:
    """texts: id, text. As surprisal_features(surprisal(texts)), by chunks of texts instead of rows of words.

    A task numbers the pairs of words of each chunk and counts them there. The model is summed from
    these counts, the chunk's pairs get their bits from it, and each text is looked up in its chunk's
    list. So what is joined grows with the different pairs of a chunk, and no worker holds the model.
    """
    kind = dict(texts.dtypes)["id"]
    id_type = texts.select("id").schema["id"].dataType

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        chunk = TaskContext.get().partitionId() << 32
        names, id_kind = ["chunk", "id", "codes", "prev", "word", "code", "c"], to_arrow_type(id_type)
        ids, codes, known, words = [], [], {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, ids, codes, known, words
            if ids:
                n, counts = len(ids), np.bincount(np.concatenate(codes), minlength=len(known))
                none = lambda t, n=n: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(ids, id_kind), pa.array(codes, pa.list_(pa.int32())), none(pa.string()), none(pa.string()), none(pa.int32()), none(pa.int64())], names=names)
                n = len(known)
                prev, word = zip(*known)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.nulls(n, id_kind), pa.nulls(n, pa.list_(pa.int32())), pa.array(prev, pa.string()), pa.array(word, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts.astype(np.int64))], names=names)
            chunk, ids, codes, known, words = chunk + 1, [], [], {}, 0

        for b in batches:
            for i, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(low)
                if w:
                    ids.append(i)
                    codes.append(np.array([known.setdefault(pair, len(known)) for pair in zip(["^", *w], w)], np.int32))
                    words += len(w)
                    if len(ids) >= CHUNK_TEXTS or words >= CHUNK_WORDS:
                        yield from out()
        yield from out()

    numbered = cut(texts.select("id", F.lower("text").alias("low")).mapInArrow(number, f"chunk long, id {kind}, codes array<int>, prev string, word string, code int, c long"), "numbered")
    pairs = numbered.where("code IS NOT NULL").select("chunk", "prev", "word", "code", "c")
    cp = cut(pairs.groupBy("prev", "word").agg(F.sum("c").alias("cp")), "pairs")
    cw = cp.groupBy("prev").agg(F.sum("cp").alias("cw"))
    v = cp.agg(F.count_distinct("word").alias("v"))
    table = cp.join(cw, "prev").crossJoin(F.broadcast(v)).select("prev", "word", (-F.log2((F.col("cp") + k) / (F.col("cw") + k * F.col("v")))).alias("s"))  # v is one row
    lists = pairs.join(table, ["prev", "word"]).select(F.col("chunk").alias("of"), "code", "s")

    def shapes(mine: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        bits = np.empty(len(listed))
        bits[listed["code"].to_numpy()] = listed["s"].to_numpy()
        rows = [(i, *_shape(bits[c])) for i, c in zip(mine["id"], mine["codes"]) if len(c) >= 4]
        return pd.DataFrame(rows, columns=["id", *SHAPES])

    mine = numbered.where("id IS NOT NULL").select("chunk", "id", "codes")
    return mine.groupBy("chunk").cogroup(lists.groupBy("of")).applyInPandas(shapes, f"id {kind}, " + ", ".join(f"{c} double" for c in SHAPES))


def generated_score(df: DataFrame, cols: list[str]) -> DataFrame:
    """df: run_id, cluster and features. (run_id, cluster, n, mean_surprisal, ai_score): spread of each feature in a cluster of three or more against its run's."""
    long = df.select(*BY, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("x")) for c in cols])).alias("e")).select(*BY, "e.f", "e.x")
    base = long.groupBy("run_id", "f").agg((F.stddev_pop("x") + 1e-6).alias("b"))
    part = long.where("cluster <> -1").groupBy(*BY, "f").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-9).alias("sd")).where("n >= 3")
    out = part.join(base, ["run_id", "f"]).groupBy(*BY).agg(F.first("n").alias("n"), F.round(F.max(F.when(F.col("f") == "s_mean", F.col("mean"))), 3).alias("mean_surprisal"), F.avg(F.log(F.col("sd") / F.col("b") + 0.01)).alias("log"))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 1 - F.exp("log")))
    return out.select(*BY, "n", "mean_surprisal", F.round(F.least(F.lit(1.0), F.col("n") / 15.0) * raw, 4).alias("ai_score"))
