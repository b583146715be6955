"""Problem 10: the subject areas of each document, by weak supervision.

Labelling functions vote on each (document, subject), each from a source of its own: the words of
the text and its pairs of neighbouring words (does a fifth of the text lie in sentences of the
subject), the sections (title and headings), the addresses (docket prefix, domains of mail
addresses) and the source. Words, pairs and headings have lexicons of their own, learned from a
bounded sample of hand-labelled documents, sentence by sentence; that of words is widened by the
words that go with each subject in all documents. A latent model learns how accurate each function
is for each subject from how the votes fall over the whole corpus, without labels; documents are
assigned by the posterior probability of a subject.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from muster.llm.shingles import mix
from muster.plans.lineage import cut, settled

#: Labelled documents the lexicons are fitted on, at most (those with the least hashed ids).
LABELLED_DOCS = 3000
#: The share of a text that makes it about a subject.
SHARE = 0.2
ROUNDS = 8
#: Log odds a word must reach to stand in a lexicon, and a sentence's sum to have a subject.
WORD_ODDS, SENTENCE_ODDS = 1.0, 2.0
#: The share of its main subject, were all of one size, that a word must have.
WORD_SHARE = 0.5
#: Words of the widened lexicon: in so many sentences of subjects, with this share in one.
WIDE_COUNT, WIDE_SHARE = 8, 0.6
#: And making up so much of all words counted, which bounds the lexicon by its inverse.
WIDE_PART = 1e-6
WIDENINGS = 1
#: Subjects at most; more raise an error.
MAX_SUBJECTS = 1000
#: Documents by which a subject's own accuracies are drawn to those of all subjects.
DRAWN = 50.0

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?;\n]+|<[^>]*>")
DOMAIN = re.compile(r"@((?:[\w-]+\.)*[\w-]+)\.[a-z]{2,}", re.I)
#: A line of a few words without a full stop.
HEADING = re.compile(r"^[ \t]*(?:[^\s.!?]+[ \t]+){0,7}[^\s.!?]+[ \t]*:?[ \t]*$", re.M)


def headings(title: str | None, text: str) -> str:
    """The title and the lines that stand as headings, one a line."""
    return "\n".join([title or "", *(HEADING.findall(text) if "\n" in text else [])])


def addresses(docket: str | None, text: str) -> set[str]:
    """The docket's prefix and the domains of mail addresses in the text."""
    out = {"@" + d.lower() for d in DOMAIN.findall(text)} if "@" in text else set()
    return out | ({docket.split("-")[0]} if docket else set())


def sentences(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(text.lower()) if (w := WORD.findall(s))]


def _flat(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, start of each sentence, document of each sentence)."""
    words: list[str] = []
    starts, docs = [], []
    for d, t in enumerate(texts):
        if not t:
            continue
        for s in sentences(t):
            starts.append(len(words))
            docs.append(d)
            words += s
    return words, np.array(starts, dtype=np.int64), np.array(docs, dtype=np.int64)


def fit_lexicon(texts: list[str], labels: list[list[int]], n: int, pairs: bool = False) -> dict:
    """Word (or hashed pair of neighbouring words) -> log odds for each subject, by expectation maximisation over sentences.

    A sentence belongs to one of its document's labels.
    """
    words, starts, docs = _flat(texts)
    if not words:
        return {}
    sent = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)]))
    if pairs:
        found, inside = _pairs(words, starts)
        vocab, ids = np.unique(found[inside], return_inverse=True)
        vocab, sent = vocab.tolist(), sent[:-1][inside]
        if not len(ids):
            return {}
    else:
        index = {w: k for k, w in enumerate(dict.fromkeys(words))}
        vocab, ids = list(index), np.array([index[w] for w in words])
    allowed = np.full((len(texts), n), -np.inf)
    for d, ls in enumerate(labels):
        allowed[d, ls] = 0.0
    allowed = allowed[docs]
    weight = 1.0 / np.sqrt(np.bincount(docs, minlength=len(texts))[docs])  # a long text must not make a subject's words alone
    post = np.exp(allowed)
    post /= post.sum(axis=1, keepdims=True)
    each = weight[sent]
    for _ in range(ROUNDS):
        counts = np.stack([np.bincount(ids, weights=post[sent, k] * each, minlength=len(vocab)) for k in range(n)], axis=1)
        base = counts.sum(axis=1) / counts.sum()
        like = np.log(counts + 2.0 * base[:, None]) - np.log(counts.sum(axis=0) + 2.0)
        score = np.stack([np.bincount(sent, weights=like[ids, k], minlength=len(starts)) for k in range(n)], axis=1) + allowed
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
    seen, sizes = np.bincount(ids, minlength=len(vocab)), counts.sum(axis=0)
    return {w: o for k, w in enumerate(vocab) if seen[k] >= 2 + pairs and (o := _odds(counts[k], sizes)) is not None}


def _odds(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """Log odds of each subject given a word, were all subjects of one size; None for a word without a main subject.

    A word that goes with most subjects (of one language, say) has none, however uneven the subjects are.
    """
    share = (counts + 0.1) / (sizes + 1.0)
    share = share / share.sum()
    return np.log(share * len(share)).astype(np.float32) if share.max() >= WORD_SHARE else None


class Lexicon:
    """Log odds of words, and of pairs of neighbouring words, for whole batches of sentences."""

    def __init__(self, odds: dict[str, np.ndarray], n: int):
        self.n = n
        self.index = {w: k + 1 for k, w in enumerate(odds)}
        self.matrix = np.zeros((len(odds) + 1, n), dtype=np.float32)
        for w, k in self.index.items():
            self.matrix[k] = np.clip(odds[w], 0.0, 4.0) * (odds[w] >= WORD_ODDS)

    def subjects(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The subject of each sentence, -1 for none."""
        if not len(starts):
            return np.empty(0, dtype=np.int64)
        score = np.add.reduceat(self.matrix[ids], starts, axis=0)
        best = score.argmax(axis=1)
        rest = score.copy()
        rest[np.arange(len(best)), best] = 0
        sure = (score.max(axis=1) >= SENTENCE_ODDS) & (score.max(axis=1) > 1.2 * rest.max(axis=1))
        return np.where(sure, best, -1)


def _wide(odds: dict[str, np.ndarray], n: int):
    """Counts of words by the subject of their sentence, one row a word and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(odds, n)
        vocab: dict[str, int] = {}
        counts = np.zeros((1024, n), dtype=np.int64)
        for batch in batches:
            words, starts, _ = _flat(batch.column(0).to_pylist())
            if not words:
                continue
            get = lexicon.index.get
            about = lexicon.subjects(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)), starts)
            ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), dtype=np.int64, count=len(words))
            each = np.repeat(about, np.diff(np.r_[starts, len(words)]))
            if len(vocab) > len(counts):
                counts = np.concatenate((counts, np.zeros((max(len(counts), len(vocab) - len(counts)), n), dtype=np.int64)))
            ok = each >= 0
            np.add.at(counts, (ids[ok], each[ok]), 1)
            if len(vocab) > 300_000:  # a bound on the state; the rows are added up later
                yield _count_rows(vocab, counts)
                vocab, counts = {}, np.zeros((1024, n), dtype=np.int64)
        if vocab:
            yield _count_rows(vocab, counts)

    return run


def _count_rows(vocab: dict[str, int], counts: np.ndarray) -> pa.RecordBatch:
    held = counts[: len(vocab)]
    keep = np.flatnonzero(held.sum(axis=1) > 0)
    names = list(vocab)
    return pa.RecordBatch.from_arrays([pa.array([names[k] for k in keep], pa.string()), *(pa.array(held[keep, s]) for s in range(held.shape[1]))], ["word", *(f"s{s}" for s in range(held.shape[1]))])


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    seen: dict[str, int] = {}
    for w in set(words):
        seen[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter((seen[w] for w in words), dtype=np.uint64, count=len(words))


def _pairs(words: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hash_words(words)
    inside = np.ones(max(0, len(words) - 1), dtype=bool)
    inside[starts[starts > 0] - 1] = False
    return mix(h[:-1] * np.uint64(3) + h[1:]).view(np.int64), inside


def _votes(subjects: list[str], odds: dict[str, np.ndarray], pair_odds: dict[int, np.ndarray], head_odds: dict[str, np.ndarray], source_likes: dict[str, set[int]], address_likes: dict[str, set[int]]):
    """(doc_id, subject, votes of the five functions as digits: 0 against, 1 for, 2 no vote)."""
    n = len(subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = Lexicon(head_odds, n)
        lexicon = Lexicon(odds, n)
        keys = np.array(sorted(pair_odds), dtype=np.int64)
        pairs = Lexicon({}, n)
        pairs.matrix = np.zeros((len(keys) + 1, n), dtype=np.float32)
        for k, p in enumerate(keys.tolist()):
            pairs.matrix[k + 1] = np.clip(pair_odds[p], 0.0, 4.0) * (pair_odds[p] >= WORD_ODDS)
        get = lexicon.index.get
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                words, starts, docs = _flat(texts)
                m = len(texts)
                if not words:
                    continue
                lens = np.diff(np.r_[starts, len(words)])
                ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
                by_word = lexicon.subjects(ids, starts)
                found, inside = _pairs(words, starts)
                pid = np.zeros(len(words), dtype=np.int64)
                if len(keys):
                    spot = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                    pid[:-1] = np.where(inside & (keys[spot] == found), spot + 1, 0)
                by_pair = pairs.subjects(pid, starts)
                total = np.bincount(docs, weights=lens, minlength=m)
                shares = []
                for about in (by_word, by_pair):
                    s = np.zeros((m, n))
                    ok = about >= 0
                    np.add.at(s, (docs[ok], about[ok]), lens[ok])
                    shares.append(s / np.maximum(total, 1)[:, None])
                titles = batch.column(4).to_pylist()
                head_words, head_starts, head_docs = _flat([headings(title, text or "") for title, text in zip(titles, texts)])
                headed: list[set[int]] = [set() for _ in range(m)]
                if head_words:
                    get_head = heads.index.get
                    about = heads.subjects(np.fromiter((get_head(w, 0) for w in head_words), dtype=np.int64, count=len(head_words)), head_starts)
                    for d, s in zip(head_docs.tolist(), about.tolist()):
                        if s >= 0:
                            headed[d].add(s)
                rows, subs, votes = [], [], []
                for d in np.flatnonzero(((shares[0] > 0.02) | (shares[1] > 0.02)).any(axis=1)).tolist():
                    src, docket = batch.column(2)[d].as_py(), batch.column(3)[d].as_py()
                    liked = set().union(*(address_likes.get(x, ()) for x in addresses(docket, texts[d] or "")))
                    paired = shares[1][d].sum()  # pairs tell fewer sentences than words: against only where they tell enough of other subjects
                    for s in np.flatnonzero((shares[0][d] > 0.02) | (shares[1][d] > 0.02)).tolist():
                        v = [
                            "1" if shares[0][d, s] >= SHARE else "0",
                            "1" if shares[1][d, s] >= SHARE else "0" if paired > 0.1 and shares[1][d, s] < SHARE / 2 * paired else "2",
                            ("1" if s in headed[d] else "0") if headed[d] else "2",
                            "1" if s in liked else "2",
                            "1" if s in source_likes.get(src or "", ()) else "2",
                        ]
                        rows.append(d)
                        subs.append(subjects[s])
                        votes.append("".join(v))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(subs, pa.string()), pa.array(votes, pa.string())], ["doc_id", "subject", "votes"])

    return run


def _likelihood(table: np.ndarray, votes: np.ndarray) -> np.ndarray:
    like = np.ones((2, len(votes)))
    for f in range(votes.shape[1]):
        like *= table[:, f, :][:, votes[:, f]]
    return like


def _table(post: np.ndarray, count: np.ndarray, votes: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """[class for / against][function][vote]: how often each class votes so; drawn to base as by DRAWN documents."""
    out = np.empty((2, votes.shape[1], 3))
    for c, w in enumerate((post * count, (1 - post) * count)):
        for f in range(votes.shape[1]):
            seen = np.bincount(votes[:, f], weights=w, minlength=3)
            out[c, f] = (seen + 1.0) / (w.sum() + 3.0) if base is None else (seen + DRAWN * base[c, f]) / (w.sum() + DRAWN)
    return out


def posteriors(patterns: dict[tuple[str, str], int], rounds: int = 30) -> dict[tuple[str, str], float]:
    """(subject, votes) -> probability of the subject, from how often each pattern of votes occurs.

    A latent class model, fitted first to all subjects together and then to each by itself, its accuracies
    drawn to those of all.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    votes = np.array([[int(c) for c in k[1]] for k in keys])
    count = np.array([patterns[k] for k in keys], dtype=float)
    # Votes for and against lean to the truth at first, as far as each function is expected to be right.
    right = np.array([0.9, 0.85, 0.75, 0.55, 0.55][: votes.shape[1]])
    table = np.stack([np.stack([1 - right, right, np.full_like(right, 0.5)], axis=1), np.stack([right, 1 - right, np.full_like(right, 0.5)], axis=1)])
    prior = 0.4

    def fit(rows: np.ndarray, table: np.ndarray, prior: float, base: np.ndarray | None) -> tuple[np.ndarray, float, np.ndarray]:
        v, c, first = votes[rows], count[rows], prior
        for _ in range(rounds):
            like = _likelihood(table, v)
            post = prior * like[0] / (prior * like[0] + (1 - prior) * like[1])
            drawn = 0.0 if base is None else DRAWN
            prior = float(((post * c).sum() + drawn * first) / (c.sum() + drawn))
            table = _table(post, c, v, base)
        return table, prior, post

    table, prior, _ = fit(np.arange(len(keys)), table, prior, None)
    subjects = np.array([k[0] for k in keys])
    out = {}
    for s in dict.fromkeys(subjects.tolist()):
        rows = np.flatnonzero(subjects == s)
        _, _, post = fit(rows, table, prior, table)
        out |= {keys[r]: float(p) for r, p in zip(rows, post)}
    return out


def _likes(pairs: list[tuple[str, int]], n: int) -> dict[str, set[int]]:
    """Subjects that are twice as common with a value as elsewhere, among the labelled."""
    total, each = Counter(s for _, s in pairs), Counter(pairs)
    size = Counter(v for v, _ in pairs)
    out: dict[str, set[int]] = defaultdict(set)
    for (v, s), k in each.items():
        if size[v] >= 10 and k >= 5 and k / size[v] >= 2 * total[s] / len(pairs):
            out[v].add(s)
    return dict(out)


def _widened(documents: DataFrame, odds: dict[str, np.ndarray], cols: list[str]) -> dict[str, np.ndarray]:
    """Log odds of the words of all documents that keep to one subject, by the subjects of their sentences so far."""
    n = len(cols)
    counted = documents.select("text").where(F.col("text").isNotNull()).mapInArrow(_wide(odds, n), "word string, " + ", ".join(f"{c} long" for c in cols))
    sums = cut(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in cols]), "words")
    sizes = sums.agg(*[F.sum(c).alias(c) for c in cols]).first()
    sizes = np.array([float(sizes[c] or 0) + 1.0 for c in cols])
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    most = F.greatest(*cols) if n > 1 else F.col(cols[0])
    wide = sums.withColumn("total", total).where((F.col("total") >= max(WIDE_COUNT, WIDE_PART * sizes.sum())) & (most >= WIDE_SHARE * F.col("total")))
    out = {}
    for r in wide.collect():  # at most 1 / WIDE_PART words
        if (new := _odds(np.array([r[x] for x in cols], dtype=float), sizes)) is not None:
            out[r.word] = new
    return out


@settled
def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, labelled_docs: int = LABELLED_DOCS) -> DataFrame:
    """(doc_id, subject) for each subject of a document, none for one without real text.

    documents: doc_id, text, title, source, docket_id (title may be missing); labels: doc_id, subject (case and blanks don't matter;
    unknown subjects and documents are left out; wrong ones are outvoted); subjects: subject. Null
    and blank texts have no subject; a repeated doc_id with the same text counts once. Without
    labels or subjects the result is empty. Whole texts are read; other columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted({r.subject for r in subjects.select("subject").distinct().limit(MAX_SUBJECTS + 2).collect() if r.subject})
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    if "title" not in documents.columns:
        documents = documents.withColumn("title", F.lit(None).cast("string"))
    at = {s.lower(): k for k, s in enumerate(names)}
    n = len(names)
    empty = documents.select("doc_id", F.lit("").alias("subject")).where(F.lit(False))
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(*at)) if at else labels.where(F.lit(False))
    chosen = named.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_docs)
    taught = documents.join(F.broadcast(chosen), "doc_id").select("text", "subjects", "source", "docket_id", "title").where(F.col("text").isNotNull()).collect()
    if not taught:
        return empty
    texts, labelled = [r.text for r in taught], [[at[s] for s in r.subjects] for r in taught]
    odds = fit_lexicon(texts, labelled, n)

    cols = [f"s{k}" for k in range(n)]
    for _ in range(WIDENINGS):
        odds = odds | _widened(documents, odds, cols)

    pair_odds = fit_lexicon(texts, labelled, n, pairs=True)
    head_odds = fit_lexicon([headings(r.title, r.text) for r in taught], labelled, n)
    sources = _likes([(r.source, s) for r, ls in zip(taught, labelled) for s in ls if r.source], n)
    known = _likes([(x, s) for r, ls in zip(taught, labelled) for x in addresses(r.docket_id, r.text) for s in ls], n)
    kind = documents.select("doc_id").dtypes[0][1]
    rows = documents.select("doc_id", "text", "source", "docket_id", "title").where(F.col("text").isNotNull())
    votes = cut(rows.mapInArrow(_votes(names, odds, pair_odds, head_odds, sources, known), f"doc_id {kind}, subject string, votes string"), "votes")
    patterns = {(r.subject, r.votes): r.n for r in votes.groupBy("subject", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2 * 3 ** 4 a subject
    likely = [k for k, p in posteriors(patterns).items() if p >= 0.5]
    if not likely:
        return empty
    chosen = F.broadcast(spark.createDataFrame(likely, "subject string, votes string"))
    return votes.join(chosen, ["subject", "votes"]).select("doc_id", "subject").distinct()
