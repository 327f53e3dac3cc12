"""Toxicity: weak supervision with a generative label model over lexicon and pattern voters.

1. Lexicon: on at most ``per_class`` labelled rows of each class (the smallest hashes of their ids) every word
   and word beginning of 4 to 6 characters is counted once for each text, near copies (by min-hashes of their word
   ``GRAM``-grams) together as one; of the entries that come with label 1 significantly (at most ``FALSE_SHARE`` of them by
   chance, over all entries that could) and ``MIN_RATIO`` times as often as with label 0, the ``lexicon_size`` with the strongest
   association are kept (beginnings that add nothing to a longer entry come last). No word is given beforehand.
2. Voters: ``GROUPS`` lexicon voters, to which the entries are dealt by strength in turn, so each has strong and weak ones of every
   language, and pattern voters on the number, rate and variety of hits; a voter says yes or no. A word is a hit of its longest entry
   only: voters that fire on the same word, or for one language each, are not independent given the label.
3. Label model: one pass over all texts sums the votes' first and second moments (a bounded matrix). Voter
   accuracies come from triplets of voters, which are independent given the label; pairs whose agreement
   exceeds what their accuracies explain are correlated, and a voter's weight is divided by its correlated company.
4. The posterior labels of **all** texts train a linear classifier on hit counts, rates and lexicon groups, by Newton steps whose
   sums Spark adds over a stored table of votes and features. Given labels choose the voters and the prior; they are no voter
   and no target. The classifier scores every text.

Nulls: a null text is the empty text; it scores as a text without hits. Rows with a null label or id are not
learnt from; without labelled rows the lexicon is empty and all texts score alike. Only ids that ``docs`` holds are drawn; of rows
that repeat a drawn id the least text is learnt from. Repeated rows score alike; empty
tables give empty results. ``score`` keeps all columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, hashed_words, mix, stored

PER_CLASS = 4096
LEXICON_SIZE = 1024
GROUPS = 16
STEMS = (4, 5, 6)
_EDGE = ".,;:!?\"'()[]{}<>|%*#$&-_/"
VOTERS = GROUPS + 5
FEATURES = 8 + GROUPS
MIN_COUNT = 5          # distinct sampled texts of label 1 that an entry is in
MIN_RATIO = 10         # how many times its (smoothed) share of label 1 exceeds that of label 0
FALSE_SHARE = 0.05     # of the entries, those expected by chance (Benjamini and Hochberg)
GRAM = 3               # words in a gram of the near copies' min-hashes
BANDS = 16             # pairs of min-hashes: texts that share one are near copies
MIN_G2 = 6.63          # its likelihood ratio statistic: the 1 % point of chi-square with one degree of freedom
NEWTON_STEPS = 20


def words_of(text: str) -> list[str]:
    return text.lower().split()


def entries_of(text: str) -> set[str]:
    """The words of a text without edge signs, and their beginnings (marked ``*``)."""
    words = {w.strip(_EDGE) for w in words_of(text)}
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


@dataclass
class Lexicon:
    """Entry -> lexicon group."""

    groups: dict[str, int]
    stems: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.stems = {e[:-1]: g for e, g in self.groups.items() if e.endswith("*")}
        self.words = {e: g for e, g in self.groups.items() if not e.endswith("*")}
        self.cache: dict[str, int] = {}

    def group(self, word: str) -> int:
        """The group of the longest entry that the word holds, or -1: a word is evidence for one voter only."""
        w = word.strip(_EDGE)
        if w in self.words:
            return self.words[w]
        return next((self.stems[w[:n]] for n in reversed(STEMS) if len(w) > n and w[:n] in self.stems), -1)

    def votes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Votes (1: yes) of all voters, and the classifier's features."""
        words = words_of(text)
        hits, kinds, by_group = 0, set(), np.zeros(GROUPS)
        cache = self.cache
        for w in words:
            g = cache.get(w)
            if g is None:
                if len(cache) > 300_000:
                    cache.clear()
                g = cache[w] = self.group(w)
            if g >= 0:
                hits += 1
                kinds.add(w)
                by_group[g] += 1
        n, k = len(words), len(kinds)
        rate, many = hits / max(n, 1), int((by_group > 0).sum())
        v = np.zeros(VOTERS, np.int8)
        v[:GROUPS] = by_group > 0
        v[GROUPS:] = hits > 0, k >= 2, rate >= 0.005, hits >= 3, many >= 3
        x = np.array([1.0, np.log1p(hits), np.log1p(k), np.log1p(100 * rate), np.log1p(many),
                      float(k >= 2), float(hits > 0), np.log1p(n) / 10, *(by_group > 0)])
        return v, x


@dataclass
class Model:
    lexicon: Lexicon
    accuracy: np.ndarray
    correlated: np.ndarray
    prior: float
    linear: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.lexicon.votes(t)[1] for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.linear, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, learn_from: Callable, per_class: int) -> tuple[DataFrame | None, dict]:
    """At most ``per_class`` ids of each class among the labelled ids of ``docs``, and the classes' sizes."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(learn_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
             .join(docs.select("doc_id"), "doc_id", "left_semi"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    sample = None
    for y in sorted(sizes):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(per_class)
        sample = own if sample is None else sample.unionByName(own)
    return sample, sizes


def _strength(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """The likelihood ratio statistic (G squared) of an entry's 2 x 2 table."""
    rate = (toxic + clean) / (n1 + n0)

    def part(k: Column, n: Column | float) -> Column:
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    return 2 * (part(toxic, n1 * rate) + part(clean, n0 * rate)
                + part(n1 - toxic, n1 * (1 - rate)) + part(n0 - clean, n0 * (1 - rate)))


def _bands(words: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of each of the texts with these word hashes: of pairs of min-hashes of its grams (0: no gram)."""
    out = np.zeros((len(woff) - 1, BANDS), np.uint64)
    n = len(words) - GRAM + 1
    if n < 1:
        return out
    doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    whole = doc[:n] == doc[GRAM - 1:]
    grams, doc = SpanHash(words)(np.arange(n), GRAM)[whole], doc[:n][whole]
    if len(grams):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        for k in range(BANDS):
            one, two = (np.minimum.reduceat(mix(grams + mix(np.array([2 * k + j + 1], np.uint64))), first) for j in (0, 1))
            out[doc[first], k] = mix(one) + two
    return out


def _marked(rows: DataFrame) -> DataFrame:
    """The distinct sampled rows (``y``, ``text``) and ``copy``: another one with the same ``y`` and a lesser hash shares a band."""
    rows = rows.select("y", "text", F.xxhash64("text").alias("h")).dropDuplicates(["y", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, woff in hashed_words(b.column(1)):
                found = _bands(words, woff)
                at, band = np.nonzero(found)
                take = pa.array(at + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(band, pa.int32()),
                                                  pa.array(found[at, band].view(np.int64))], ["y", "h", "band", "key"])

    bands = stored(rows.select("y", "text", "h").mapInArrow(run, "y int, h long, band int, key long"), "toxicity_bands")
    key = ["y", "band", "key"]
    first = bands.groupBy(*key).agg(F.min("h").alias("_a"), F.max("h").alias("_z")).where("_a < _z")
    later = bands.join(first, key).where("h > _a").select("y", "h").distinct()
    return rows.join(later.withColumn("copy", F.lit(True)), ["y", "h"], "left").select("y", "text", F.coalesce("copy", F.lit(False)).alias("copy"))


def least_strength(counts: dict[int, int], tested: int) -> float:
    """The strength from which on entries are kept; ``counts``: how many have each (whole) strength. Of the kept ones at most
    ``FALSE_SHARE`` are expected by chance among ``tested`` entries, and each has ``MIN_G2`` by itself."""
    kept, least = 0, math.inf
    for g2 in sorted(counts, reverse=True):
        kept += counts[g2]
        if tested * math.erfc(math.sqrt(max(g2, MIN_G2) / 2)) <= FALSE_SHARE * kept:
            least = max(g2, MIN_G2)
    return least


def _learn_lexicon(rows: DataFrame, size: int) -> Lexicon:
    """Entries of the sampled rows (``y``, ``text``) that tell label 1, dealt over the groups by strength in turn."""
    rows = stored(_marked(rows), "toxicity_distinct")
    drawn = {r.y: r["count"] for r in rows.where("not copy").groupBy("y").count().collect()}
    n0, n1 = drawn.get(0, 0), drawn.get(1, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, list[int]] = {}
            for y, text, copy in zip(*(c.to_pylist() for c in b.columns)):
                for e in entries_of(text):
                    n = seen.setdefault(e, [0, 0, 0])
                    if not copy:
                        n[y] += 1
                    n[2] += y
            yield pa.RecordBatch.from_pydict({"entry": pa.array(list(seen), pa.string()),
                                              "clean": pa.array([x[0] for x in seen.values()], pa.int64()),
                                              "toxic": pa.array([x[1] for x in seen.values()], pa.int64()),
                                              "texts": pa.array([x[2] for x in seen.values()], pa.int64())})

    counts = (rows.mapInArrow(count, "entry string, clean long, toxic long, texts long").groupBy("entry")
              .agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "texts"))).where(F.col("texts") + F.col("clean") >= MIN_COUNT))
    counts = stored(counts, "toxicity_counts")
    tested = counts.count()
    counts = (counts.where(F.col("texts") >= MIN_COUNT)
              .where((F.col("toxic") + 0.5) / (n1 + 1) >= MIN_RATIO * (F.col("clean") + 0.5) / (n0 + 1))
              .withColumn("strength", _strength(F.col("toxic"), F.col("clean"), n1, n0)).where(F.col("strength") >= MIN_G2))
    strengths = counts.groupBy(F.floor("strength").cast("int").alias("g2")).count().collect()     # bounded by the sample
    counts = stored(counts.where(F.col("strength") >= least_strength({r.g2: r["count"] for r in strengths}, tested)), "toxicity_entries")
    base = F.rtrim(F.col("entry"), F.lit("*"))
    longer = [F.when(F.char_length(base) > n, F.concat(F.substring(base, 1, n), F.lit("*"))) for n in STEMS]
    implied = (counts.select(F.explode(F.array_compact(F.array(*longer))).alias("entry"), "toxic", "clean").distinct()
               .withColumn("implied", F.lit(True)))
    best = (counts.join(implied, ["entry", "toxic", "clean"], "left")
            .orderBy(F.col("implied").isNotNull(), F.desc("strength"), "entry").limit(size).collect())   # ``size`` entries
    best.sort(key=lambda r: (-r.strength, r.entry))
    groups = {r.entry: i % GROUPS for i, r in enumerate(best)}
    return Lexicon(groups)


def _views(docs: DataFrame, lexicon) -> DataFrame:
    """Votes and features of every text, stored: the only pass over the texts that learning needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.value.votes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"v": pa.array([v.tobytes() for v, _ in got], pa.binary()),
                                              "x": pa.array([x.tobytes() for _, x in got], pa.binary())})

    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stored(texts.mapInArrow(run, "v binary, x binary"), "toxicity_views")


def _total(views: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``of(votes, features)``, ``size`` numbers: a partition sends one row for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int8).reshape(-1, VOTERS)
                total += of(v.astype(float), np.frombuffer(b"".join(b.column("x").to_pylist())).reshape(-1, FEATURES))
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(size), pa.int32()), "value": pa.array(total)})

    out = np.zeros(size)
    for r in views.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect():
        out[r.k] = r.value
    return out


def _moments(views: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Texts, sums of votes and of products of votes, over all texts (exact: whole numbers)."""
    got = _total(views, 1 + VOTERS + VOTERS ** 2, lambda v, x: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]))
    return int(got[0]), got[1:1 + VOTERS], got[1 + VOTERS:].reshape(VOTERS, VOTERS)


def label_model(n: int, first: np.ndarray, second: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Per voter the covariance with the label (as a share of the label's spread), and which voters correlate.

    For voters i, j, k that are independent given the label, cov(i,j) cov(i,k) / cov(j,k) = cov(i, label)^2 /
    var(label): the median over all triplets is taken. Pairs whose covariance exceeds the product by far are
    correlated beyond the label."""
    mean = first / max(n, 1)
    cov = second / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.clip(cov / np.outer(spread, spread), -1, 1)
    m, acc = len(corr), np.zeros(len(corr))
    live = spread > 1e-5
    for i in np.flatnonzero(live):
        pairs = [corr[i, j] * corr[i, k] / corr[j, k] for j in np.flatnonzero(live) for k in np.flatnonzero(live)
                 if j < k and i not in (j, k) and corr[j, k] > 0.02 and corr[i, j] > 0 and corr[i, k] > 0]
        acc[i] = np.sqrt(np.clip(np.median(pairs), 0, 0.98)) if pairs else 0.3
    rest = corr - np.outer(acc, acc)
    company = (rest > 0.15) & ~np.eye(m, dtype=bool) & np.outer(live, live)
    return acc * live, company


def posterior(votes: np.ndarray, model: tuple[np.ndarray, np.ndarray], mean: np.ndarray, spread: np.ndarray, prior: float) -> np.ndarray:
    """P(label 1 | votes). A voter's rates of yes given label 1 and 0 follow from its covariance with the label;
    its log odds are divided by its correlated company."""
    acc, company = model
    sd = np.sqrt(prior * (1 - prior))
    yes1 = np.clip(mean + acc * spread * (1 - prior) / sd, 1e-3, 1 - 1e-3)
    yes0 = np.clip(mean - acc * spread * prior / sd, 1e-3, 1 - 1e-3)
    weight = np.where(acc > 0, 1 / (1 + company.sum(1)), 0)
    evidence = votes * np.log(yes1 / yes0) + (1 - votes) * np.log((1 - yes1) / (1 - yes0))
    odds = np.log(prior / (1 - prior)) + evidence @ weight
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def newton_sums(x: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss of ``w`` on soft labels, summed over the rows, in one vector."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
    return np.concatenate([x.T @ (p - target), h.ravel()])


def logistic(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; ``sums(w)`` gives ``newton_sums`` over all rows."""
    w = np.zeros(size)
    for _ in range(NEWTON_STEPS):
        got = sums(w)
        step = np.linalg.solve(got[size:].reshape(size, size) + ridge * np.eye(size), got[:size] + ridge * w)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, learn_from: Callable = lambda doc_id: F.lit(True),
        per_class: int = PER_CLASS, lexicon_size: int = LEXICON_SIZE) -> Model:
    """Lexicon and prior from ``labels`` rows with ``learn_from(doc_id)``; label model and classifier from all ``docs``."""
    spark = docs.sparkSession
    sample, sizes = _sample(docs, labels, label, learn_from, per_class)
    lexicon = Lexicon({})
    if sample is not None:
        rows = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
                .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")))
        lexicon = _learn_lexicon(stored(rows, "toxicity_sample"), lexicon_size)
    prior = float(np.clip(sizes.get(1, 0) / max(1, sum(sizes.values())), 0.01, 0.99)) if sizes else 0.05
    views = _views(docs, spark.sparkContext.broadcast(lexicon))
    n, first, second = _moments(views)
    acc, company = label_model(n, first, second, prior)
    mean = first / max(n, 1)
    spread = np.sqrt(np.maximum(np.diag(second) / max(n, 1) - mean ** 2, 1e-10))

    def sums(w: np.ndarray) -> np.ndarray:
        return _total(views, FEATURES * (FEATURES + 1),
                      lambda v, x: newton_sums(x, posterior(v, (acc, company), mean, spread, prior), w))

    return Model(lexicon, acc, company, prior, logistic(sums, FEATURES))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability of label 1 (0 to 1)."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = given.value.score([t or "" for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
