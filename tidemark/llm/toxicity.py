"""Toxicity by weak supervision.

Terms that mark toxic texts are mined from a bounded sample of labelled rows. All of them that no other one implies,
and fixed surface patterns, become voters. A generative label model estimates from the votes of *all* documents how often each voter
fires per class and how voters depend on each other; its posteriors, not the labels, train a linear classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import staged
from .common import fold, list_array, sliced, texts, words

EDGE = b".,;:!?\"'()[]{}<>*_-"
PREFIXES = (4, 5, 6, 7, 8)
#: Surface patterns beside the mined terms: characters of which a text needs one, then what has to be found. Each is
#: one voter and one feature.
PATTERNS = {
    "shouted": ("", re.compile(r"[A-Z]{3,}\W+[A-Z]{3,}\W+[A-Z]{3,}")),
    "exclaimed": ("!?", re.compile(r"!{2,}|[!?]{3,}")),
    "masked": ("*@#$", re.compile(r"[A-Za-z][*@#$]+[A-Za-z]")),
}
#: Each leading term has one voter per number of occurrences, counted up to these bounds; the bins exclude each other.
BINS = (1, 3)
#: Within-class correlation up to which voters count as independent: classes mix languages, whose voters exclude each other.
FREE = 0.3
#: A term has to occur in this share of the sampled toxic texts.
LEAST_REACH = 0.005


@dataclass(frozen=True)
class Model:
    """Terms (at most `max_terms`), the label model's rates, and the linear weights: a bounded object."""

    terms: tuple[bytes, ...]
    weights: np.ndarray
    bias: float
    voters: int = 0
    prior: float = 0.5
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    damping: np.ndarray = field(default_factory=lambda: np.zeros(0))


def forms(word: bytes) -> list[bytes]:
    """The word without surrounding punctuation, and its prefixes by characters, marked with a trailing `*`."""
    word = word.strip(EDGE)
    if not word:
        return []
    out = [word]
    if len(word) > PREFIXES[0]:
        chars = word.decode("utf-8", "ignore")
        out += [chars[:n].encode() + b"*" for n in PREFIXES if len(chars) > n]
    return out


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many sampled documents of either class each form occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def rows():
            for label, counter in found.items():
                for term in [*counter]:
                    yield term, label, counter[term]
                counter.clear()

        def flush():
            got = [*rows()]
            if got:
                term, label, n = zip(*got, strict=True)
                hot = pa.array([c if t else 0 for t, c in zip(label, n, strict=True)], pa.int64())
                cold = pa.array([0 if t else c for t, c in zip(label, n, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.binary()), hot, cold], ["term", "toxic", "clean"])

        for batch in sliced(batches, "text", 4_000_000):
            for text, label in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                found[label].update({f for w in {*words(text)} for f in forms(w)})
            if sum(map(len, found.values())) > 400_000:
                yield from flush()
        yield from flush()

    counted = sample.select("text", "toxic").mapInArrow(count, "term binary, toxic long, clean long")
    return counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample with one row of every group of copies, exact or near: a toxic text with many copies would make each of
    its rare words look telling. Rows that share one of three min-hashes over five-word shingles count as copies."""
    schema = StructType([*sample.schema.fields, *StructType.fromDDL("s0 long, s1 long, s2 long").fields])
    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4_000_000):
            least = np.zeros((batch.num_rows, 3), dtype=np.uint64)
            for i, text in enumerate(texts(batch)):
                some = words(text)
                spans = range(max(len(some) - 4, 1))
                hashes = np.array([xxhash.xxh64_intdigest(b" ".join(some[j : j + 5])) for j in spans], dtype=np.uint64)
                least[i] = (hashes[:, None] * odd[None, :]).min(axis=0)
            signs = [pa.array(least[:, k].copy().view(np.int64), pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *signs], schema.names)

    out = sample.mapInArrow(sign, schema)
    first = F.struct(F.xxhash64("row_key"), F.xxhash64("text"))
    for k in range(3):
        out = out.groupBy(F.col(f"s{k}").alias("_s")).agg(F.min_by(F.struct(*schema.names), first).alias("_row")).select("_row.*")
    return out.select(*sample.columns)


def _mined(sample: DataFrame, toxic: int, clean: int, max_terms: int, least: float) -> list[tuple[bytes, int, int]]:
    """At most `max_terms` terms that speak for toxicity beyond chance, the most telling first."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    share = (t + c) / (toxic + clean)
    g = 2 * (t * F.log(t / (share * toxic)) + F.when(c > 0, c * F.log(c / (share * clean))).otherwise(0.0))
    strong = _term_counts(sample).filter(t >= max(3.0, LEAST_REACH * toxic)).filter((odds > 2.0) & (g > least))
    rows = strong.withColumn("g", g).orderBy(F.desc("g"), "term").limit(4 * max_terms).collect()
    picked: dict[bytes, tuple[int, int]] = {}
    above: set[bytes] = set()
    for r in rows:
        term = bytes(r.term)
        chars = term.rstrip(b"*").decode("utf-8", "ignore")
        parents = {chars[:n].encode() + b"*" for n in PREFIXES} - {term}
        nearest = max((p for p in parents if p in picked), key=len, default=None)
        if term in above:  # a shorter form of a term that tells more
            continue
        if nearest and (r.clean + 1) / (r.toxic + 1) >= 0.25 * (picked[nearest][1] + 1) / (picked[nearest][0] + 1):
            continue  # a longer form that is hardly purer
        picked[term] = (r.toxic, r.clean)
        above |= parents
    return [(term, *n) for term, n in picked.items()][:max_terms]


def _hits(rows: DataFrame, terms: tuple[bytes, ...]) -> DataFrame:
    """The rows without their text, with `hits` (ids of the terms and patterns, one entry per occurrence) and `n_words`."""
    ids = {term: i for i, term in enumerate(terms)}
    patterns = [(len(ids) + i, p) for i, p in enumerate(PATTERNS.values())]
    starts = {t.rstrip(b"*")[:3] for t in ids}
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in sliced(batches, "text", 8_000_000):
            hits, sizes = [], []
            for text in texts(batch):
                found, some = [], words(text)
                for w in some:
                    got = known.get(w)
                    if got is None:
                        got = tuple(ids[f] for f in forms(w) if f in ids) if w.lstrip(EDGE)[:3] in starts else ()
                        if len(known) > 200_000:
                            known.clear()
                        known[w] = got
                    if got:
                        found += got
                found += [i for i, (need, p) in patterns if (not need or any(c in text for c in need)) and p.search(text)]
                hits.append(np.array(found, dtype=np.int32))
                sizes.append(len(some))
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, list_array(hits, pa.int32()), pa.array(sizes, pa.int64())], [*(f.name for f in kept), "hits", "n_words"]
            )

    return rows.mapInArrow(run, StructType([*kept, *StructType.fromDDL("hits array<int>, n_words long").fields]))


def _leading(terms: tuple[bytes, ...]) -> list[int]:
    """Ids of the terms that no other term implies. A longer form occurs only together with its prefix, so whatever text
    has a term has a leading one; a word as long as the prefix is not a form of it."""
    prefixes = {t[:-1] for t in terms if t.endswith(b"*")}
    out = []
    for i, term in enumerate(terms):
        chars = term.rstrip(b"*").decode("utf-8", "ignore")
        if not any(len(chars) > n and chars[:n].encode() in prefixes for n in PREFIXES):
            out.append(i)
    return out


def _with_votes(hits: DataFrame, leading: list[int], terms: int) -> DataFrame:
    """The rows with `votes`, the sorted voters that fire: a leading term's by its number of occurrences, the patterns',
    and the last one if nothing was found. Every text has one at least."""
    schema = StructType([*hits.schema.fields, *StructType.fromDDL("votes array<int>").fields])
    bins, places = len(BINS) + 1, np.full(terms + len(PATTERNS), -1)
    places[leading] = np.arange(len(leading))
    places[terms:] = bins * len(leading) + np.arange(len(PATTERNS))
    nothing = np.array([bins * len(leading) + len(PATTERNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = []
            for found in batch.column("hits").to_pylist():
                ids, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
                at = places[ids] + np.where(ids < terms, np.searchsorted(BINS, n) * len(leading), 0)
                fired.append(np.sort(at[places[ids] >= 0]) if found else nothing)
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(fired, pa.int32())], schema.names)

    return hits.mapInArrow(run, schema)


def _evidence(votes: list, gain: np.ndarray) -> np.ndarray:
    """Sum of the gains of the voters that fire, per row."""
    row = np.repeat(np.arange(len(votes)), [len(v) for v in votes])
    flat = np.array([i for v in votes for i in v], dtype=np.int64)
    return np.bincount(row, gain[flat], minlength=len(votes))


def _toxic_share(batch: pa.RecordBatch, gain: np.ndarray, start: float) -> tuple[list, np.ndarray]:
    """Votes of every pattern, and the known label or else the posterior."""
    votes = batch.column("votes").to_pylist()
    p = 1 / (1 + np.exp(-np.clip(start + _evidence(votes, gain), -40, 40)))
    label = pc.fill_null(batch.column("label"), -1).to_numpy()
    return votes, np.where(label < 0, p, label) * 1.0


def _damping(patterns: DataFrame, gain: np.ndarray, start: float, mean: np.ndarray, size: float) -> np.ndarray:
    """One over one plus the sum of a voter's correlations above FREE among toxic texts. Pairs that never fire together
    do not correlate, so only the pairs that do are summed: at most voters x voters."""
    voters = len(mean)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, p = _toxic_share(batch, gain, start)
            weight = p * batch.column("n").to_numpy()
            codes, shares, held = [], [], 0

            def flush():
                found, at = np.unique(np.concatenate(codes), return_inverse=True)
                v = np.bincount(at, np.concatenate(shares))
                codes.clear()
                shares.clear()
                return pa.RecordBatch.from_pydict({"pair": pa.array(found, pa.int64()), "v": pa.array(v, pa.float64())})

            for some, w in zip(votes, weight, strict=True):
                if len(some) < 2:
                    continue
                fired = np.array(some, dtype=np.int64)
                one, two = np.triu_indices(len(fired), 1)
                codes.append(fired[one] * voters + fired[two])
                shares.append(np.full(len(one), w))
                held += len(one)
                if held > 1_000_000:
                    yield flush()
                    held = 0
            if codes:
                yield flush()

    def excess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = np.divmod(batch.column("pair").to_numpy(), voters)
            corr = (batch.column("v").to_numpy() / size - mean[one] * mean[two]) / (sd[one] * sd[two])
            over = np.clip((corr - FREE) / (1 - FREE), 0.0, 1.0)
            at, v = np.concatenate([one, two]), np.concatenate([over, over])
            yield pa.RecordBatch.from_pydict({"at": pa.array(at[v > 0], pa.int32()), "v": pa.array(v[v > 0], pa.float64())})

    summed = patterns.mapInArrow(pairs, "pair long, v double").groupBy("pair").agg(F.round(F.sum("v"), 6).alias("v"))
    total = np.zeros(voters)
    for r in summed.mapInArrow(excess, "at int, v double").groupBy("at").agg(F.round(F.sum("v"), 9).alias("v")).collect():
        total[r["at"]] = r.v
    return 1.0 / (1.0 + total)


def _label_model(patterns: DataFrame, first: np.ndarray, prior: float, rounds: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Class prior, rates (2 x voters) and damping by expectation-maximisation over all vote patterns.

    `patterns` has one row per distinct vote pattern (votes, known label or NULL) and its number of documents. Each
    round is one aggregation of partial sums whose size is fixed. A voter that does not fire abstains and says nothing;
    that no term and no pattern was found is a voter of its own. Voters that fire together within a class beyond chance
    share their say: a voter's evidence is divided by one plus the sum of its correlations above FREE, rescaled to 0 to 1.
    """
    voters = first.shape[1]
    rates, damping = first, np.ones(voters)
    for step in range(rounds):
        gain = damping * (np.log(rates[1]) - np.log(rates[0]))
        start = float(np.log(prior / (1 - prior)))

        def sums(batches: Iterator[pa.RecordBatch], gain=gain, start=start) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, voters + 1))
            for batch in batches:
                votes, p = _toxic_share(batch, gain, start)
                row = np.repeat(np.arange(len(votes)), [len(v) for v in votes])
                flat = np.array([i for v in votes for i in v], dtype=np.int64)
                for c, share in enumerate((1 - p, p)):
                    weight = share * batch.column("n").to_numpy()
                    total[c, :-1] += np.bincount(flat, weight[row], minlength=voters)
                    total[c, -1] += weight.sum()
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel(), pa.float64())})

        # whole documents times probabilities: rounding makes the sums independent of their order
        found = patterns.mapInArrow(sums, "at int, v double").groupBy("at").agg(F.round(F.sum("v"), 6).alias("v")).collect()
        total = np.zeros(2 * (voters + 1))
        for r in found:
            total[r["at"]] = r.v
        total = total.reshape(2, voters + 1)
        sizes = np.maximum(total[:, -1], 1e-9)
        prior = min(max(sizes[1] / sizes.sum(), 1e-4), 0.5)
        mean = total[:, :-1] / sizes[:, None]
        rates = np.clip((total[:, :-1] + np.array([[0.05], [0.5]])) / (sizes[:, None] + 1), 1e-6, 1 - 1e-6)
        if step == 0:
            damping = _damping(patterns, gain, start, mean[1], sizes[1])
    return prior, rates, damping


def _features(hits: np.ndarray, n_words: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of one document: per term and pattern whether it occurs and how often again, then all hits and
    hits per hundred words."""
    ids, n = np.unique(hits, return_counts=True)
    total = float(n[ids < width - len(PATTERNS)].sum())
    again = n > 1
    extra = [np.log1p(total), min(100.0 * total / max(n_words, 1), 20.0) / 5.0]
    where = np.concatenate([ids, ids[again] + width, [2 * width, 2 * width + 1]])
    return where, np.concatenate([np.ones(len(ids)), np.minimum(np.log2(n[again]), 3.0), extra])


def _linear(rows: list, target: np.ndarray, width: int, steps: int = 400, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; deterministic."""
    parts = [_features(np.array(r.hits, dtype=np.int64), r.n_words, width) for r in rows]
    row = np.repeat(np.arange(len(parts)), [len(i) for i, _ in parts])
    col = np.concatenate([i for i, _ in parts]).astype(np.int64)
    val = np.concatenate([v for _, v in parts])
    size = 2 * width + 2
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    look, look_b, n = w.copy(), b, len(parts)
    rate = 4.0 / (1.0 + np.bincount(row, val * val, minlength=n).mean())
    for step in range(steps):
        z = np.bincount(row, val * look[col], minlength=n) + look_b
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.bincount(col, val * error[row], minlength=size) / n + ridge * look
        nw, nb = look - rate * grad, look_b - rate * error.mean()
        pull = step / (step + 3)
        look, look_b, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_labelled: int = 8_000,
    max_terms: int = 1_000,
    least_evidence: float = 18.0,
    rounds: int = 4,
) -> tuple[Model, DataFrame]:
    """The model, and (key, text_hash, hits, n_words) of every document.

    At most `max_labelled` labelled rows, those with the smallest key hashes, mine the terms, start the label model
    and train the classifier. The label model's rates and correlations come from the votes of all documents. NULL
    labels are ignored; a key with several labels counts as toxic if one of them does. Without toxic or without
    clean labelled rows there are no terms and every text gets the class prior.
    """
    rows = docs.select(F.col(key).alias("row_key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("row_key"))
    marks = marks.agg(F.max(F.col(label).cast("int")).alias("toxic"))
    marks = staged(marks.orderBy(F.xxhash64("row_key"), "row_key").limit(max_labelled), "toxicity-labels")
    # at most max_labelled rows of a key and a number: small enough to broadcast at any size of the corpus
    sample = staged(rows.join(F.broadcast(marks), "row_key"), "toxicity-sample")
    apart = staged(_one_of_copies(sample), "toxicity-apart")
    n = {r.toxic: r.n for r in apart.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    mined = _mined(apart, toxic, clean, max_terms, least_evidence) if toxic and clean else []
    terms = tuple(t for t, _, _ in mined)
    hits = staged(_hits(rows, terms), "toxicity-hits")
    width = len(terms) + len(PATTERNS)
    prior = min(max((toxic + 0.5) / (toxic + clean + 1), 1e-3), 0.5)
    if not terms:
        return Model(terms, np.zeros(2 * width + 2), float(np.log(prior / (1 - prior)))), hits

    # all terms are features; the voters are the leading ones
    leading = _leading(terms)
    voting = _with_votes(hits.join(F.broadcast(marks), "row_key", "left"), leading, len(terms))
    patterns = voting.groupBy("votes", F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    patterns = staged(patterns, "toxicity-votes")
    # to begin with, every further bin is rarer, and more so among clean texts
    shares = ((0.85, 0.5), (0.12, 0.3), (0.03, 0.2))
    start = [(cold * (c + 0.05) / (clean + 1), hot * (t + 0.5) / (toxic + 1)) for cold, hot in shares for _, t, c in (mined[i] for i in leading)]
    first = np.array([*start, *[(0.02, 0.04)] * len(PATTERNS), (0.8, 0.05)]).T
    prior, rates, damping = _label_model(patterns, np.clip(first, 1e-6, 1 - 1e-6), prior, rounds)

    train = _with_votes(hits.join(F.broadcast(marks), "row_key", "left_semi"), leading, len(terms)).select("hits", "n_words", "votes").collect()
    gain = damping * (np.log(rates[1]) - np.log(rates[0]))
    logit = np.log(prior / (1 - prior)) + _evidence([r.votes for r in train], gain)
    weights, bias = _linear(train, 1 / (1 + np.exp(-np.clip(logit, -40, 40))), width)
    return Model(terms, weights, bias, first.shape[1], prior, rates, damping), hits


def score(hits: DataFrame, model: Model) -> DataFrame:
    """The rows without `hits`, with `score` between 0 and 1."""
    width = len(model.terms) + len(PATTERNS)
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def probability(found, n_words):
        import pandas as pd

        out = []
        for h, n in zip(found, n_words, strict=True):
            ids, values = _features(np.asarray(h, dtype=np.int64), int(n), width)
            out.append(1.0 / (1.0 + np.exp(-np.clip(float(values @ weights[ids]) + bias, -40, 40))))
        return pd.Series(out, dtype="float64")

    return hits.withColumn("score", probability("hits", "n_words")).drop("hits")


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", threshold: float = 0.3, folds: int = 4, held_out: int = 2, **options
) -> DataFrame:
    """(key, text_hash, held_out, score, predicted) of every document; labels of the held-out fold are never read.

    One row per input row. NULL and empty texts are scored like texts without any hit.
    """
    seen = labels.filter(fold(key, folds) != held_out)
    model, hits = fit(docs, seen, key=key, **options)
    return score(hits, model).select(
        F.col("row_key").alias(key),
        "text_hash",
        (fold("row_key", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
