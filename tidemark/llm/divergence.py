"""Divergence of sources by in-mapper stripes.

Every task folds whole documents into hash stripes: term to (document frequency, occurrences by source), per language.
A task spills its stripes when they grow beyond a bound; equal (language, term) keys meet sorted and are merged as a
stream. A merged stripe is one row of the term-by-source table of its language, so it adds directly to the divergence
of each pair of sources and offers the term to each source's list; the tables themselves are never built.

All arithmetic is on whole numbers. With V kept terms, a group's share of a term is
1 + floor(10^9 * (count + 1) / (N + V)), N the group's occurrences of kept terms, and a term's divergence of share p from
share q is floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import sliced

#: Terms in UTF-8: A-Z become a-z, other letters and all bytes of longer characters stay, everything else separates.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRIPE = "lang string, term string, n_docs long, sources array<string>, counts array<long>"
#: Elements of a term-by-source block that a task works on at once.
BLOCK = 1 << 20


def terms(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and non-ASCII characters as UTF-8 bytes."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / total), in three steps of 1,000 so that nothing overflows below 9 * 10^15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1_000
        out = out * 1_000 + rest // total
        rest %= total
    return out + 1


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n


class Stripes:
    """The hash stripes of one language inside a task."""

    def __init__(self) -> None:
        self.terms, self.sources = _Numbers(), _Numbers()
        self.n_docs, self.cells = np.empty(0, np.int64), (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.waiting = 0

    def add(self, source: str, text: str) -> None:
        counts = Counter(terms(text))
        if counts:
            ids = np.fromiter(map(self.terms.__getitem__, counts), np.int64, len(counts))
            self.new.append((ids, np.fromiter(counts.values(), np.int64, len(counts)), self.sources[source]))
            self.waiting += len(ids)

    def fold(self) -> None:
        """Take the documents that came since the last call into the stripes."""
        if not self.new:
            return
        ids = np.concatenate([i for i, _, _ in self.new])
        more = np.bincount(ids, minlength=len(self.terms))
        more[: len(self.n_docs)] += self.n_docs
        self.n_docs = more
        sources = np.repeat([s for _, _, s in self.new], [len(i) for i, _, _ in self.new])
        at = np.concatenate([self.cells[0], np.stack([ids, sources])], axis=1)
        n = np.concatenate([self.cells[1], *(c for _, c, _ in self.new)])
        key, inverse = np.unique(at[0] * len(self.sources) + at[1], return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, inverse, n)
        self.cells = (np.stack(np.divmod(key, len(self.sources))), sums)
        self.new, self.waiting = [], 0

    def batches(self, lang: str, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        self.fold()
        (ids, sources), sums = self.cells
        names = pa.array(list(self.sources), pa.string())
        keys = pa.array(list(self.terms), pa.binary()).cast(pa.string())
        for first in range(0, len(self.terms), rows):
            last = min(first + rows, len(self.terms))
            offsets = np.searchsorted(ids, np.arange(first, last + 1))
            cut = slice(offsets[0], offsets[-1])
            offsets = pa.array((offsets - offsets[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(lang, pa.string()), last - first),
                    keys.slice(first, last - first),
                    pa.array(self.n_docs[first:last]),
                    pa.ListArray.from_arrays(offsets, names.take(pa.array(sources[cut]))),
                    pa.ListArray.from_arrays(offsets, pa.array(sums[cut])),
                ],
                ["lang", "term", "n_docs", "sources", "counts"],
            )


def _folded(most_terms: int, most_cells: int):
    """Documents (lang, source, text) of a task to its stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Stripes] = {}
        for batch in sliced(batches, "text", 8_000_000):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                held.setdefault(lang, Stripes()).add(source, text)
            if sum(s.waiting for s in held.values()) > most_cells:
                for s in held.values():
                    s.fold()
            if sum(len(s.terms) for s in held.values()) > most_terms or sum(len(s.cells[1]) for s in held.values()) > most_cells:
                for lang, s in held.items():
                    yield from s.batches(lang)
                held = {}
        for lang, s in held.items():
            yield from s.batches(lang)

    return run


def _merge(table: pa.Table) -> pa.RecordBatch:
    """One stripe per key from rows sorted by (lang, term)."""
    table = table.combine_chunks()
    lang, term, n_docs, sources, counts = (c.chunk(0) for c in table.columns)
    new = np.ones(len(lang), dtype=bool)
    new[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    names = pc.dictionary_encode(sources.flatten())
    sizes = pc.list_value_length(sources).to_numpy(zero_copy_only=False)
    width = max(len(names.dictionary), 1)
    key, inverse = np.unique(np.repeat(run, sizes) * width + names.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, inverse, counts.flatten().to_numpy())
    of, name = np.divmod(key, width)
    offsets = pa.array(np.searchsorted(of, np.arange(len(starts) + 1)).astype(np.int32))
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays(
        [
            lang.take(at),
            term.take(at),
            pa.array(np.add.reduceat(n_docs.to_numpy(), starts)),
            pa.ListArray.from_arrays(offsets, names.dictionary.take(pa.array(name))),
            pa.ListArray.from_arrays(offsets, pa.array(sums)),
        ],
        ["lang", "term", "n_docs", "sources", "counts"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted partial stripes to whole ones; the last key of a batch waits for the next."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        found = _merge(pa.Table.from_batches([b for b in (held, batch) if b is not None]))
        if found.num_rows > 1:
            yield found.slice(0, found.num_rows - 1)
        held = found.slice(found.num_rows - 1)
    if held is not None:
        yield held


def stripes(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    most_terms: int = 300_000, most_cells: int = 2_000_000,
) -> DataFrame:
    """(lang, term, n_docs, sources, counts): one row per language and term, with the documents that hold the term and
    its occurrences by source.

    NULL text, language and source count as ''. A task spills its stripes beyond `most_terms` terms or `most_cells`
    (term, source) cells; both bound its memory and change nothing in the result.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    partial = rows.mapInArrow(_folded(most_terms, most_cells), STRIPE)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merged, STRIPE)


class _Best:
    """The `most` greatest values with their terms; equal values by term in byte order."""

    def __init__(self, most: int) -> None:
        self.most, self.rows = most, []

    def offer(self, values: np.ndarray, at: np.ndarray, words: pa.Array) -> None:
        if len(self.rows) == self.most:
            at = at[values[at] >= self.rows[-1][0]]
        if len(at) > self.most:
            at = at[values[at] >= np.partition(values[at], -self.most)[-self.most]]
        if len(at):
            found = zip(values[at].tolist(), words.take(pa.array(at)).to_pylist(), strict=True)
            self.rows = sorted([*self.rows, *found], key=lambda r: (-r[0], r[1].encode()))[: self.most]


def _emitted(most: int):
    """Whole stripes, with their language's totals, to sums per pair of sources and the leading terms per source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, list[str]] = {}
        sums: dict[str, np.ndarray] = {}
        best: dict[str, list[_Best]] = {}
        for batch in batches:
            lang = batch.column("lang")
            if not len(lang):
                continue
            new = np.ones(len(lang), dtype=bool)
            new[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            starts = [*np.flatnonzero(new).tolist(), len(lang)]
            for first, last in zip(starts, starts[1:], strict=False):
                info = {c: batch.column(c)[first].as_py() for c in ("lang", "names", "totals", "v")}
                at = {n: i for i, n in enumerate(info["names"])}
                size, key = len(at), info["lang"]
                if key not in names:
                    names[key], sums[key], best[key] = info["names"], np.zeros((size, size), np.int64), [_Best(most) for _ in at]
                totals = np.array(info["totals"], np.int64) + info["v"]
                step = max(1, BLOCK // size)
                for low in range(first, last, step):
                    part = batch.slice(low, min(step, last - low))
                    sources = pc.dictionary_encode(part.column("sources").flatten())
                    places = np.array([at[n] for n in sources.dictionary.to_pylist()], np.int64)
                    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("sources")).to_numpy(zero_copy_only=False))
                    counts = np.zeros((part.num_rows, size), np.int64)
                    counts[row, places[sources.indices.to_numpy(zero_copy_only=False)]] = part.column("counts").flatten().to_numpy()
                    p = share(counts, totals)
                    q = share(counts.sum(axis=1), totals.sum() - (size - 1) * info["v"])
                    for s in range(size):
                        gap = p[:, s, None] - p
                        sums[key][s] += ((gap * gap).view(np.uint64) // p.view(np.uint64)).sum(axis=0).astype(np.int64)
                        over = p[:, s] - q
                        best[key][s].offer(over * over // q, np.flatnonzero((counts[:, s] > 0) & (over > 0)), part.column("term"))
        for key, own in names.items():
            rows = [(own[s], "pair", own[t], int(sums[key][s, t])) for s in range(len(own)) for t in range(len(own)) if s != t]
            rows += [(own[s], "term", term, value) for s, b in enumerate(best[key]) for value, term in b.rows]
            source, part, item, value = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(key, pa.string()), len(rows)), *(pa.array(x, pa.string()) for x in (source, part, item)), pa.array(value, pa.int64())],
                ["lang", "source", "part", "item", "value"],
            )

    return run


def divergences(
    docs: DataFrame, least_docs: int = 3, most: int = 200, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of rows with one language and source.

    Part `pair` has every other source of the language, `value` the sum of the group's divergences from it over all
    kept terms; part `term` has the `most` kept terms by which the group exceeds its language the most. A language
    keeps the terms that at least `least_docs` of its documents hold. Ranks go by falling value, then by item in byte order.

    NULL text, language and source count as ''. Groups without terms take part, with their smoothed shares; a language
    without kept terms has pairs of value 0 and no terms. Repeated rows count each time. Other columns are ignored; an
    empty table gives no rows. A task holds one sum per pair of sources of a language, of which the result has one row each.
    """
    kept = staged(stripes(docs, lang, source, text).filter(F.col("n_docs") >= least_docs), "stripes")
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    cells = kept.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    cells = cells.toDF("lang", "source", "n")
    counted = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    listed = F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
    infos = counted.groupBy("lang").agg(listed.alias("g")).select("lang", F.col("g.source").alias("names"), F.col("g.n").alias("totals"))
    infos = infos.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left")
    infos = staged(infos, "stripe-totals")

    found = kept.select("lang", "term", "sources", "counts").join(infos, "lang").mapInArrow(
        _emitted(most), "lang string, source string, part string, item string, value long"
    )
    none = infos.filter("v IS NULL").select("lang", "names", F.explode("names").alias("source"))
    none = none.select("lang", "source", F.lit("pair").alias("part"), F.explode("names").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none.filter("item != source"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= most))


def oracle_sql() -> str:
    """The same over `documents` in DuckDB, with the parameters above."""
    return """
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body, row_number() OVER () AS r FROM documents),
words AS (SELECT lang, source, r, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN cells USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p
    FROM totals g JOIN v USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
langs AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(t.total) + any_value(v.v)) AS q
    FROM shares JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares JOIN langs USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
