"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 q) words long, that no neighbouring
word extends. Inside a run the minima of sliding windows repeat at distance q, so pairs of equal minimizers are
the seeds that extension to both sides turns into runs. The scale with k-word hashes and windows of k / 2 of them finds
every period in (k / 2, k]:

* two windows q words apart fit into a run, since 3 k / 2 - 1 + q <= 4 q, so a minimizer and its copy q words on
  are both chosen;
* nothing equal lies between them: k >= q words that came again after d < q words would have periods q and d, hence
  their greatest common divisor, and q would not be the smallest period of the run.

So the next equal minimizer is the copy. Scales double from k = 8 on; periods up to 4 are found by direct scans at each lag. Words of a whole
batch are scanned as one sequence in which a separator of its own ends every text, so nothing crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import sliced, texts

#: Longest period found by direct lag scans; the scales go on from here.
LAGS = 4
LEAST = 6
#: Odd constants of the doubling hash (fixed values of a well-known mixing function).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
RUN = "array<struct<start: long, length: long, period: long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of twice as many words, from those of `width` words; the tail that does not fit keeps one half."""
    out = hashes * MIX[0]
    out[:-width] += hashes[width:]
    return _mixed(out)


def _sliding(values: np.ndarray, width: int, low: bool) -> np.ndarray:
    """Minimum or maximum of values[i : i + width], for widths that are powers of two; shorter at the end."""
    out, step, pick = values.copy(), 1, np.minimum if low else np.maximum
    while step < width:
        out[:-step] = pick(out[:-step], out[step:])
        step *= 2
    return out


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the minimum of at least one window of `width` places; all of equal minima."""
    low = _sliding(hashes, width, True)
    # windows that cover place j begin at j - width + 1 .. j
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low])
    return np.flatnonzero(_sliding(padded, width, False)[: len(hashes)] == hashes)


def lag_runs(words: np.ndarray, lag: int) -> list[tuple[int, int, int]]:
    """(start, end, lag) of the maximal stretches of at least max(6, 4 lag) words that equal the words `lag` before."""
    if len(words) <= lag:
        return []
    equal = np.concatenate([[False], words[lag:] == words[:-lag], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    first, last = edges[::2], edges[1::2] + lag
    long = last - first >= max(LEAST, 4 * lag)
    return [(s, e, lag) for s, e in zip(first[long].tolist(), last[long].tolist(), strict=True)]


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from `at` on, in direction `step`, equal those `lag` after them."""
    seen, width = 0, 32
    while True:
        if step > 0:
            low = at + seen
            high = min(low + width, len(words) - lag)
        else:
            high = at + 1 - seen
            low = max(high - width, 0)
        if high <= low:
            return seen
        differ = np.flatnonzero(words[low:high] != words[low + lag : high + lag])
        if len(differ):
            return seen + int(differ[0] if step > 0 else high - low - 1 - differ[-1])
        seen += high - low
        width *= 4


def seeds(words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of consecutive equal minimizers, scale by scale, in texts of `lengths` words and a separator each."""
    hashes, width, places = _mixed(words.view(np.uint64) * MIX[0]), 1, np.arange(len(words))
    of = np.repeat(np.arange(len(lengths)), lengths + 1)
    while True:
        hashes = _joined(hashes, width)
        width *= 2
        if width <= LAGS:
            continue
        # the shortest run of this scale has 4 (width / 2 + 1) words; shorter texts leave the sequence
        stay = lengths[of] >= 2 * width + 4
        if not stay.all():
            hashes, places, of = hashes[stay], places[stay], of[stay]
        if not len(hashes):
            return
        chosen = minimizers(hashes, width // 2)
        order = chosen[np.argsort(hashes[chosen], kind="stable")]
        one, two = order[:-1], order[1:]
        lag = two - one
        good = (hashes[one] == hashes[two]) & (lag > width // 2) & (lag <= width) & (of[one] == of[two])
        yield places[one[good]], lag[good]


def runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in the joined texts, sorted."""
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, lag: int) -> None:
        # a stretch has several periods only if all are multiples of the smallest
        found[start, end] = min(lag, found.get((start, end), lag))

    for lag in range(1, LAGS + 1):
        for run in lag_runs(words, lag):
            add(*run)
    for place, lag in seeds(words, lengths):
        order = np.lexsort((place, lag))
        past, last = -1, -1
        for at, q in zip(place[order].tolist(), lag[order].tolist(), strict=True):
            if q == last and at < past:
                continue
            start = at - _reach(words, at - 1, q, -1) if at else at
            stop = at + _reach(words, at, q, 1)
            past, last = stop, q
            if stop - start + q >= max(LEAST, 4 * q):
                add(start, stop + q, q)
    return sorted((s, e, q) for (s, e), q in found.items())


def _scanned(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4_000_000):
            split = [t.encode().split() for t in texts(batch)]
            numbers: dict[bytes, int] = {}
            lengths = np.array([len(s) for s in split], np.int64)
            ends = np.cumsum(lengths + 1) - 1
            joined = np.empty(int(ends[-1]) + 1, np.int64)
            for i, s in enumerate(split):
                joined[ends[i] - len(s) : ends[i]] = [numbers.setdefault(w, len(numbers)) for w in s]
                joined[ends[i]] = -1 - i
            found = np.array(runs(joined, lengths), np.int64).reshape(-1, 3)
            of = np.searchsorted(ends, found[:, 0])
            change = np.zeros(len(joined) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            hit = set(of.tolist())
            collapsed = [
                b" ".join(w for w, k in zip(s, kept[ends[i] - len(s) : ends[i]].tolist(), strict=True) if k) if i in hit else b" ".join(s)
                for i, s in enumerate(split)
            ]
            start = found[:, 0] - (ends - lengths)[of]
            values = pa.StructArray.from_arrays(
                [pa.array(start), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"]
            )
            offsets = pa.array(np.searchsorted(of, np.arange(len(split) + 1)).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(lengths), listed, pa.array(collapsed, pa.binary()).cast(pa.string())],
                [key, "n_words", "runs", "collapsed"],
            )

    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs as (start, length, period) by start, then period, and its
    words, joined by one space, without those that a run holds after its first period.

    Words are separated by ASCII white space and compared byte by byte. NULL and empty texts have no words, no runs
    and an empty `collapsed`. Repeated rows and repeated or NULL keys stay rows of their own; other columns are ignored. A
    text of any length is scanned whole; memory and time grow with it times the number of its scales.
    """
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    schema = StructType([rows.schema[key], *StructType.fromDDL(f"n_words long, runs {RUN}, collapsed string").fields])
    return rows.mapInArrow(_scanned(key), schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from the rows of `find`: the
    longest run (ties: smallest start, then period; without runs four NULLs) and digests of all runs and of `collapsed`.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("l"), (-r.start).alias("s"), (-r.period).alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), (r.period.cast("string"))))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), lines.alias("_lines"), "collapsed")
    return rows.select(
        key,
        "n_runs",
        (-F.col("_best.s")).alias("start"),
        F.col("_best.l").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("(1000 * _best.l) div (-_best.p)").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a tail made periodic in the rows that the key's crc32 picks, about a tenth of them.

    With h the unsigned crc32 of the decimal key and g = floor(h / 10), rows with h % 10 = 0 and n > 0 words get, for
    each word i >= a = g % n, the original word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); their words are
    then joined by one space. Rows with a NULL key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key), F.col(text).alias("text"), h.alias("h"))
    some = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, some)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    moved = F.expr("array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS INT)])), ' ')")
    return rows.select(key, F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def oracle_sql() -> str:
    """The digests of the planted documents in DuckDB: every lag up to a quarter of a text, stretches by equal words."""
    return """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+') AS w,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(doc_id::VARCHAR)), lambda x: ascii((doc_id::VARCHAR)[x + 1])::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda x: 0::BIGINT)),
                lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS c FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM docs),
parts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM hashed),
texts AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM parts),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
found AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    arg_max({'s': s, 'l': l, 'q': q}, {'l': l, 's': -s, 'q': -q}) AS best FROM found GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM found),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
