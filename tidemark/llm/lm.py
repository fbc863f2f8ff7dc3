"""Language-model scores by a weighted backoff automaton.

States are contexts seen in training, the empty one included; an arc reads a token, and a failure arc drops the oldest
token of the context. With Dirichlet smoothing the arc from context h over w weighs
(c(hw) + mu P(w | shorter h)) / (c(h) + mu) and the failure arc mu / (c(h) + mu), so weights follow from counts alone.
A text is scored in one pass from left to right that carries the state.

The automaton of a large corpus fits nowhere whole. Texts are packed into blocks; each block counts its own n-grams, the
owners of hash ranges add up the counts of all blocks, and every block gets back exactly the arcs its texts can take.
All that meets in one task are the distinct n-grams of a block or of a hash range.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import staged
from .common import fold, sliced, words

#: The end of a text, which also stands before its first word; no word contains white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Amounts of smoothing to choose from, by the leave-one-out likelihood of all training tokens.
MUS = (4.0, 16.0, 64.0, 256.0, 1_024.0, 4_096.0, 16_384.0, 65_536.0)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a context hash and a token hash."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (a >> np.uint64(29)))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


# ---------------------------------------------------------------- blocks


def blocks(docs: DataFrame, key: str, text: str, held_out, tokens: int) -> DataFrame:
    """Texts packed into blocks of about `tokens` tokens: numbers of the words, and the hash of every number.

    Number 0 is the end of a text.
    """
    rows = docs.select(F.col(key).alias("row_key"), held_out.alias("held_out"), F.col(text).alias("text"))
    keys = StructField("row_keys", ArrayType(rows.schema["row_key"].dataType))
    schema = StructType([*StructType.fromDDL("block long").fields, keys, *StructType.fromDDL(
        "held_out array<boolean>, sizes array<int>, train_tokens long, n_tokens long, ids binary, hashes binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = random.SystemRandom()
        numbers, held, parts, total = _Numbers(), [], [], 0
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate(parts)
            hashes = np.array([END, *(xxhash.xxh64_intdigest(w) for w in numbers if w != b"\n")], dtype=np.uint64)
            # frequent words get small numbers, which pack better
            often = np.concatenate([[0], 1 + np.argsort(-np.bincount(ids, minlength=len(hashes))[1:], kind="stable")])
            rank = np.empty(len(often), dtype=np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            planes = rank[ids].astype("<u4").view(np.uint8).reshape(-1, 4).T
            sizes = [len(p) for p in parts]
            values = [
                rng.getrandbits(62), [k for k, _ in held], [h for _, h in held], sizes,
                sum(s for s, (_, h) in zip(sizes, held, strict=True) if not h), total,
                zstandard.ZstdCompressor(level=3).compress(planes.tobytes()), hashes[often].tobytes(),
            ]
            kinds = [pa.int64(), kind, pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], schema.names)
            numbers.clear()
            held.clear()
            parts.clear()
            total = 0
            return out

        for batch in sliced(batches, "text", 4_000_000):
            kind = pa.list_(batch.schema.field("row_key").type)
            for k, h, t in zip(*(batch.column(c).to_pylist() for c in ("row_key", "held_out", "text")), strict=True):
                if not numbers:
                    numbers[b"\n"] = 0
                some = words(t)
                some.append(b"\n")
                parts.append(np.fromiter(map(numbers.__getitem__, some), dtype=np.int32, count=len(some)))
                held.append((k, h))
                total += len(some)
                if total >= tokens:
                    yield flush()
        if parts:
            yield flush()

    return rows.mapInArrow(run, schema)


class Block:
    """A block unpacked: its tokens, and the distinct n-grams of every order with the place of each token's n-gram."""

    def __init__(self, ids: bytes, hashes: bytes, sizes: list[int], held_out: list[bool], order: int):
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), dtype=np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.training = np.repeat(~np.array(held_out, dtype=bool), self.sizes)
        words_ = np.frombuffer(hashes, dtype=np.uint64)
        first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        n = len(self.tokens)
        depth = np.arange(n) - np.repeat(first, self.sizes)
        self.before = np.concatenate([[0], self.tokens[:-1]])
        self.before[first] = 0
        #: per order: sorted hashes, place of each token's n-gram among them, and which tokens have one
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_hash = np.argsort(words_)
        rank = np.empty(len(by_hash), dtype=np.int64)
        rank[by_hash] = np.arange(len(by_hash))
        self.grams.append((words_[by_hash], rank[self.tokens], np.ones(n, dtype=bool)))
        context, context_hash = rank[self.before], words_[by_hash]
        for k in range(2, order + 1):
            has = depth >= k - 2
            place = np.zeros(n, dtype=np.int64)
            keys = context[has] * len(words_) + rank[self.tokens[has]]
            distinct, inverse = np.unique(keys, return_inverse=True)
            found = mix(context_hash[distinct // len(words_)], self.grams[0][0][distinct % len(words_)])
            by = np.argsort(found)
            at = np.empty(len(by), dtype=np.int64)
            at[by] = np.arange(len(by))
            place[has] = at[inverse]
            self.grams.append((found[by], place, has))
            context = np.concatenate([[0], place[:-1]])
            context_hash = found[by]

    def counts(self, k: int) -> np.ndarray:
        """How often each n-gram of order k occurs in the training texts of the block."""
        hashes, place, has = self.grams[k - 1]
        return np.bincount(place[has & self.training], minlength=len(hashes))


# ---------------------------------------------------------------- owners of hash ranges


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _small(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as the largest needs."""
    most = int(values.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return size, values.astype(f"<u{size}").tobytes()


def _numbers(size: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{size}").astype(np.int64)


def _key_bytes(order: int) -> int:
    """Words keep 64 bits of their hash; longer n-grams 48, of which a range fixes some more."""
    return 8 if order == 1 else 6


def _pack(hashes: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    some = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    out = np.zeros((len(some), 8), dtype=np.uint8)
    out[:, :size] = some
    return out.view(">u8").ravel().astype(np.uint64)


def _requests(packed: DataFrame, order: int, ranges: int) -> DataFrame:
    """(owner, level, block, keys, size, counts): the n-grams of a block that fall into a hash range."""
    names = ["owner", "level", "block", "keys", "size", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row["ids"], row["hashes"], row["sizes"], row["held_out"], order)
                for k in range(1, order + 1):
                    hashes, counts = block.grams[k - 1][0], block.counts(k)
                    cuts = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
                    rows = []
                    for owner in range(ranges):
                        a, b = int(cuts[owner]), int(cuts[owner + 1])
                        if a < b:
                            rows.append((owner, k, row["block"], _pack(hashes[a:b], _key_bytes(k)), *_small(counts[a:b])))
                        if len(rows) == 64 or (rows and owner == ranges - 1):
                            columns = zip(*rows, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
                            rows = []

    return packed.mapInArrow(run, "owner int, level int, block long, keys binary, size int, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(block, level, owner, size, totals, types): for every request the counts over all blocks, in its order.

    `types` has the number of n-grams that occur in training, on one row of each range and level.
    """
    names = ["block", "level", "owner", "size", "totals", "types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            keys = [_unpack(r["keys"], _key_bytes(r["level"])) for r in rows]
            counts = np.concatenate([_numbers(r["size"], r["counts"]) for r in rows])
            distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, counts, minlength=len(distinct)).astype(np.int64)
            types, at = int((totals > 0).sum()), 0
            for r, some in zip(rows, keys, strict=True):
                size, raw = _small(totals[inverse[at : at + len(some)]])
                values = [r["block"], r["level"], r["owner"], size, raw, types if at == 0 else 0]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)
                at += len(some)

        held: list[dict] = []
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if held and (row["owner"], row["level"]) != (held[0]["owner"], held[0]["level"]):
                    yield from answer(held)
                    held = []
                held.append(row)
        if held:
            yield from answer(held)

    ordered = requests.repartition("owner", "level").sortWithinPartitions("owner", "level")
    return ordered.mapInArrow(run, "block long, level int, owner int, size int, totals binary, types long")


# ---------------------------------------------------------------- the traversal


def traverse(block: Block, totals: list[np.ndarray], n: int, v: int, mus: tuple[float, ...]) -> dict[str, np.ndarray]:
    """Per text: known tokens, base log10 probability, and per mu the log10 probability and that of the training tokens
    without their own occurrence.

    The pass over the tokens carries the state as the count of each token's context in the next lower order. Where an
    arc is missing its count is zero, and what is left of its weight is the failure arc times the arc of the shorter
    context. Only sums per text are kept, so memory does not grow with the number of mus.
    """
    starts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]]).astype(np.int64)
    unigram = totals[0][block.grams[0][1]].astype(np.float64)
    base = (unigram + 1) / (n + v + 1)
    out = {"known": np.add.reduceat((unigram > 0).astype(np.int64), starts), "base": np.add.reduceat(np.log10(base), starts)}
    training = block.training
    begin = totals[0][np.searchsorted(block.grams[0][0], np.uint64(END))]
    scores, alone = [], []
    for mu in mus:
        p, q = base, np.maximum(unigram, 1e-300) / max(n + v, 1)
        context = np.concatenate([[begin], unigram[:-1]])
        context[block.before == 0] = begin
        for k in range(2, len(totals) + 1):
            _, place, has = block.grams[k - 1]
            count = totals[k - 1][place] * has
            context = context * has
            p = (count + mu * p) / (context + mu)
            taken = has & training
            q = (np.maximum(count - taken, 0) + mu * q) / (np.maximum(context - taken, 0) + mu)
            context = np.concatenate([[0.0], count[:-1]])
        scores.append(np.add.reduceat(np.log10(p), starts))
        alone.append(np.add.reduceat(np.where(training, np.log10(np.maximum(q, 1e-300)), 0.0), starts))
    return out | {"scores": np.array(scores), "alone": np.array(alone)}


def score(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    order: int = 2,
    mus: tuple[float, ...] = MUS,
    block_tokens: int = 1_500_000,
    range_grams: int = 1_000_000,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, mu), one row per input row.

    Trained on all rows whose fold is not `held_fold`. NULL and empty texts are one end token. The model's unigrams are
    those of the base, so every text has a finite score; `mu` is the amount of smoothing with the highest
    leave-one-out likelihood of the training tokens. Without any training token all tokens are unknown.
    """
    packed = staged(blocks(docs, key, text, fold(key, folds) == held_fold, block_tokens), "lm-blocks")
    size = packed.agg(F.sum("train_tokens").alias("train"), F.sum("n_tokens").alias("all")).first()
    n, ranges = size.train or 0, max(4, -(-(size["all"] or 0) // range_grams))
    answers = staged(_answers(_requests(packed, order, ranges)), "lm-answers")
    v = answers.filter("level = 1").agg(F.sum("types").alias("v")).first().v or 0
    listed = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("level", "owner", "size", "totals"))).alias("answers"))
    joined = packed.join(listed, "block").select("row_keys", "held_out", "sizes", "ids", "hashes", "answers")
    fields = "held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, alone array<double>"
    schema = StructType([StructField("row_key", packed.schema["row_keys"].dataType.elementType), *StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "row_keys"}
                block = Block(row["ids"], row["hashes"], row["sizes"], row["held_out"], order)
                totals = [
                    np.concatenate([_numbers(a["size"], a["totals"]) for a in row["answers"] if a["level"] == k])
                    for k in range(1, order + 1)
                ]
                found = traverse(block, totals, n, v, mus)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_keys").slice(i, 1).flatten(),
                        pa.array(row["held_out"], pa.bool_()),
                        pa.array(block.sizes, pa.int64()),
                        pa.array(found["known"], pa.int64()),
                        pa.array(found["base"], pa.float64()),
                        *(pa.array(found[c].T.tolist(), pa.list_(pa.float64())) for c in ("scores", "alone")),
                    ],
                    schema.names,
                )

    result = staged(joined.mapInArrow(run, schema), "lm-scores")
    sums = result.agg(*(F.sum(F.element_at("alone", g + 1)).alias(str(g)) for g in range(len(mus)))).first()
    best = max(range(len(mus)), key=lambda g: sums[g] or 0.0) if n else 0
    return result.select(
        F.col("row_key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        F.element_at("scores", best + 1).alias("score"),
        F.lit(mus[best]).alias("mu"),
    )
