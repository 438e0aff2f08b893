"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are positives; everything else is unlabelled, toxic texts
among it.  With class prior ``p`` the risk of a classifier is ``p R+(positives)`` plus
the negative risk ``R-(unlabelled) - p R-(positives)``, which can't be below zero: where a
step drives it there, the step is turned round (the non-negative estimator).  A linear
model over hashed words is trained with it in numpy, with the sigmoid loss: it is bounded,
so a prior that is somewhat off does not cap the scores of plainly toxic texts.

A text is the set of its words and of the words' beginnings of ``PREFIXES`` bytes, hashed
into ``BINS`` bins (words are runs of letters, digits and non-ASCII bytes, ASCII lower
case).  The model uses bins that occur in ``MIN_TEXTS`` positives, more often than among the
unlabelled by ``MIN_Z`` standard errors, and whose texts the class prior makes toxic more
often than not (``prior * share of positives / share of unlabelled``, the estimate that
needs no negatives): other words are too rare or too common to learn from.  The fit takes at most about ``POSITIVES`` distinct
toxic and ``UNLABELLED`` distinct other texts, chosen by the hash of the text, and all
bins of each: as numbers or, where that is shorter, as one bit per bin (at most 32 KB).
The prior is the toxic share of the labelled rows that may be learned from.

Defined cases: null and empty texts score by the bias alone; rows labelled both ways
count as toxic; null labels are unlabelled; without a toxic example every score is 0.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import BLOCK_BYTES, blocks, crc_remainder, distinct_text_sample, packed, received, shared, unpacked, utf8

BITS = 18
BINS = 1 << BITS
POSITIVES, UNLABELLED = 4_000, 12_000
PREFIXES = (4, 5, 6)
MIN_Z, MIN_TEXTS = 6.0, 5
STEPS, BATCH, RATE = 2_000, 1_024, 0.05
RIDGE = 1e-5
THRESHOLD = 0.7
HELD_OUT = (3, 1)  # crc32 remainder of rows that are not learned from

_FOLD = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 if b < 128 else b for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def word_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bin of every word and word beginning between the offsets.

    A word's hash is a difference of prefix sums of ``byte * base ** position``, taken
    back to position 0, so all words of all texts are hashed at once.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    codes = np.concatenate([_FOLD[data[begin:end]], [np.uint64(0)]])
    letter = codes != 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = (offsets[1:-1] - begin)  # a text's first byte begins a word even if the text before ended in one
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stops = np.minimum(np.append(starts[1:], len(codes) - 1), np.flatnonzero(~letter)[np.searchsorted(np.flatnonzero(~letter), starts)])
    power, back = _powers(len(codes), _BASE), _powers(len(codes), pow(_BASE, -1, 1 << 64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:len(codes)], dtype=np.uint64)])
    rows = np.searchsorted(offsets, starts + begin, side="right") - 1
    all_rows, values = [rows], [(sums[stops] - sums[starts]) * back[starts]]
    for size in PREFIXES:
        long = stops - starts > size
        all_rows.append(rows[long])
        values.append((sums[starts[long] + size] - sums[starts[long]]) * back[starts[long]] + np.uint64(size))
    value = np.concatenate(values)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(all_rows), (value >> np.uint64(64 - BITS)).astype(np.int64)


def distinct_bins(data: np.ndarray, offsets: np.ndarray):
    """``(rows, bins)`` without repeats, for blocks of texts: first row, then the pairs."""
    for a, b in blocks(offsets, 4096):
        pairs = []
        if b - a == 1:  # a very long text goes through in pieces that end where a word ends
            start, stop = int(offsets[a]), int(offsets[b])
            while start < stop:
                cut = min(start + 4 * BLOCK_BYTES, stop)
                while cut < stop and _FOLD[data[cut]]:
                    cut += 1
                pairs.append(np.unique(word_bins(data, np.array([start, cut]))[1]))
                start = cut
            yield a, b, np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        else:
            rows, bins = word_bins(data, offsets[a:b + 1])
            yield a, b, np.unique(rows * BINS + bins)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for a, b, pairs in distinct_bins(data, offsets):
            out[a:b] += np.bincount(pairs >> BITS, self.weights[pairs & (BINS - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def telling(positives: Collection[np.ndarray], unlabelled: Collection[np.ndarray], prior: float) -> np.ndarray:
    """Which bins the model uses."""
    n_p, n_u = len(positives), len(unlabelled)
    p, u = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for total, rows in ((p, positives), (u, unlabelled)):
        for row in rows:  # of distinct bins
            total[row] += 1
    both, p_share, u_share = (p + u) / (n_p + n_u), p / n_p, u / n_u
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    return (p >= MIN_TEXTS) & (p_share - u_share >= MIN_Z * error) & (2 * prior * p_share >= u_share)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Sparse binary rows; products with the weights and gradients by bin."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bins = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def pick(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[chosen]
        row = np.repeat(np.arange(len(chosen)), sizes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return row, self.bins[np.repeat(self.starts[chosen], sizes) + within]


def train(positives: Collection[np.ndarray], unlabelled: Collection[np.ndarray], prior: float, seed: int = 7) -> Model:
    """Minimises the non-negative risk with the sigmoid loss by Adam steps on mini-batches."""
    rng = np.random.default_rng(seed)
    used = telling(positives, unlabelled, prior)
    column = np.cumsum(used) - 1
    positives, unlabelled = ([column[row[used[row]]] for row in rows] for rows in (positives, unlabelled))
    p_rows, u_rows = _Rows(positives), _Rows(unlabelled)
    size = int(used.sum())
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(size + 1), np.zeros(size + 1)]
    p_batch = max(1, min(len(positives), BATCH // 4))
    for step in range(1, STEPS + 1):
        p_at = rng.integers(0, len(positives), p_batch)
        u_at = rng.integers(0, len(unlabelled), min(len(unlabelled), BATCH))
        (p_row, p_bin), (u_row, u_bin) = p_rows.pick(p_at), u_rows.pick(u_at)
        p_out = _sigmoid(bias + np.bincount(p_row, weights[p_bin], len(p_at)))
        u_out = _sigmoid(bias + np.bincount(u_row, weights[u_bin], len(u_at)))
        negative = u_out.mean() - prior * p_out.mean()
        p_slope, u_slope = prior * p_out * (1 - p_out) / len(p_at), u_out * (1 - u_out) / len(u_at)
        # the positive risk 1 - out counts unless the negative risk must be turned round first
        p_grad, u_grad = (-2 * p_slope, u_slope) if negative >= 0 else (p_slope, -u_slope)
        grad = np.bincount(p_bin, p_grad[p_row], size) + np.bincount(u_bin, u_grad[u_row], size) + RIDGE * weights
        grad = np.append(grad, p_grad.sum() + u_grad.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad * grad
        rate = RATE * (1 - step / (STEPS + 1))
        move = rate * (moments[0] / (1 - 0.9 ** step)) / (np.sqrt(moments[1] / (1 - 0.999 ** step)) + 1e-8)
        weights -= move[:-1]
        bias -= float(move[-1])
    whole = np.zeros(BINS)
    whole[used] = weights
    return Model(whole, bias)


def encoded(bins: np.ndarray) -> bytes:
    """Distinct bins, in at most ``BINS / 8`` bytes."""
    if len(bins) * 4 < BINS // 8:
        return bins.astype(np.int32).tobytes()
    held = np.zeros(BINS, bool)
    held[bins] = True
    return np.packbits(held).tobytes()


class Encoded:
    """Rows of bins, decoded one at a time."""

    def __init__(self, rows: list[bytes]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        for row in self.rows:
            yield np.frombuffer(row, np.int32) if len(row) < BINS // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(row, np.uint8)))


def _bins_of(df: DataFrame) -> Encoded:
    """Bins of the distinct sampled texts, in the order of their keys."""
    def features(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for a, b, pairs in distinct_bins(data, offsets):
                parts = np.split(pairs & (BINS - 1), np.searchsorted(pairs >> BITS, np.arange(1, b - a)))
                rows += map(encoded, parts)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(rows, pa.binary())], ["text_key", "bins"])

    found = df.select("text_key", "text").mapInArrow(features, "text_key long, bins binary")
    rows = found.groupBy("text_key").agg(F.first("bins").alias("bins")).toArrow()
    pairs = sorted(zip(rows.column("text_key").to_pylist(), rows.column("bins").to_pylist()))
    return Encoded([b for _, b in pairs])


def held_out(doc_id):
    return F.coalesce(crc_remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learns from ``doc_id, text`` and ``doc_id, toxic``; None without a toxic example."""
    free = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = labels.filter(free & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = marks.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("toxic"), F.count("*").alias("n")).first()
    if not counts["toxic"]:
        return None
    share = min(1.0, positives / counts["toxic"])
    chosen = marks.filter((F.col("toxic") == 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))).select("doc_id")
    texts = docs.filter(free & F.col("text").isNotNull()).select("doc_id", "text", F.lit(0).alias("all"))
    # the chosen ids are at most about `positives`, so they are broadcast
    toxic = _bins_of(texts.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("text_key", F.xxhash64("text")))
    others = _bins_of(distinct_text_sample(texts, "all", unlabelled))
    if not toxic or not others:
        return None
    prior = min(0.9, max(1e-3, counts["toxic"] / counts["n"]))
    return train(toxic, others, prior)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``predicted``."""
    if model is None:
        rows = packed(docs, score=F.lit(0.0))
    else:
        sent, source = shared(docs.sparkSession, model), packed(docs, text=F.col("text"))
        out = source.select("doc", F.lit(0.0).alias("score")).schema
        schema = to_arrow_schema(out)

        def scored(batches):
            model = received(sent)
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(model.scores(data, offsets))], schema=schema)

        rows = source.mapInArrow(scored, out)
    rows = rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(rows, docs.columns, "score", "predicted")
