"""Quality by attention-based multiple-instance learning: a text is a bag of passages with one label.

A text is cut at blanks into passages of equal length, of ``PASSAGE`` bytes at least and
``PASSAGES`` in number at most, so that every byte of it counts and a bag stays small.  A
passage is encoded by the shares of pairs of neighbouring byte classes, its word lengths,
and how much of it was there before: words within the passage, runs of three words within the
text.  A learned layer turns that into ``HIDDEN`` numbers ``h``; the gated attention
``w . (tanh(V h) * sigmoid(U h))`` becomes, by a softmax over the bag, the weight of each passage;
the weighted sum of the passages' ``h`` is scored.  Labels belong to texts only: which
passages matter is learned from them.  All parts are trained together in numpy, by
Adam steps on bags.

The fit takes at most about ``PER_CLASS`` distinct texts of each label, chosen by the hash of the
text; a bag is at most ``PASSAGES * FEATURES`` half-precision numbers (27 KB).  Losses are weighted back to
the labels' shares among the learnable texts, so a score is the chance of label 1.

Defined cases: null and empty texts are one passage of nothing; a text labelled both ways is not
learned from; null labels and ids are no labels; copies of a text are learned from once; without both labels
every score is the share of label 1 (0 without any label); repetition is judged within pieces of ``PIECE`` bytes of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import blocks, crc_remainder, packed, received, shared, unpacked, utf8

PASSAGE, PASSAGES = 512, 64
PIECE = 4 << 20
PER_CLASS = 2500
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, RIDGE = 40, 64, 0.004, 1e-3
THRESHOLD = 0.3
HELD_OUT = (5, 0)  # crc32 remainder of rows that are not learned from

_CLASSES = ("\t\v\f\r ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!?", "|", "#$%&*+/<=>@\\^_`~", "'\"()[]{}:;-")
_KINDS = len(_CLASSES) + 2  # bytes beyond ASCII, and control characters
_CLASS = np.array([len(_CLASSES) if b >= 128 else next((k for k, c in enumerate(_CLASSES) if chr(b) in c), len(_CLASSES) + 1) for b in range(256)], np.uint8)
_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
_LENGTHS = np.array([1, 2, 3, 5, 8, 12, 20])  # word lengths in bytes up to which a word counts in a bin
FEATURES = _KINDS * _KINDS + len(_LENGTHS) + 1 + 2
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


def _again(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values occurred before with the same owner."""
    seen = np.ones(len(value), bool)
    seen[np.unique(value ^ _mixed(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = False
    return seen


def passage_starts(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Where the passages of the text at ``start .. stop`` begin; one at least."""
    n = min(max(1, -(-(stop - start) // PASSAGE)), PASSAGES)
    if n == 1:
        return np.array([start], np.int64)
    wanted = start + (np.arange(1, n) * (stop - start)) // n
    gaps = start + np.flatnonzero(_GAP[data[start:stop]])
    at = np.searchsorted(gaps, wanted)
    return np.unique(np.concatenate([[start], gaps[at[at < len(gaps)]]]))


def _count(totals: np.ndarray, data: np.ndarray, passage: np.ndarray, text: np.ndarray) -> None:
    """Adds the bytes ``data`` to their passages' totals; ``passage`` and ``text`` are per byte."""
    n = len(totals)
    kind = _CLASS[data].astype(np.int64)
    same = passage[1:] == passage[:-1]
    pair = (passage[:-1] * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:])[same]
    totals[:, :_KINDS * _KINDS] += np.bincount(pair, minlength=n * _KINDS * _KINDS).reshape(n, -1)
    gap = _GAP[data]
    first = ~gap
    first[1:] &= gap[:-1] | (text[1:] != text[:-1])
    last = ~gap
    last[:-1] &= gap[1:] | (text[1:] != text[:-1])
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return
    owner, of = passage[starts], text[starts]
    width = np.searchsorted(_LENGTHS, stops - starts)
    at = _KINDS * _KINDS
    totals[:, at:at + len(_LENGTHS) + 1] += np.bincount(owner * (len(_LENGTHS) + 1) + width, minlength=n * (len(_LENGTHS) + 1)).reshape(n, -1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data), _BASE)[:-1], dtype=np.uint64)])
    word = _mixed((sums[stops] - sums[starts]) * _powers(len(data), pow(_BASE, -1, 1 << 64))[starts])
    totals[:, -2] += np.bincount(owner, _again(owner, word), n)
    if len(word) > 2:
        whole = of[2:] == of[:-2]
        run = _mixed(_mixed(word[:-2] * np.uint64(3) + word[1:-1]) * np.uint64(5) + word[2:])[whole]
        totals[:, -1] += np.bincount(owner[2:][whole], _again(of[2:][whole], run), n)


def bags(data: np.ndarray, offsets: np.ndarray):
    """Blocks of texts as ``first text, last text, features, text of each passage``."""
    for a, b in blocks(offsets, 4096):
        starts = [passage_starts(data, start, stop) for start, stop in zip(offsets[a:b].tolist(), offsets[a + 1:b + 1].tolist())]
        texts = np.repeat(np.arange(b - a), [len(s) for s in starts])
        starts = np.concatenate(starts)
        totals = np.zeros((len(starts), FEATURES))
        begin, end = int(offsets[a]), int(offsets[b])
        while begin < end:
            stop = min(begin + PIECE, end)
            while stop < end and not _GAP[data[stop]]:
                stop += 1
            here = np.arange(begin, stop)
            passage = np.searchsorted(starts, here, side="right") - 1
            _count(totals, data[begin:stop], passage, texts[passage])
            begin = stop
        at = _KINDS * _KINDS
        words = np.maximum(totals[:, at:-2].sum(1, keepdims=True), 1)
        totals[:, :at] /= np.maximum(totals[:, :at].sum(1, keepdims=True), 1)
        totals[:, at:] /= words
        yield a, b, np.sqrt(totals).astype(np.float32), texts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and scorer; ``parts`` are its arrays by name."""

    def __init__(self, parts: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.parts, self.mean, self.scale = parts, mean, scale

    def standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -4, 4)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``x`` are the passages of bags that begin at ``starts``, none of them empty."""
        p = self.parts
        h = np.tanh(x @ p["encode"] + p["encode_bias"])
        shown, gate = np.tanh(h @ p["show"]), _sigmoid(h @ p["gate"])
        raw = (shown * gate) @ p["attend"]
        sizes = np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        weight = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        whole = np.add.reduceat(weight[:, None] * h, starts)
        return {"h": h, "shown": shown, "gate": gate, "bag": bag, "weight": weight, "whole": whole, "out": whole @ p["score"] + p["bias"][0]}

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of the bags and its slopes."""
        p, f = self.parts, self.forward(x, starts)
        total = weights.sum()
        loss = float((weights * (np.logaddexp(0, f["out"]) - labels * f["out"])).sum() / total)
        d_out = weights * (1 / (1 + np.exp(-f["out"])) - labels) / total
        d_whole = d_out[:, None] * p["score"]
        spread = d_whole[f["bag"]]
        d_weight = (spread * f["h"]).sum(1)
        mean = np.add.reduceat(f["weight"] * d_weight, starts)
        d_raw = f["weight"] * (d_weight - mean[f["bag"]])
        d_mix = d_raw[:, None] * p["attend"]
        d_shown = d_mix * f["gate"] * (1 - f["shown"] ** 2)
        d_gate = d_mix * f["shown"] * f["gate"] * (1 - f["gate"])
        d_h = f["weight"][:, None] * spread + d_shown @ p["show"].T + d_gate @ p["gate"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return loss, {"encode": x.T @ d_in, "encode_bias": d_in.sum(0), "show": f["h"].T @ d_shown, "gate": f["h"].T @ d_gate,
                      "attend": (f["shown"] * f["gate"]).T @ d_raw, "score": f["whole"].T @ d_out, "bias": np.array([d_out.sum()])}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for a, b, features, texts in bags(data, offsets):
            starts = np.searchsorted(texts, np.arange(b - a))
            out[a:b] = _sigmoid(self.forward(self.standard(features), starts)["out"])
        return out


class Constant:
    """Without both labels: the share of label 1."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.share)


def train(features: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 11) -> Model:
    """Fits bags to their labels; ``share`` is the share of label 1 that scores are to reflect."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(features).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 0.01
    start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    parts = {"encode": start(FEATURES, HIDDEN), "encode_bias": np.zeros(HIDDEN), "show": start(HIDDEN, GATE), "gate": start(HIDDEN, GATE),
             "attend": start(GATE), "score": start(HIDDEN), "bias": np.array([np.log(share / (1 - share))])}
    model = Model(parts, mean, scale)
    xs = [model.standard(f.astype(np.float64)) for f in features]
    ones = labels.mean()
    weights = np.where(labels == 1, share / ones, (1 - share) / (1 - ones))
    first, second = ({k: np.zeros_like(v) for k, v in parts.items()} for _ in range(2))
    step, steps = 0, EPOCHS * -(-len(xs) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), BATCH):
            chosen, step = order[at:at + BATCH], step + 1
            starts = np.concatenate([[0], np.cumsum([len(xs[i]) for i in chosen])[:-1]])
            _, slopes = model.gradients(np.concatenate([xs[i] for i in chosen]), starts, labels[chosen], weights[chosen])
            rate = RATE * (1 - step / (steps + 1))
            for name, value in parts.items():
                slope = slopes[name] + (RIDGE * value if "bias" not in name else 0)
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope * slope
                value -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_remainder(doc_id, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def _bags_of(df: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Bags and labels of the sampled texts, in the order of their keys."""
    def encode(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for a, b, features, texts in bags(data, offsets):
                cuts = np.searchsorted(texts, np.arange(1, b - a))
                rows += [part.astype(np.float16).tobytes() for part in np.split(features, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("label"), pa.array(rows, pa.binary())], ["text_key", "label", "bag"])

    found = df.select("text_key", "label", "text").mapInArrow(encode, "text_key long, label int, bag binary")
    rows = sorted(found.groupBy("text_key", "label").agg(F.first("bag").alias("bag")).toArrow().to_pylist(), key=lambda r: r["text_key"])
    return [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in rows], np.array([r["label"] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | Constant:
    """Learns from ``doc_id, text`` and ``doc_id, quality``, rows that are held out apart."""
    free = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = labels.filter(free & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    keyed = docs.filter(free).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    # one narrow row per distinct text, whatever the number of its copies; texts with both labels go
    known = (keyed.select("doc_id", "text_key").join(marks, "doc_id").groupBy("text_key")
             .agg(F.min("label").alias("label"), F.max("label").alias("other"), F.min("doc_id").alias("doc_id"))
             .filter(F.col("label") == F.col("other")).select("text_key", "label", "doc_id"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two numbers
    total = sum(counts.values())
    if len(counts) < 2:
        return Constant(counts.get(1, 0) / total if total else 0.0)
    draw = F.shiftrightunsigned(F.xxhash64("text_key", F.lit("sample")), 11).cast("double") / float(1 << 53)
    chosen = known.filter(draw < F.when(F.col("label") == 1, per_class / counts[1]).otherwise(per_class / counts[0]))
    # the chosen texts are at most about 2 * per_class, so their keys are broadcast and no text is shuffled
    sample, labelled = _bags_of(keyed.join(F.broadcast(chosen), ["doc_id", "text_key"]))
    if len(set(labelled.tolist())) < 2:
        return Constant(counts[1] / total)
    return train(sample, labelled, counts[1] / total)


def score(docs: DataFrame, model: Model | Constant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``score`` and ``predicted``."""
    sent, source = shared(docs.sparkSession, model), packed(docs, text=F.col("text"))
    out = source.select("doc", F.lit(0.0).alias("score")).schema
    schema = to_arrow_schema(out)

    def scored(batches):
        model = received(sent)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(model.scores(data, offsets), pa.float64())], schema=schema)

    rows = source.mapInArrow(scored, out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return unpacked(rows, docs.columns, "score", "predicted")
