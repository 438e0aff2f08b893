r"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (1 to 4 bytes, the blended
spectrum) that both hold, over the geometric mean of how many each holds.  Texts are
folded first: ASCII lower case, runs of everything that is no letter as one class.
N-grams are hashed into ``BINS`` bins, so a text is a row of presence bits.

A Nyström map over a few landmark texts per language makes features of kernels, and a
kernel ridge regression per language (one against the rest) is solved on them.  For
scoring, landmark weights and landmark bits are multiplied once into one matrix, so a
block of texts is scored by the product of its bit matrix and that matrix.

The fit takes at most ``PER_LANGUAGE`` distinct texts per language, chosen by the hash
of the text, ``MAX_ROWS`` in all; only their bits reach the driver.  Prediction reads
whole texts and nothing but texts.

The score tells languages from each other, not known from unknown ones: a text that shares
nothing with any landmark has margins near zero.  Whether the model knows a text's language
is told by its closeness: the overlap of its bits with the bins that ``CORE`` of the
language's texts hold, or with the union of these bins (a text may mix languages), less what chance gives, over the smaller of both sets.  It is near 1
for texts of the language, whether short or long, and near 0 for bits that fell at random.
Texts are taken in pieces of about ``PIECE`` bytes, all of them, so that a long text does
not hold every bin.  The bound of a language is half of the median closeness of the texts
it was learned from, each compared with the others only.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without
anything to learn from every text is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import BLOCK_BYTES, blocks, crc_remainder, distinct_text_sample, packed, received, shared, unpacked, utf8

GRAMS = 4
BINS = 1 << 15
PER_LANGUAGE = 384
MAX_ROWS = 6_144
LANDMARKS = 384
RIDGE = 1e-3
UNKNOWN = "und"
HELD_OUT = (4, 2)  # crc32 remainder of rows that are not learned from
ROWS_PER_BLOCK = 64
CORE = 0.1
PIECE = 4096

#: Byte classes: letters in lower case, all other ASCII as one blank; non-ASCII bytes stand for themselves.
_FOLD = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 if b < 128 else b for b in range(256)], np.uint32)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence bits of the texts between the offsets, one row of ``BINS`` each."""
    rows = len(offsets) - 1
    bits = np.zeros((rows, BINS), bool)
    flat = bits.reshape(-1)
    for start in range(int(offsets[0]), int(offsets[-1]), BLOCK_BYTES):
        stop = min(start + BLOCK_BYTES, int(offsets[-1]))
        reach = min(stop + GRAMS - 1, int(offsets[-1]))  # n-grams that begin in this piece
        codes = _FOLD[data[start:reach]]
        base = (np.searchsorted(offsets, np.arange(start, stop), side="right") - 1 if rows > 1 else np.zeros(stop - start, np.int64))
        ends = offsets[base + 1] - np.arange(start, stop)
        base = base * BINS
        gram = np.zeros(stop - start, np.uint32)
        for n in range(1, GRAMS + 1):
            here = codes[n - 1:n - 1 + stop - start]
            if len(here) < len(gram):
                gram, base, ends = gram[:len(here)], base[:len(here)], ends[:len(here)]
            gram = (gram << np.uint32(8)) | here
            bins = ((gram + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - 15)
            inside = ends >= n
            flat[(base + bins)[inside]] = True
    return bits


def piece_edges(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of pieces of about ``PIECE`` bytes that cover the texts, and each piece's text."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, (sizes + PIECE // 2) // PIECE)
    row = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.append(offsets[row] + sizes[row] * number // counts[row], offsets[-1]), row


def overlap(held: np.ndarray, core_size: np.ndarray, shared_bins: np.ndarray) -> np.ndarray:
    """Overlap coefficient of two sets of bins, less the overlap of sets of these sizes that fell at random."""
    chance = held * core_size / BINS
    most = np.minimum(held, core_size) - chance
    return np.where(most > 0, (shared_bins - chance) / np.where(most > 0, most, 1), 0.0)


class Model:
    """Languages and the folded weights: presence bits times ``weights`` over the root of the bits is the margin."""

    def __init__(self, languages: list[str], bits: np.ndarray, labels: np.ndarray, landmarks: np.ndarray):
        """``bits``: packed presence bits, one row per text; only a block of them is unpacked at a time."""
        self.languages = languages

        def unit(rows: np.ndarray) -> np.ndarray:
            dense = np.unpackbits(bits[rows], axis=1).astype(np.float32)
            dense /= np.sqrt(np.maximum(dense.sum(1), 1.0))[:, None]
            return dense

        marks = unit(landmarks)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm to the power -1/2
        kernels = [unit(rows) @ marks.T for rows in np.array_split(np.arange(len(bits)), -(-len(bits) // ROWS_PER_BLOCK))]
        features = np.concatenate(kernels).astype(np.float64) @ root
        wanted = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
        gram = features.T @ features + RIDGE * len(features) * np.eye(features.shape[1])
        self.weights = (marks.T @ (root @ np.linalg.solve(gram, features.T @ wanted))).astype(np.float32)
        # a core per language, and the union of them for texts in several languages
        each = [bits[labels == k] for k in range(len(languages))]
        pieces = [np.array_split(own, -(-len(own) // ROWS_PER_BLOCK)) for own in each]
        counts = [sum(np.unpackbits(rows, axis=1).sum(0, dtype=np.int64) for rows in own) for own in pieces]
        cores = np.stack([n >= max(1, CORE * len(own)) for n, own in zip(counts, each)], axis=1)
        self.cores = np.concatenate([cores, cores.any(1, keepdims=True)], axis=1).astype(np.float32)
        self.bounds, in_any = np.full(len(languages) + 1, -np.inf), []
        for k, own in enumerate(each):
            rest = np.delete(cores, k, axis=1).any(1)
            found = np.concatenate([self._among(np.unpackbits(rows, axis=1), counts[k], len(own) - 1, rest) for rows in pieces[k]], axis=1)
            in_any.append(found[1])
            if len(own) > 1:
                self.bounds[k] = np.median(found[0]) / 2
        self.bounds[-1] = np.median(np.concatenate(in_any)) / 2

    @staticmethod
    def _among(dense: np.ndarray, counts: np.ndarray, others: int, rest: np.ndarray) -> np.ndarray:
        """Closeness of learned texts to the core of the other ones, and to that together with the cores of the other languages."""
        own = counts - dense >= max(1, CORE * others)
        return np.stack([overlap(dense.sum(1, dtype=float), core.sum(1, dtype=float), (core & (dense > 0)).sum(1, dtype=float))
                         for core in (own, own | rest)])

    def margins(self, bits: np.ndarray) -> np.ndarray:
        dense = bits.astype(np.float32)
        return (dense @ self.weights) / np.sqrt(np.maximum(dense.sum(1), 1.0))[:, None]

    def closeness(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text to each language, and last to all together: the mean over its pieces, by their bytes."""
        edges, row = piece_edges(offsets)
        total, core_size = np.zeros((len(offsets) - 1, len(self.bounds))), self.cores.sum(0, dtype=float)
        for a in range(0, len(row), ROWS_PER_BLOCK):
            b = min(a + ROWS_PER_BLOCK, len(row))
            dense = presence(data, edges[a:b + 1]).astype(np.float32)
            found = overlap(dense.sum(1, dtype=float)[:, None], core_size, (dense @ self.cores).astype(float))
            np.add.at(total, row[a:b], found * np.diff(edges[a:b + 1])[:, None])
        return total / np.maximum(np.diff(offsets), 1)[:, None]


def fit(df: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learns from ``text, lang``; None when there is no row to learn from."""
    known = df.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    n_languages = known.agg(F.count_distinct("lang")).first()[0]
    if not n_languages:
        return None
    cap = max(1, min(per_language, MAX_ROWS // n_languages))

    def features(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            packed_bits = [row.tobytes() for a, b in blocks(offsets, ROWS_PER_BLOCK)
                           for row in np.packbits(presence(data, offsets[a:b + 1]), axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text_key"), pa.array(packed_bits, pa.binary())],
                                             ["lang", "text_key", "bits"])

    sample = distinct_text_sample(known, "lang", cap).select("lang", "text_key", "text")
    rows = (sample.mapInArrow(features, "lang string, text_key long, bits binary")
            .groupBy("lang", "text_key").agg(F.first("bits").alias("bits")).toArrow())
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "text_key", "bits"))))
    languages = sorted({lang for lang, _, _ in rows})
    labels = np.array([languages.index(lang) for lang, _, _ in rows])
    bits = np.frombuffer(b"".join(b for _, _, b in rows), np.uint8).reshape(len(rows), -1)
    each = max(1, LANDMARKS // len(languages))
    landmarks = np.concatenate([np.flatnonzero(labels == k)[:each] for k in range(len(languages))])
    return Model(languages, bits, labels, landmarks)


def predict(docs: DataFrame, model: Model | None, near: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score``; if asked for, with ``near``: the text is close to that language or to a mix of the known ones."""
    added = ["lang_pred", "score"] + ["near"] * near
    if model is None:
        return unpacked(packed(docs, lang_pred=F.lit(UNKNOWN), score=F.lit(0.0), near=F.lit(False)), docs.columns, *added)
    sent = shared(docs.sparkSession, model)
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    rows = packed(docs, readable=lettered)
    out = rows.select("doc", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("near")).schema
    schema = to_arrow_schema(out)

    def score(batches):
        model = received(sent)
        for batch in batches:
            column = batch.column("readable")
            data, offsets = utf8(column)
            best, top, close = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), bool)
            for a, b in blocks(offsets, ROWS_PER_BLOCK):
                margins = model.margins(presence(data, offsets[a:b + 1]))
                best[a:b], top[a:b] = margins.argmax(1), margins.max(1)
                if near:
                    reached = model.closeness(data, offsets[a:b + 1]) >= model.bounds
                    close[a:b] = reached[np.arange(b - a), best[a:b]] | reached[:, -1]
            readable = column.is_valid().to_numpy(zero_copy_only=False)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), readable.tolist())]
            scores = np.where(readable, np.clip((top + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(scores), pa.array(close & readable)], schema=schema)

    return unpacked(rows.mapInArrow(score, out), docs.columns, *added)


def held_out(docs: DataFrame):
    return F.coalesce(crc_remainder(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows whose language may be learned from: id and language known, not held out."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(docs))


def identify(docs: DataFrame, labelled: DataFrame | None = None, near: bool = False) -> DataFrame:
    """Fits on ``labelled`` (default: the learnable rows of ``docs``) and predicts ``docs``."""
    return predict(docs, fit(learnable(docs if labelled is None else labelled)), near)
