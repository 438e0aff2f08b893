r"""SimHash near-duplicates: fingerprints, and exact pairs within a Hamming distance by vantage-point trees.

A text is ASCII lower-cased and split at ASCII white space; its shingles are three words
joined by a blank (a shorter text is one shingle), hashed with XXH64 (seed 42).  A bit of
the fingerprint is set when over half of the hashes have it.

Distinct fingerprints are partitioned by distance.  A tree of vantage points, built from a
bounded sample, has at each node a point ``v`` and a radius ``r``.  Fingerprints with
``d(v, x) <= r`` go inside, the others outside; those with ``d(v, x) <= r + D`` that went
outside visit the inside as well, since by the triangle bound a partner inside is at most
``D`` nearer.  So each pair within ``D`` meets in some leaf.  Leaves are shards, sized by
counting; a shard that distance cannot split is cut into blocks by hash, and every pair of
blocks is a task.  Within a task the same kind of tree runs on, down to small leaves that
are compared in full.

A task sends no pairs but a spanning forest (fingerprint, smallest of its local group), so
a dense cluster costs its size and not its square.  Components follow by joins, and
documents get theirs through their fingerprint, so copies are never expanded.

Defined cases: null and wordless texts have fingerprint zero, which links like any other;
a component of null ids only has a null id; repeated rows are kept; no row, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsift.llm.common import received, scratch, shared, stored, utf8
from capsift.llm.links import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Bounds of the sample the tree is built from, of a shard's expected size, and of a leaf compared in full.
SAMPLE = 32_768
SHARDS = 256
SMALLEST_SHARD, LARGEST_SHARD = 512, 32_768
LEAF = 384
_PIECE = 1 << 14


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = (stops - sizes).tolist()
    stops = stops[SHINGLE - 1:].tolist() if len(words) >= SHINGLE else [len(joined)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(stops), _PIECE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _PIECE], stops[at:at + _PIECE])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16 if len(bits) < 65536 else np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(stops)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, text_key, fp``; the 64 bits as a signed long."""
    def hashed(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes() if len(offsets) > 1 else b""
            found = [fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.int64())],
                                             ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(hashed, "doc_id long, text_key long, fp long")


def distance(point: np.uint64, points: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def best_split(points: np.ndarray, reach: int, tries: int = 12) -> tuple[int, int, np.ndarray] | None:
    """Vantage point and radius with the least quadratic work in both halves, and the distances; None if none helps.

    Vantage points are tried at even steps through the points, so the same points give the same tree.
    """
    n, best = len(points), None
    for point in points[np.linspace(0, n - 1, min(tries, n)).astype(int)]:
        d = distance(point, points)
        upto = np.cumsum(np.bincount(d, minlength=66))
        inside = np.append(upto[reach:65], [n] * reach)[:65]  # d <= r + reach
        outside = n - upto[:65]
        work = inside.astype(float) ** 2 + outside.astype(float) ** 2
        work[outside == 0] = np.inf
        r = int(np.argmin(work))
        if work[r] < 0.95 * float(n) * n and (best is None or work[r] < best[0]):
            best = (work[r], int(point), r, d)
    return best and best[1:]


class Tree:
    """Nodes as ``(vantage point, radius, inside, outside)``; a negative child ``-1 - s`` is shard ``s``."""

    def __init__(self, sample: np.ndarray, target: float, reach: int):
        self.nodes: list[list[int]] = []
        self.shards, self.reach = 0, reach
        self.root = self._grow(sample, target)

    def _grow(self, points: np.ndarray, target: float) -> int:
        split = best_split(points, self.reach) if len(points) > max(target, 8) else None
        if split is None:
            self.shards += 1
            return -self.shards
        point, radius, d = split
        at = len(self.nodes)
        self.nodes.append([point, radius, 0, 0])
        self.nodes[at][2] = self._grow(points[d <= radius + self.reach], target)
        self.nodes[at][3] = self._grow(points[d > radius], target)
        return at

    def assign(self, points: np.ndarray):
        """``(shard, indices)`` of the points that belong to or visit each shard."""
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            at, index = stack.pop()
            if not len(index):
                continue
            if at < 0:
                yield -1 - at, index
                continue
            point, radius, inside, outside = self.nodes[at]
            d = distance(np.uint64(point), points[index])
            stack.append((inside, index[d <= radius + self.reach]))
            stack.append((outside, index[d > radius]))


class Forest:
    """Union-find over positions, kept flat."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


def link(points: np.ndarray, reach: int) -> np.ndarray:
    """For sorted distinct points the position of the smallest in each one's group of chained neighbours."""
    forest = Forest(len(points))
    stack = [np.arange(len(points))]
    while stack:
        index = stack.pop()
        split = best_split(points[index], reach, 4) if len(index) > LEAF else None
        if split is not None:
            _, radius, d = split
            stack += [index[d <= radius + reach], index[d > radius]]
            continue
        own = points[index]
        rows = max(1, (1 << 20) // max(1, len(own)))
        for at in range(0, len(own), rows):
            i, j = np.nonzero(np.bitwise_count(own[at:at + rows, None] ^ own[None, at:]) <= reach)
            apart = i < j
            if apart.any():
                forest.join(index[i[apart] + at], index[j[apart] + at])
    return forest.root


def neighbours(distinct: DataFrame, folder: str, reach: int = DISTANCE) -> DataFrame:
    """``fp`` (distinct) -> edges ``u, v`` that connect all fingerprints chained within ``reach``."""
    spark = distinct.sparkSession
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = distinct.filter(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    points = np.sort(np.array([r["fp"] for r in sample.select("fp").collect()], np.int64)).view(np.uint64)  # at most about SAMPLE
    size = min(max(n / SHARDS, SMALLEST_SHARD), LARGEST_SHARD)
    tree = Tree(points, size * share, reach)
    sent = shared(spark, tree)

    def deal(batches):
        tree = received(sent)
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for shard, index in tree.assign(fps.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), shard, np.int32)), pa.array(fps[index])], ["shard", "fp"])

    dealt = stored(distinct.select("fp").mapInArrow(deal, "shard int, fp long"), folder, "shards")
    # shards larger than twice the expected size are cut into blocks; every pair of blocks is a group
    blocks = F.ceil(F.col("n") / (2 * size)).cast("int")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).select("shard", blocks.alias("blocks"))  # as many rows as the tree has leaves
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own")))
    grouped = dealt.join(F.broadcast(sizes), "shard").withColumn("own", own).select("shard", "fp", F.explode(others).alias("pair"))

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(group["fp"].to_numpy())
        root = link(fps.view(np.uint64), reach)
        moved = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[moved], "v": fps[root[moved]]})

    return grouped.groupBy("shard", "pair").applyInPandas(connect, "u long, v long")


def near_duplicates(docs: DataFrame, reach: int = DISTANCE) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id``: the smallest fingerprint and the smallest id that chained links reach.

    The root tells components apart; ids may be null or repeated in several of them.
    """
    folder = scratch(docs.sparkSession)
    hashed = stored(fingerprints(docs), folder, "fingerprints")
    distinct = stored(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), folder, "distinct")
    found = components(neighbours(distinct, folder, reach), folder)
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, folder, "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), folder, "smallest")
    named = stored(rooted.join(smallest, "root").select("fp", "root", "component_id"), folder, "named")
    return hashed.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
