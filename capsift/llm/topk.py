"""Exact top-k inner products by distributed histogram selection.

Components become integers ``floor(scale * x)``, so scores are exact.  Queries and
candidates are dealt by hash into blocks of bounded size, and a task scores one block
of queries against one block of candidates with a matrix product.

Per query a score interval is known to hold the k-th highest score.  Each round every
pair of blocks counts its scores in ``BINS`` bins of that interval; the counts are
added up per query and bin, and the bin in which the k-th score falls is the next
interval.  A pair of blocks sends only its highest bins up to k counts: lower ones
cannot hold the k-th score of all.  When intervals are one integer wide they are the
k-th scores; one more pass keeps the scores above, and of the ties at the k-th score
those with the smallest ids (at most k of a pair of blocks), and a window ranks them.

Products are taken in doubles while they are exact there, else in 64-bit integers; scores
that may not fit into 64 bits raise an error.  Repeated candidates are counted first and dealt
as one row, so a row that occurs a million times fills no block.

Defined cases: vectors that are null, empty or hold null or non-finite components take
no part; vectors of different length meet only their own length; rows that carry the
query's own id are no candidates of it; repeated candidates are ranked as often as they
occur, a repeated query is answered once;
fewer than k candidates are all returned; no query, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capsift.llm.common import scratch, stored

K = 5
SCALE = 256
BINS = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
MAX_ROUNDS = 8  # 1024 ** 8 exceeds every interval of 64-bit scores


def quantized(rows: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, q, dims, reach``: integer vectors, their length, and an upper bound of their norm."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    finite_rows = rows.filter(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False)))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda total, v: total + v * v)) * (1 + 1e-9)  # rounding included
    return finite_rows.select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q")).select(
        "vec_id", "q", F.size("q").alias("dims"), F.ceil(norm + 1).cast("long").alias("reach"))


#: Integers up to this size are exact in doubles.
_EXACT = 1 << 53


def _scores(queries: pd.DataFrame, candidates: pd.DataFrame) -> np.ndarray:
    """Scores as integers; a query's own id gets the lowest number."""
    a, b = (np.stack(side["q"].to_numpy()) for side in (queries, candidates))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        scores = (a @ b.T).astype(np.int64)
    else:
        scores = a.astype(np.int64) @ b.astype(np.int64).T
    scores[queries["vec_id"].to_numpy()[:, None] == candidates["vec_id"].to_numpy()[None, :]] = np.iinfo(np.int64).min
    return scores


def _paired(queries: DataFrame, candidates: DataFrame, query_blocks: int, candidate_blocks: int):
    """Each block of queries beside each block of candidates; a pair is a group with bounded sides."""
    q = queries.withColumn("qb", F.pmod("query", F.lit(query_blocks)).cast("int"))
    c = candidates.withColumn("cb", F.pmod(F.xxhash64("vec_id", "q"), F.lit(candidate_blocks)).cast("int"))
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    keys = ["dims", "qb", "cb"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys))


def _histograms(k: int, bins: int):
    def count(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "bin": [], "n": []}
        if len(queries) and len(candidates):
            scores, copies = _scores(queries, candidates), candidates["copies"].to_numpy()
            for row, query, low, width in zip(scores, queries["query"].tolist(), queries["low"].tolist(), queries["width"].tolist()):
                inside = np.flatnonzero(row >= low)
                if len(inside) > k:  # fewer of this block can't be among the k highest of all
                    inside = inside[np.argpartition(row[inside], len(inside) - k)[len(inside) - k:]]
                above = (row[inside] - low).view(np.uint64) // np.uint64(width)  # the difference may need all 64 bits
                found, at = np.unique(np.minimum(above, np.uint64(bins)).astype(np.int64), return_inverse=True)
                n = np.bincount(at, np.minimum(copies[inside], k), len(found)).astype(np.int64)
                out["query"] += [query] * len(found)
                out["bin"] += found.tolist()
                out["n"] += n.tolist()
        return pd.DataFrame(out).astype("int64")
    return count


def _kept(k: int):
    def keep(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            scores, ids = _scores(queries, candidates), candidates["vec_id"].to_numpy()
            copies = np.minimum(candidates["copies"].to_numpy(), k)
            for row, query, query_id, low in zip(scores, queries["query"].tolist(), queries["vec_id"].tolist(), queries["low"].tolist()):
                above, tied = np.flatnonzero(row > low), np.flatnonzero(row == low)
                at = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")][:k]])
                at = np.repeat(at, copies[at])
                out["query"] += [query] * len(at)
                out["query_id"] += [query_id] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["score"] += row[at].tolist()
        return pd.DataFrame(out).astype("int64")
    return keep


def kth_scores(queries: DataFrame, candidates: DataFrame, blocks: tuple[int, int], folder: str, k: int = K, bins: int = BINS) -> DataFrame:
    """``queries`` with ``low``: the k-th highest score, or less than every score where there are fewer.

    The interval of a query is ``bins`` bins of ``width`` from ``low`` on; bin number
    ``bins`` counts what lies above it.
    """
    reach = candidates.groupBy("dims").agg(F.max("reach").alias("most"))
    bound = F.col("reach") * F.col("most")
    state = stored(queries.join(reach, "dims").select("query", "vec_id", "q", "dims", (-bound).alias("low"), F.ceil(
        (bound.cast("double") * 2 + 1) / bins).cast("long").alias("width"), F.lit(False).alias("done")), folder, "round0")
    half = F.floor(F.col("bin") / 2)  # the whole step may not fit into 64 bits
    step = lambda n: n * F.col("width")
    from_top = Window.partitionBy("query").orderBy(F.col("bin").desc())
    for number in range(1, MAX_ROUNDS + 1):
        counted = _paired(state, candidates, *blocks).applyInPandas(_histograms(k, bins), "query long, bin long, n long")
        totals = counted.groupBy("query", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(from_top))
        hit = totals.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("query", "bin")
        found = F.col("bin").isNotNull()
        state = stored(state.join(hit, "query", "left").select(
            "query", "vec_id", "q", "dims", F.when(found, F.col("low") + step(half) + step(F.col("bin") - half)).otherwise(F.col("low")).alias("low"),
            F.when(found, F.ceil(F.col("width") / bins)).otherwise(1).cast("long").alias("width"),
            (F.col("width") == 1).alias("done")), folder, f"round{number}")
        if state.filter("not done").isEmpty():
            break
    return state


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``; both sides as ``quantized`` gives them."""
    folder = scratch(candidates.sparkSession)
    candidates = stored(candidates.groupBy("vec_id", "q", "dims", "reach").agg(F.count("*").alias("copies")), folder, "candidates")
    queries = queries.withColumn("query", F.xxhash64("vec_id", "q")).dropDuplicates(["query"])
    queries = stored(queries, folder, "queries")
    bound = (queries.groupBy("dims").agg(F.max(F.col("reach").cast("double")).alias("a"))
             .join(candidates.groupBy("dims").agg(F.max(F.col("reach").cast("double")).alias("b")), "dims").agg(F.max(F.col("a") * F.col("b"))).first()[0])
    if (bound or 0) >= (1 << 63) - (1 << 57):
        raise ValueError("scores of these vectors may not fit into 64 bits: use a smaller scale")
    blocks = (-(-queries.count() // QUERY_BLOCK) or 1, -(-candidates.count() // CANDIDATE_BLOCK) or 1)
    bounded = kth_scores(queries, candidates, blocks, folder, k)
    found = _paired(bounded, candidates, *blocks).applyInPandas(_kept(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
