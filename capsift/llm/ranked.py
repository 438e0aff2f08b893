r"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

Words are runs of digits, letters and non-ASCII bytes after ASCII lower-casing.  One scan turns
each text into its word count and the items' terms in it with their frequencies, which is
all that is kept of it; the corpus figures (documents, words, documents per term) are
plain aggregates over these rows.

Documents are then scored in blocks.  Each term has a bitmap over the block's documents and a
highest contribution in it.  For an item the bitmaps are united to the documents that hold any
of its terms, and turned over to one mask per document: which of the terms it holds.
Documents of one mask are a group, whose score is at most the sum of its terms' highest
contributions.  Groups are scored exactly in the order of that bound, highest first, until the
bound is below the k-th score known (of this block and those before it in the task): no
document left can rank.  Bounds that equal it are scored too, as a tie may have the smaller id.
A task returns at most k rows an item, a window ranks these.

The items' terms are sent to the tasks only while the items' texts have at most ``PART_BYTES``;
more items are dealt by hash into parts of about that size, and each part scans the documents.

Defined cases: null, empty and wordless texts count nowhere and are never found; items without
words have no result; rows that repeat an item's id and text are one item; an item of the same id
and another text is ranked on its own; a null item id is kept as null; a repeated document is
ranked as often as it occurs; a null document id comes after the others of its score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import received, scratch, shared, stored, utf8
from capsift.llm.decontaminate import _FOLD as FOLD, words_of

K = 10
PART_BYTES = 16 << 20
#: A block has at most this many documents and, a single document apart, postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 21
#: Texts are cut into words by pieces of this many bytes.
PIECE = 4 << 20
#: Bits of a block that are turned over at once.
TURNED = 1 << 24
FIRST_GROUPS = 64
_BLANK = np.frombuffer(FOLD, np.uint8) == 32


def term_counts(text: np.ndarray, terms: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Words of a text, and frequencies of the terms in it by their number."""
    n, counts, start = 0, Counter(), 0
    while start < len(text):
        stop = min(start + PIECE, len(text))
        while stop < len(text) and not _BLANK[text[stop]]:
            stop += 1
        words = words_of(text[start:stop].tobytes())
        found = Counter(words)
        n += len(words)
        for word in found.keys() & terms.keys():
            counts[terms[word]] += found[word]
        start = stop
    return n, counts


def _postings(sent, schema: pa.Schema):
    def count(batches):
        terms = received(sent)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            sizes, numbers, frequencies = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                n, counts = term_counts(data[a:b], terms)
                sizes.append(n)
                numbers.append(sorted(counts))
                frequencies.append([counts[t] for t in numbers[-1]])
            columns = [batch.column("doc_id"), sizes, numbers, frequencies]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return count


class Block:
    """Documents with their postings by term."""

    def __init__(self, ids: list, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        """``docs, terms, tf`` are the postings; ``lengths`` the normalised lengths of the documents."""
        self.ids, self.size = ids, len(ids)
        order = np.argsort(terms, kind="stable")
        self.docs, tf = docs[order], tf[order]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * lengths[self.docs])
        numbers, starts = np.unique(terms[order], return_index=True)
        self.highest = dict(zip(numbers.tolist(), np.maximum.reduceat(self.impact, starts).tolist())) if len(starts) else {}
        self.places = dict(zip(numbers.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)])))

    def bitmap(self, term: int) -> np.ndarray:
        held = np.zeros(self.size, bool)
        start, stop = self.places[term]
        held[self.docs[start:stop]] = True
        return np.packbits(held)

    def groups(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks as bits (a column per term), the documents sorted by mask, and where each mask's documents end."""
        bitmaps = np.stack([self.bitmap(t) for t in terms])
        held = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps))[:self.size])
        step = max(8, TURNED // len(terms) // 8 * 8)
        masks = []
        for at in range(0, self.size, step):
            docs = held[(held >= at) & (held < at + step)] - at
            masks.append(np.packbits(np.unpackbits(bitmaps[:, at // 8:(at + step) // 8], axis=1)[:, docs].T, axis=1))
        masks = np.ascontiguousarray(np.concatenate(masks))
        keys = masks.view(np.dtype((np.void, masks.shape[1])))[:, 0]
        if masks.shape[1] <= 8:
            wide = np.zeros((len(masks), 8), np.uint8)
            wide[:, :masks.shape[1]] = masks
            keys = wide.view(np.uint64)[:, 0]
        order = np.argsort(keys, kind="stable")
        ends = np.append(np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1, len(order))
        distinct = masks[order[ends - 1]]
        return np.unpackbits(distinct, axis=1)[:, :len(terms)], held[order], ends

    def scores(self, chosen: np.ndarray, terms: list[int], weights: list[int]) -> np.ndarray:
        """Exact scores of documents in ascending order."""
        total = np.zeros(len(chosen), np.int64)
        for term, weight in zip(terms, weights):
            start, stop = self.places[term]
            docs = self.docs[start:stop]
            at = np.searchsorted(docs, chosen)
            hit = np.flatnonzero(at < len(docs))
            hit = hit[docs[at[hit]] == chosen[hit]]
            total[hit] += weight * self.impact[start + at[hit]]
        return total


class Best:
    """The k best documents of one item so far, best first: (-score, id is null, id)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """The score that a document must have to enter."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = [(-score, doc_id is None, doc_id or 0) for score, doc_id in zip(scores.tolist(), ids)]
        self.rows = sorted(self.rows + rows)[:self.k]


def rank(block: Block, terms: list[int], weights: list[int], best: Best) -> int:
    """Adds what ``block`` has to ``best``; returns how many documents were scored."""
    known = [(t, w) for t, w in zip(terms, weights) if w > 0 and t in block.places]
    if not known or sum(w * block.highest[t] for t, w in known) < best.least():
        return 0
    terms, weights = map(list, zip(*known))
    masks, docs, ends = block.groups(terms)
    bounds = masks.astype(np.float64) @ np.array([w * block.highest[t] for t, w in known], np.float64)  # exact: below 2 ** 53
    starts, order = np.concatenate([[0], ends[:-1]]), np.argsort(-bounds, kind="stable")
    at, size, scored = 0, FIRST_GROUPS, 0
    while at < len(order):
        live = order[at:at + size]
        live = live[bounds[live] >= best.least()]
        if not len(live):
            break
        chosen = np.sort(np.concatenate([docs[a:b] for a, b in zip(starts[live].tolist(), ends[live].tolist())]))
        scores = block.scores(chosen, terms, weights)
        scored += len(chosen)
        good = np.flatnonzero(scores >= best.least())
        if len(good) > best.k:  # of this many at most k can stay, but all that tie with the k-th may
            good = good[scores[good] >= np.partition(scores[good], len(good) - best.k)[len(good) - best.k]]
        best.add(scores[good], [block.ids[d] for d in chosen[good]])
        at, size = at + size, size * 4
    return scored


def blocks_of(batch: pa.RecordBatch, n_docs: int, n_words: int):
    """The blocks of a batch of ``doc_id, n, terms, frequencies``."""
    ids = batch.column("doc_id").to_pylist()
    n = batch.column("n").to_pylist()
    lengths = np.array([25 + 75 * size * n_docs // n_words for size in n], np.int64)
    offsets = np.concatenate([[0], np.cumsum(batch.column("terms").value_lengths().to_numpy())])
    terms, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "frequencies"))
    start = 0
    while start < len(ids):
        stop = int(np.searchsorted(offsets, offsets[start] + BLOCK_POSTINGS, side="right")) - 1
        stop = min(max(stop, start + 1), start + BLOCK_DOCS, len(ids))
        a, b = offsets[start], offsets[stop]
        docs = np.repeat(np.arange(stop - start), np.diff(offsets[start:stop + 1]))
        yield Block(ids[start:stop], lengths[start:stop], docs, terms[a:b], tf[a:b])
        start = stop


def _ranker(sent, schema: pa.Schema):
    def scan(batches):
        n_docs, n_words, k, items = received(sent)
        found = [Best(k) for _ in items]
        for batch in batches:
            for block in blocks_of(batch, n_docs, n_words):
                for (_, _, terms, weights), best in zip(items, found):
                    rank(block, terms, weights, best)
        rows = [(number, item, None if nameless else doc_id, -score)
                for (number, item, _, _), best in zip(items, found) for score, nameless, doc_id in best.rows]
        columns = list(zip(*rows)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return scan


def _parts(items: DataFrame, part_bytes: int) -> int:
    """Into how many parts the items are dealt, so that none is much larger than ``part_bytes``."""
    total = items.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    parts = max(1, -(-(total["bytes"] or 0) // part_bytes))
    while 1 < parts < total["n"]:
        largest = items.groupBy(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part")).agg(
            F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()[0]
        if (largest or 0) <= 2 * part_bytes:
            break
        parts *= 2
    return parts


def _search_part(docs: DataFrame, rows: list[tuple], item_type, part: int, folder: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms: dict[bytes, int] = {}
    items = []
    for item_id, text in rows:
        held = Counter(words_of(text.encode()))
        items.append((item_id, [terms.setdefault(w, len(terms)) for w in held], list(held.values())))
    kept = docs.select("doc_id", F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("terms"),
                       F.array().cast("array<long>").alias("frequencies")).schema
    counted = docs.select("doc_id", "text").mapInArrow(_postings(shared(spark, terms), to_arrow_schema(kept)), kept)
    counted = stored(counted.filter("n > 0"), folder, f"postings{part}")
    total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, n_words = total["docs"], total["words"] or 1
    per_term = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row per term of the part
    weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1))) for r in per_term}
    plans = [((part << 32) + i, item_id, [t for t in held if t in weight], [n * weight[t] for t, n in zip(held, times) if t in weight])
             for i, (item_id, held, times) in enumerate(items)]
    out = counted.select(F.lit(0).cast("long").alias("item"), F.lit(None).cast(item_type).alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score")).schema
    return counted.filter(F.size("terms") > 0).mapInArrow(_ranker(shared(spark, (n_docs, n_words, k, plans)), to_arrow_schema(out)), out)


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, part_bytes: int = PART_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item."""
    folder = scratch(docs.sparkSession)
    items = benchmark.filter("text is not null").select("item_id", "text").distinct()
    parts, kind = _parts(items, part_bytes), benchmark.schema["item_id"].dataType
    found = None
    for part in range(parts):  # a part's items come to the driver: their bytes were counted
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = sorted(((r["item_id"], r["text"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ranked = _search_part(docs, rows, kind, part, folder, k)
        found = ranked if found is None else found.unionByName(ranked)
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _sql_words(x: str) -> str:
    low = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, {_sql_words('text')} as w from documents where text is not null),
c as (select count(*) as big_n, sum(len(w)) as big_l from d where len(w) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
i as (select row_number() over () as i, item_id, {_sql_words('text')} as w from (select distinct item_id, text from benchmark where text is not null)),
q as (select i, item_id, term, count(*) as times from (select i, item_id, unnest(w) as term from i) group by all),
df as (select term, count(*) as df from tf semi join q using (term) group by term),
w as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from df, c),
m as (select r, doc_id, 25 + cast((75 * len(w) * big_n) // big_l as bigint) as m from d, c where len(w) > 0),
s as (select i, item_id, r, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join w using (term) join tf using (term) join m using (r) group by all),
k as (select *, cast(row_number() over (partition by i order by score desc, doc_id nulls last) as integer) as rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 10
"""
