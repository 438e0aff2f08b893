r"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over whole texts.

Words are runs of digits, letters and non-ASCII bytes after ASCII lower-casing.  A
window is ``N`` consecutive words of an item; an item of fewer words is one window.
Training words become numbers of the benchmark's vocabulary, windows become rolling
hashes of those numbers, and hashes that are in the set are verified word by word.

The set is broadcast only while it has at most ``max_windows`` windows.  A larger
benchmark is dealt into parts of about that size by the hash of the item, every part
scans the documents, and what the parts found is united per document.

Defined cases: null and empty texts have no words and no hits; items without words
match nothing; items of equal text count as several items; an item id occurring twice
counts once; a null item id is no item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import packed, received, scratch, shared, stored, unpacked, utf8

N = 10
MAX_WINDOWS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Byte table: upper case to lower case, ASCII that is no letter or digit to blank.
_FOLD = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Windows:
    """The windows of benchmark items, looked up by rolling hash and verified by their words."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N):
        self.numbers: dict[bytes, int] = {}
        self.owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - n + 1) if words else 0):
                self.owners[tuple(words[i:i + n])].add(item)
        for window in self.owners:
            for word in window:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        by_length = defaultdict(list)
        for window in self.owners:
            by_length[len(window)].append([self.numbers[w] for w in window])
        self.hashes = {k: np.unique(rolling(np.array(rows, np.uint64), k)) for k, rows in sorted(by_length.items())}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        known = np.fromiter(map(self.numbers.get, words, [0] * len(words)), np.uint64, len(words))
        for k, hashes in self.hashes.items():
            if len(words) < k:
                break
            whole = np.convolve(known == 0, np.ones(k, np.int32), "valid") == 0 if k > 1 else known != 0
            starts = np.flatnonzero(whole)
            if not len(starts):
                continue
            found = rolling(known[starts[:, None] + np.arange(k)], k)[:, 0]
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for start in starts[hashes[at] == found].tolist():
                owners = self.owners.get(tuple(words[start:start + k]))
                if owners:
                    hit[start:start + k] = True
                    items |= owners
        return hit, items


def rolling(numbers: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` numbers along the last axis."""
    width = numbers.shape[-1] - k + 1
    value = np.zeros((*numbers.shape[:-1], width), np.uint64)
    for i in range(k):
        value = (value ^ numbers[..., i:i + width]) * _MULTIPLIER
        value ^= value >> np.uint64(29)
    return value


FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def _scanner(windows_of, schema: pa.Schema):
    def scan(batches):
        windows = received(windows_of)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, spans, items = [], [], []
            for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = words_of(data[start:stop].tobytes())
                hit, owners = windows.hits(words) if words else (np.zeros(0, bool), set())
                edges = np.flatnonzero(np.diff(hit, prepend=False, append=False)).tolist() if owners else []
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                items.append(sorted(owners))
            columns = [batch.column("doc"), counts, spans, items]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return scan


def _scan(rows: DataFrame, items: list[tuple[str, bytes]], n: int) -> DataFrame:
    kind = rows.select("doc").schema.simpleString()[len("struct<"):-1].replace("doc:", "doc ", 1)
    out = rows.sparkSession.createDataFrame([], f"{kind}, {FOUND}").schema
    return rows.mapInArrow(_scanner(shared(rows.sparkSession, Windows(items, n)), to_arrow_schema(out)), out)


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, hit word ``spans`` and the ``items`` that occur."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    n_windows = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-n_windows // max_windows))
    load = lambda part: [(r["item"], r["text"].encode()) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]
    if parts == 1:
        found = _scan(packed(docs, text=F.col("text")), load(0), n)
        return unpacked(found, docs.columns, "n_words", "spans", "items")

    folder = scratch(docs.sparkSession)
    thin = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("doc"), "text")
    each = [stored(_scan(thin, load(part), n).filter(F.size("items") > 0), folder, f"part{part}") for part in range(parts)]
    pieces = each[0]
    for more in each[1:]:
        pieces = pieces.unionByName(more)
    united = pieces.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
                                       F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    words = F.coalesce(F.regexp_count("doc.text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    rows = packed(docs).withColumn("text_key", F.xxhash64("doc.text")).withColumn("n_words", words)
    joined = rows.join(united.withColumnRenamed("doc", "at"), (F.col("doc.doc_id").eqNullSafe(F.col("at.doc_id"))) & (
        F.col("text_key") == F.col("at.text_key")), "left")
    spans = F.coalesce(merged(F.col("spans")), F.array().cast("array<struct<start:long,stop:long>>"))
    joined = joined.withColumn("spans", spans).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return unpacked(joined, docs.columns, "n_words", "spans", "items")


def merged(spans):
    """Sorted spans with overlaps joined."""
    empty = F.array().cast("array<struct<start:long,stop:long>>")

    def add(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= span["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's columns."""
    found = find(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like those of ``find`` under other names, and the way back."""
    theirs = {name: f"_theirs_{name}" for name in ("n_words", "spans", "items") if name in docs.columns}
    return docs.withColumnsRenamed(theirs), {new: old for old, new in theirs.items()}


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those in which an item's window occurs; passages of items without an id count as well."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    rows, back = _aside(docs)
    return find(rows, named, **options).filter(F.size("items") == 0).select(*rows.columns).withColumnsRenamed(back)


def drop_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit words cut out of the text; what stood between two kept words stays with the first."""
    rows, back = _aside(docs)
    found = find(rows, benchmark, **options)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all("text", F.lit(word), F.lit(0))
    kept = F.filter(pieces, lambda piece, i: ~F.exists("spans", lambda s: (s["start"] <= i) & (i < s["stop"])))
    text = F.when(F.size("items") > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*rows.columns).withColumnsRenamed(back)


def _sql_words(x: str) -> str:
    low = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


ORACLE = f"""
with i as (select item_id, {_sql_words('text')} as w from benchmark where item_id is not null),
iw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[j:j+9], ' ') as win
  from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as j from i where len(w) > 0)),
d as (select row_number() over () as r, doc_id, {_sql_words('text')} as w from documents),
dw as (select r, j, k, array_to_string(w[j:j+k-1], ' ') as win from (select *, unnest(range(1, len(w) - k + 2)) as j
  from d, (select distinct k from iw) where len(w) >= k)),
m as (select r, j, k, item_id from dw join iw using (k, win)),
n as (select r, count(distinct p) as n_hit from (select r, unnest(range(j, j + k)) as p from (select distinct r, j, k from m)) group by r),
s as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, cast(item_id as varchar) as item from m) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (r) left join s using (r)
"""
