"""Long repeats across a corpus: every byte covered by ``MIN_LEN`` bytes that also start elsewhere.

A corpus has too many suffixes to sort, and nearly all of them are unlike any other.  So
texts are cut by content first.  Of each window of ``MIN_LEN`` bytes the ``GRAM``-byte gram
with the smallest hash (the leftmost of equals) is the anchor; equal windows have equal
anchors, hence a window can only be repeated among windows of its anchor.  Windows in a row
with the same anchor form a segment, on average half of ``MIN_LEN`` windows.

Anchors seen once are done: nothing in their windows repeats.  Segments that are equal byte
for byte combine to one class with a count, before anything is shuffled by anchor, so
thousands of copies cost one segment.  Where an anchor has several classes, one segment of
each goes, with its text, to a block in which the Burrows-Wheeler interval expansion of
``bwt`` finds the windows that repeat.  An anchor of more than ``GROUP`` classes is dealt
over several groups by the hash of the class.  Its segments are first cut to their reach:
what stands before the anchor (read backwards) and after it is sorted over the cluster, and
the longest prefix that a side shares with a neighbour bounds every window that can be
repeated.  Windows within reach that a group found alone are compared across the groups by
their content hash, counted in a plain aggregate (64 bits, so two unlike windows among a billion
would be taken for equal with a chance of some 3 percent).  No key gathers all its rows in one task.

Passages shorter than that are told beside it: bytes that ``PASSAGE_LEN`` bytes cover which also
start elsewhere.  A string that repeats has only parts that repeat, so the long repeats are
then looked for in the runs that the short ones cover, and not in the whole texts again.

Rows of equal id and text count as separate documents and get equal results.  Null texts
are empty.  Texts shorter than ``MIN_LEN`` bytes have no window and keep every byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsift.llm.bwt import repeated_starts
from capsift.llm.common import BLOCK_BYTES, blocks, scratch, stored, utf8

MIN_LEN = 400
#: Some 50 words of five bytes.
PASSAGE_LEN = 250
GRAM = 64
GROUP = 256
#: Bytes of segments that one transform covers: its tables stay near the cores' caches.
TRANSFORM_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each position, by doubling the span of a hash."""
    n = len(data) - 7
    value = np.ndarray(n, np.uint64, np.ascontiguousarray(data), strides=(1,))
    value, span = _mixed(value + np.uint64(1)), 8
    while span < GRAM:
        value = _mixed(value[:-span] * np.uint64(_ODD) + value[span:])
        span *= 2
    return value


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


class _Sums:
    """Content hashes of stretches, from prefix sums of gram hashes times powers."""

    def __init__(self, grams: np.ndarray):
        n = len(grams)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(grams * power[:n], dtype=np.uint64)])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the grams that begin in ``start`` to ``stop - 1``."""
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def segments(data: np.ndarray, offsets: np.ndarray, min_len: int) -> dict[str, np.ndarray]:
    """Segments of the texts between the offsets: row, first and last window (from the text's
    start), windows of the first of equal segments in a row, how many those are, anchor and class."""
    begin, end = int(offsets[0]), int(offsets[-1])
    sizes = np.diff(offsets)
    n_windows = np.maximum(sizes - min_len + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return {}
    grams = gram_hashes(data[begin:end])
    at = np.arange(len(grams), dtype=np.uint64)
    lowest = sliding_min((grams & ~_POSITION) | at, min_len - GRAM + 1)
    row = np.repeat(np.arange(len(sizes)), n_windows)
    text_start = (offsets[:-1] - begin)[row]
    window = text_start + np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    anchor = (lowest[window] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(first[1:], total) - 1
    lo, hi, place, row, text_start = window[first], window[last], anchor[first], row[first], text_start[first]
    content = _Sums(grams).between(lo, hi + min_len - GRAM + 1)
    kind = _mixed(content + (hi - lo).astype(np.uint64) * np.uint64(_ODD) + (place - lo).astype(np.uint64))
    anchors = grams[place]
    # periodic texts repeat a segment at once: such a row of equals is one entry
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    return {"row": row[head], "lo": (lo - text_start)[head], "hi": (hi - text_start)[tail], "windows": (hi - lo + 1)[head],
            "n": tail - head + 1, "anchor": anchors[head].view(np.int64), "kind": kind[head].view(np.int64)}


def _pieces(offsets: np.ndarray, min_len: int):
    """Row ranges and offsets of blocks; a very long text comes in pieces that overlap by a window."""
    for a, b in blocks(offsets, 4096):
        size = int(offsets[b] - offsets[a])
        if b - a > 1 or size <= 2 * BLOCK_BYTES:
            yield a, 0, offsets[a:b + 1]
            continue
        for start in range(0, size - min_len + 1, BLOCK_BYTES):
            stop = min(start + BLOCK_BYTES + min_len - 1, size)
            yield a, start, offsets[a] + np.array([start, stop])


def segment_table(docs: DataFrame, min_len: int) -> DataFrame:
    """``doc_id, text_key, text`` -> one row per segment."""
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for first_row, skipped, part in _pieces(offsets, min_len):
                found = segments(data, part, min_len)
                if found:
                    rows = pa.array(found["row"] + first_row)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows), keys.take(rows), pa.array(found["anchor"]), pa.array(found["kind"]),
                         *[pa.array((found[c] + (skipped if c in ("lo", "hi") else 0)).astype(np.int32)) for c in ("lo", "hi", "windows", "n")]],
                        ["doc_id", "text_key", "anchor", "kind", "lo", "hi", "windows", "n"])

    return docs.mapInArrow(cut, "doc_id long, text_key long, anchor long, kind long, lo int, hi int, windows int, n int")


_TEXTS = "anchor long, kind long, salt int, salts int, n long, doc_id long, text_key long, lo int, bytes binary"
_FOUND = "doc_id long, text_key long, start int, stop int, content long, alone boolean"


def _cut_texts(min_len: int):
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            owner = np.repeat(np.arange(len(wanted)), wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            field = lambda c: flat.field(c)
            lo = field("lo").to_numpy(zero_copy_only=False).astype(np.int64)
            start = offsets[owner] + lo
            stop = start + field("windows").to_numpy(zero_copy_only=False) + min_len - 1
            for at in range(0, len(flat), 4096):
                part = slice(at, at + 4096)
                rows = pa.array(owner[part])
                texts = [data[a:b].tobytes() for a, b in zip(start[part].tolist(), stop[part].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[field(c).slice(at, len(texts)) for c in ("anchor", "kind", "salt", "salts", "n")], batch.column("doc_id").take(rows),
                     batch.column("text_key").take(rows), field("lo").slice(at, len(texts)), pa.array(texts, pa.binary())],
                    ["anchor", "kind", "salt", "salts", "n", "doc_id", "text_key", "lo", "bytes"])
    return cut


def _place(text: np.ndarray, anchor: int) -> int:
    """Where the anchor of a segment begins: it is the leftmost of equal grams."""
    return int(np.flatnonzero(gram_hashes(text).view(np.int64) == anchor)[0])


def _views(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8) for x in column]


def _sides(batches):
    """Two rows per segment: what stands before its anchor, read backwards, and what stands after it."""
    for batch in batches:
        anchors, kinds = batch.column("anchor"), batch.column("kind")
        texts = _views(batch.column("bytes"))
        places = [_place(text, anchor) for text, anchor in zip(texts, anchors.to_pylist())]
        before = [text[:at][::-1].tobytes() for text, at in zip(texts, places)]
        after = [text[at + GRAM:].tobytes() for text, at in zip(texts, places)]
        for side, parts in enumerate((before, after)):
            yield pa.RecordBatch.from_arrays([anchors, kinds, pa.array([side] * len(parts), pa.int32()), pa.array(parts, pa.binary())],
                                             ["anchor", "kind", "side", "part"])


def shared_prefixes(parts: list[bytes]) -> np.ndarray:
    """Bytes that each part, but the last, shares with the next one."""
    lengths = np.array([len(x) for x in parts])
    inside = np.arange(max(1, lengths.max())) < lengths[:, None]
    matrix = np.zeros(inside.shape, np.uint8)
    matrix[inside] = np.frombuffer(b"".join(parts), np.uint8)
    same = (matrix[1:] == matrix[:-1]) & inside[1:] & inside[:-1]
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def _reaches(batches):
    """Sorted sides -> the longest prefix that a side shares with a neighbour of its anchor.

    The neighbours beyond a partition are unknown: its first and last side reach as far as they go.
    """
    def rows(anchor, kind, side, reach):
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(kind), pa.array(side, pa.int32()), pa.array(reach, pa.int32())],
                                          ["anchor", "kind", "side", "reach"])

    held, before = None, 0
    for batch in batches:
        anchor, kind, side = (batch.column(c).to_numpy() for c in ("anchor", "kind", "side"))
        parts = batch.column("part").to_pylist()
        if not parts:
            continue
        if held:
            anchor, kind, side = (np.concatenate([[x], y]) for x, y in zip(held, (anchor, kind, side)))
            parts = [held[3], *parts]
        else:
            before = len(parts[0])
        same = (anchor[1:] == anchor[:-1]) & (side[1:] == side[:-1])
        after = np.where(same, shared_prefixes(parts), 0)
        yield rows(anchor[:-1], kind[:-1], side[:-1], np.maximum(np.append(before, after[:-1])[:len(after)], after))
        before = after[-1] if len(after) else before
        held = (anchor[-1], kind[-1], side[-1], parts[-1])
    if held:
        yield rows(*([x] for x in held[:3]), [len(held[3])])


def _within_reach(min_len: int):
    """Segments cut to ``before`` bytes ahead of the anchor and ``after`` behind it; those without a window go."""
    def cut(batches):
        for batch in batches:
            texts = _views(batch.column("bytes"))
            anchors, before, after = (batch.column(c).to_pylist() for c in ("anchor", "before", "after"))
            places = np.array([_place(text, anchor) for text, anchor in zip(texts, anchors)], np.int64)
            start = places - np.array(before, np.int64)
            stop = places + GRAM + np.array(after, np.int64)
            keep = np.flatnonzero(stop - start >= min_len)
            part = batch.take(pa.array(keep))
            kept = [texts[i][start[i]:stop[i]].tobytes() for i in keep.tolist()]
            names = ["anchor", "kind", "salt", "salts", "n", "doc_id", "text_key"]
            lo = part.column("lo").to_numpy() + start[keep]
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(lo, pa.int32()), pa.array(kept, pa.binary())], [*names, "lo", "bytes"])
    return cut


def within_reach(texts: DataFrame, min_len: int) -> DataFrame:
    """Segments of anchors that have many classes, without the windows that agree with no other class.

    The class breaks ties of the sort, so sides that are equal spread over partitions as well.
    """
    sides = texts.select("anchor", "kind", "bytes").mapInArrow(_sides, "anchor long, kind long, side int, part binary")
    order = ["anchor", "side", "part", "kind"]
    reaches = sides.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_reaches, "anchor long, kind long, side int, reach int")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("reach")))
    reach = reaches.groupBy("anchor", "kind").agg(of(0).alias("before"), of(1).alias("after"))
    return texts.join(reach, ["anchor", "kind"]).mapInArrow(_within_reach(min_len), _TEXTS)


def _whole_groups(batches):
    """Tables of at most about ``TRANSFORM_BYTES`` that hold groups of (anchor, salt) whole."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        anchor, salt = (held.column(c).to_numpy() for c in ("anchor", "salt"))
        bounds = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
        if not len(bounds):
            continue
        upto = np.cumsum(np.fromiter((len(x.as_buffer()) for x in held.column("bytes")), np.int64, len(held)))
        start = 0
        while True:
            base = upto[start - 1] if start else 0
            later = bounds[bounds > start]
            if not len(later):
                break
            fit = later[upto[later - 1] - base <= TRANSFORM_BYTES]
            stop = int(fit[-1]) if len(fit) else int(later[0])
            if len(fit) == len(later) and upto[-1] - base <= TRANSFORM_BYTES:
                break  # the rest waits for more
            yield held.slice(start, stop - start)
            start = stop
        held = held.slice(start).combine_chunks()
    if held is not None and len(held):
        yield held


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
    return list(zip(edges[::2], edges[1::2]))


def _find(min_len: int):
    names = ["doc_id", "text_key", "start", "stop", "content", "alone"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def find(batches):
        for table in _whole_groups(batches):
            texts = [np.frombuffer(x.as_buffer(), np.uint8) for chunk in table.column("bytes").chunks for x in chunk]
            repeated = repeated_starts(texts, min_len)
            spans, crossing = [], []
            columns = [table.column(c).to_pylist() for c in ("salts", "n", "doc_id", "text_key", "lo")]
            for text, mask, salts, n, doc_id, key, lo in zip(texts, repeated, *columns):
                if n == 1:
                    spans += [(doc_id, key, lo + a, lo + b - 1 + min_len, None, None) for a, b in _runs(mask)]
                if salts > 1:
                    at = np.arange(len(mask))
                    content = _Sums(gram_hashes(text)).between(at, at + min_len - GRAM + 1).view(np.int64)
                    known = mask | (n > 1)
                    crossing.append((doc_id, key, lo + at[~known], content[~known], np.unique(content[known])))
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans), types)], names)
            if crossing:
                seen = np.unique(np.concatenate([c[4] for c in crossing]))
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(seen), t) for t in types[:4]], pa.array(seen), pa.array(np.zeros(len(seen), bool))], names)
                for doc_id, key, at, content, _ in crossing:
                    k = len(at)
                    if k:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc_id] * k, types[0]), pa.array([key] * k, types[1]), pa.array(at.astype(np.int32)),
                             pa.array((at + min_len).astype(np.int32)), pa.array(content), pa.array(np.ones(k, bool))], names)
    return find


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``doc_id, text_key, spans`` (byte ranges, may overlap) for the documents that hold repeats."""
    folder = scratch(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    long = docs.filter(F.octet_length("text") >= min_len)
    every = stored(segment_table(long, min_len), folder, "segments")
    anchors = every.groupBy("anchor").agg(F.sum("n").alias("seen"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    anchors = stored(anchors.filter("seen > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), folder, "anchors")
    shared = stored(every.join(anchors, "anchor"), folder, "shared")

    mixed = shared.filter("mixed")
    place = F.struct("doc_id", "text_key", "lo", "windows")
    classes = stored(mixed.groupBy("anchor", "kind").agg(F.sum("n").alias("n"), F.min(place).alias("place")), folder, "classes")
    salts = classes.groupBy("anchor").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    salts = stored(salts, folder, "salts")
    dealt = classes.join(salts, "anchor").select("anchor", "kind", F.pmod("kind", "salts").cast("int").alias("salt"), "salts", "n", "place.*")
    wanted = dealt.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "kind", "salt", "salts", "n", "lo", "windows")).alias("wanted"))
    wanted = stored(wanted, folder, "wanted")
    texts = _beside(long, wanted, "inner").select("doc_id", "text_key", "text", "wanted").mapInArrow(_cut_texts(min_len), _TEXTS)
    texts = stored(texts, folder, "texts")
    texts = texts.filter("salts = 1").unionByName(within_reach(texts.filter("salts > 1"), min_len))
    dealt_texts = texts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = stored(dealt_texts.mapInArrow(_find(min_len), _FOUND), folder, "found")

    alone = found.filter("alone")
    counted = found.filter("content is not null").groupBy("content").agg(F.count("*").alias("n"), F.bool_or(~F.col("alone")).alias("known"))
    twice = stored(counted.filter("n > 1 or known").select("content"), folder, "twice")
    copies = classes.filter("n > 1").select("anchor", "kind")
    stretch = ["doc_id", "text_key", F.col("lo").alias("start"), (F.col("hi") + min_len).alias("stop")]
    spans = (shared.filter("not mixed").select(*stretch)
             .unionByName(mixed.join(copies, ["anchor", "kind"]).select(*stretch))
             .unionByName(found.filter("content is null").select("doc_id", "text_key", "start", "stop"))
             .unionByName(alone.join(twice, "content", "left_semi").select("doc_id", "text_key", "start", "stop")))
    return stored(spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), folder, "spans")


def _cut_pieces(min_len: int):
    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            found = [(i, a, b) for i, runs in enumerate(_runs_by_row(batch.column("spans"))) for a, b in runs if b - a >= min_len]
            for part in range(0, len(found), 4096):
                row, start, stop = map(list, zip(*found[part:part + 4096]))
                texts = [data[offsets[i] + a:offsets[i] + b].tobytes() for i, a, b in zip(row, start, stop)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_key")], pa.array(start, pa.int32()), pa.array(texts, pa.binary())],
                    ["doc_id", "owner", "at", "text"])
    return cut


def nested_spans(docs: DataFrame, min_len: int, longer: int) -> DataFrame:
    """``repeated_spans`` of ``min_len`` and, as ``longer``, those of more bytes.

    Each place of a string that repeats lies within a run that its parts cover, so the runs of
    ``longer`` bytes or more stand for the texts; a row's runs count as often as the row.
    """
    folder = scratch(docs.sparkSession)
    spans = repeated_spans(docs, min_len)
    long = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").filter(F.octet_length("text") >= longer)
    pieces = _beside(long, spans, "inner").select("doc_id", "text_key", "text", "spans")
    pieces = stored(pieces.mapInArrow(_cut_pieces(longer), "doc_id long, owner long, at int, text binary"), folder, "pieces")
    places = pieces.select("doc_id", "owner", "at", F.xxhash64("text").alias("text_key"))
    moved = F.transform("spans", lambda x: F.struct((x.start + F.col("at")).alias("start"), (x.stop + F.col("at")).alias("stop")))
    found = _beside(places, repeated_spans(pieces.select("doc_id", "text"), longer), "inner").select("doc_id", F.col("owner").alias("text_key"), moved.alias("moved"))
    found = found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("moved")).alias("longer"))
    return stored(_beside(spans, found, "left"), folder, "spans")


def _beside(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to a table of (doc_id, text_key), null ids included."""
    side = side.withColumnsRenamed({"doc_id": "side_id", "text_key": "side_key"})
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("side_id")) & (F.col("text_key") == F.col("side_key")), how).drop("side_id", "side_key")


def covered(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover together."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(starts[1:] > stops[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), stops[np.append(new, len(starts)) - 1].tolist()))


def _runs_by_row(spans: pa.Array) -> list[list[tuple[int, int]]]:
    lengths = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    starts, stops = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
    bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [covered(starts[a:b], stops[a:b]) for a, b in zip(bounds, bounds[1:])]


def _kept(batch, spans: str = "spans"):
    """Per row: bytes of the text, removed runs, and what is left."""
    data, offsets = utf8(batch.column("text"))
    for a, b, runs in zip(offsets[:-1].tolist(), offsets[1:].tolist(), _runs_by_row(batch.column(spans))):
        text = data[a:b]
        if runs:
            keep = np.ones(b - a, bool)
            for start, stop in runs:
                keep[start:stop] = False
            text = text[keep]
        yield b - a, runs, text.tobytes()


def _size(runs: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in runs)


def report(docs: DataFrame, min_len: int = MIN_LEN, passages: int | None = None) -> DataFrame:
    """The contract's columns; with ``passages``, at most ``min_len``, also ``n_repeated``: bytes that so many bytes cover which also start elsewhere."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated"]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64()]

    def digest(batches):
        for batch in batches:
            rows = [(n, _size(runs), len(runs), hashlib.sha256(kept).hexdigest()) for n, runs, kept in _kept(batch, "longer" if passages else "spans")]
            columns = list(zip(*rows)) or [[]] * 4
            if passages:
                columns.append([_size(runs) for runs in _runs_by_row(batch.column("spans"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names[:1 + len(columns)])

    docs = docs.select("doc_id", "text")
    spans = nested_spans(docs, passages, min_len) if passages else repeated_spans(docs, min_len)
    rows = _beside(docs.withColumn("text_key", F.xxhash64("text")), spans, "left").drop("text_key")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(passages))


def drop_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and ``n_chars`` (if there) counted anew; texts that are all repeat go.

    A cut inside a character takes the whole character.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spans = repeated_spans(docs.select("doc_id", "text"), min_len)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text"))
    rows = _beside(rows, spans, "left").select("doc", "text", "spans")
    out = rows.select("doc", F.lit("").alias("kept"), F.lit(0).alias("n_spans")).schema
    schema = to_arrow_schema(out)

    def cut(batches):
        for batch in batches:
            results = list(_kept(batch))
            kept = [text.decode("utf-8", "ignore") for _, _, text in results]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.string()), pa.array([len(r) for _, r, _ in results], pa.int32())], schema=schema)

    done = rows.mapInArrow(cut, out).filter("n_spans = 0 or kept <> ''")
    changed = {"text": F.when(F.col("n_spans") > 0, F.col("kept")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_spans") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("doc.n_chars"))
    return done.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
