"""The line model and the three building blocks every other operator uses.

``lines`` is ``capture_id, line_no, line``.  One capture may hold a large share
of all rows, so nothing here sorts or collects a whole capture in one task:

* :func:`capped` ranks inside (key, run of ``CHUNK`` line numbers) or inside
  each scan task first, and only lets the survivors meet per key;
* :func:`carry` takes running state across a capture chunk by chunk, with a
  small table of per-chunk summaries bridging the borders;
* :func:`tally` leaves repeats to the partial aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from capsift.functions.text import bigint, not_blank

#: Line numbers per chunk: the largest run of one capture that a task sorts.
CHUNK = 65536


def explode_lines(captures: DataFrame, text: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    """One row per line, empty and trailing lines kept; no shuffle."""
    return captures.select(
        "capture_id", *keep, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    ).withColumn("line_no", bigint("line_no"))


def chunk_of(line_no: str = "line_no", size: int = CHUNK) -> Column:
    return F.floor(F.col(line_no) / size)


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column,
           totals: Mapping[str, tuple[str, Column]] | None = None,
           split: Column | None = None, limit_first: bool = False, last: int = 0,
           place: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows per key, with ``rank`` and whole-group ``totals``.

    ``totals`` maps an output column to ``("sum" | "min" | "max", expression)``
    and covers the whole group, also the rows that are cut.  ``split`` divides a
    key's rows (default: runs of line numbers) so that a hot key is ranked by
    many tasks; each passes on at most ``k`` rows and its partial totals.

    ``limit_first`` suits rows that are most of a text: every scan task keeps
    ``k`` rows per key before anything is shuffled, and totals come from a
    second, combining pass.  Without it the rows are shuffled once and read
    once, which is better for rows that a filter made rare.

    With ``last`` the last rows per key are kept as well, and ``from_end`` is 1 for
    the very last; both ends come from one sort.  The ``rank`` of a row beyond the
    first ``k`` only orders it.  ``place`` names some of the keys by which the
    survivors are placed, so that a later window over these needs no shuffle.
    """
    totals = dict(totals or {})
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    if limit_first or not totals:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        ranked = ranked.where(F.col("rank") <= k).withColumn("rank", bigint("rank"))
        if not totals:
            return ranked
        sums = rows.groupBy(*[F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)]).agg(
            *[fold[how](expr).alias(name) for name, (how, expr) in totals.items()])
        same = [F.col(key).eqNullSafe(F.col(f"_k{i}")) for i, key in enumerate(keys)]  # a null key is a group too
        return ranked.join(sums, same).drop(*[f"_k{i}" for i in range(len(keys))])
    local, per_key = Window.partitionBy(*keys, "_split"), Window.partitionBy(*keys)
    # Ranking comes before the totals in each step: both then share one sort.
    out = rows.withColumn("_split", chunk_of() if split is None else split)
    out = out.withColumn("_rank", F.row_number().over(local.orderBy(*order)))
    out = out.withColumns({f"_{name}": fold[how](expr).over(local) for name, (how, expr) in totals.items()})
    if last:
        out = out.withColumn("_n", F.count(F.lit(1)).over(local)).where((F.col("_rank") <= k) | (F.col("_rank") > F.col("_n") - last))
    else:
        out = out.where(F.col("_rank") <= k)
    if place:
        out = out.repartition(*place)
    out = out.withColumn("rank", F.row_number().over(per_key.orderBy(*order)))

    def part(name: str, how: str) -> Column:
        # A sum enters once per split, carried by the split's first row.
        return F.when(F.col("_rank") == 1, F.col(f"_{name}")) if how == "sum" else F.col(f"_{name}")

    out = out.withColumns({name: fold[how](part(name, how)).over(per_key) for name, (how, _) in totals.items()})
    inside = F.col("rank") <= k
    if last:
        out = out.withColumn("from_end", bigint(F.count(F.lit(1)).over(per_key) - F.col("rank") + 1))
        inside = inside | (F.col("from_end") <= last)
    return (out.where(inside).withColumn("rank", bigint("rank"))
            .drop("_split", "_rank", "_n", *[f"_{name}" for name in totals]))


def whole_groups(rows: DataFrame, keys: Sequence[str], k: int, skip: Column | None = None) -> DataFrame:
    """All rows of the groups that hold at most ``k``, with ``rank`` and ``total``.

    ``k + 1`` rows tell that a group holds more, so a scan task passes on no more than
    these and nothing is counted in a pass of its own.  Groups with a row that is
    ``skip`` are left out: such rows sort first and so reach the test.
    """
    skip = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    whole = Window.partitionBy(*keys)
    first = rows.withColumn("_skip", skip).withColumn("rank", F.row_number().over(whole.orderBy(F.col("_skip").desc(), "line_no")))
    first = first.where(F.col("rank") <= k + 1)
    known = first.withColumns({"total": F.count(F.lit(1)).over(whole), "_skip": F.max("_skip").over(whole)})
    return known.where((F.col("total") <= k) & ~F.col("_skip")).withColumn("rank", bigint("rank")).drop("_skip")


def sections_of(rows: DataFrame, *parts: tuple) -> DataFrame:
    """``capture_id, section, rank, line, line_no, total`` from ``rows``, read once.

    Each part is ``(condition, section, rank, total)``; a row gives one row per part
    whose condition holds.
    """
    found = [F.when(when, F.struct(section.alias("section"), bigint(rank).alias("rank"), F.col("line"), F.col("line_no"),
                                   bigint(total).alias("total"))) for when, section, rank, total in parts]
    return rows.select("capture_id", F.inline(F.array_compact(F.array(*found))))


def tally(rows: DataFrame, keys: Sequence[str], text: str = "line") -> DataFrame:
    """Distinct ``text`` per key with repeats ``n`` and first ``line_no``."""
    return rows.groupBy(*keys, text).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))


def capped_tally(rows: DataFrame, keys: Sequence[str], k: int, text: str = "line", place: Sequence[str] = ()) -> DataFrame:
    """First ``k`` distinct texts per key by first appearance.

    ``total`` counts every row, ``n_distinct`` every distinct text,
    ``first_line_no`` is where the group begins.
    """
    return capped(tally(rows, keys, text), keys, [F.col("line_no"), F.col(text)], k,
                  {"total": ("sum", F.col("n")), "n_distinct": ("sum", F.lit(1)),
                   "first_line_no": ("min", F.col("line_no"))}, place=place)


def capped_list(rows: DataFrame, keys: Sequence[str] = ("capture_id",), k: int = 20) -> DataFrame:
    """First ``k`` rows per key by line number, with ``total`` and ``more``."""
    return capped(rows, keys, [F.col("line_no")], k, {"total": ("sum", F.lit(1))}, limit_first=True).withColumn(
        "more", bigint(F.greatest(F.lit(0), F.col("total") - k)))


def tail_lines(lines: DataFrame, k: int, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Last ``k`` lines per key; ``from_end`` is 1 for the last line."""
    return capped(lines, keys, [F.col("line_no").desc()], k).withColumnRenamed("rank", "from_end")


def carry(lines: DataFrame, marks: Mapping[str, Column], size: int | None = CHUNK) -> DataFrame:
    """Adds, per name, the value of the last non-null mark up to this line.

    A plain window over ``capture_id`` would sort a whole capture in one task.
    Here the window covers one chunk, and the value reaching a chunk from the
    earlier ones comes as a row of its own from a summary, one row per chunk.

    ``size=None`` takes the plain window: right for lines split out of cells,
    where one task held the whole capture anyway.
    """
    names = list(marks)
    if size is None:
        whole = Window.partitionBy("capture_id").orderBy("line_no").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return lines.withColumns({
            name: F.last(mark, ignorenulls=True).over(whole) for name, mark in marks.items()})
    keys = ["capture_id", "_chunk"]
    marked = lines.withColumn("_chunk", chunk_of(size=size))
    for name in names:
        marked = marked.withColumn(f"_m_{name}", marks[name])
    ends = marked.groupBy(*keys).agg(*[
        F.max_by(f"_m_{name}", F.when(F.col(f"_m_{name}").isNotNull(), F.col("line_no"))).alias(f"_e_{name}")
        for name in names])
    earlier = Window.partitionBy("capture_id").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    before = ends.select(*keys, *[
        F.last(f"_e_{name}", ignorenulls=True).over(earlier).alias(f"_m_{name}") for name in names])
    # What reaches a chunk lies as a row before its first line: lines are never a side of a join, whatever
    # size the optimizer takes them to have.
    first = (F.col("_chunk") * size - 1).cast(lines.schema["line_no"].dataType)
    inside = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carried = marked.withColumn("_line", F.lit(True)).unionByName(before.withColumn("line_no", first), allowMissingColumns=True)
    carried = carried.select("*", *[
        F.last(f"_m_{name}", ignorenulls=True).over(inside).alias(f"_c_{name}") for name in names]).where("_line")
    return carried.select(*lines.columns, *[F.col(f"_c_{name}").alias(name) for name in names])


def classed(lines: DataFrame, classes: Sequence[Column], name: str = "section") -> DataFrame:
    """One row per (line, class) for classes that are not mutually exclusive."""
    return lines.withColumn(name, F.explode(F.array_compact(F.array(*classes)))) 


#: More rows than any group has: the cap that stands for all rows.
ALL = 1 << 62


def most(*caps: int | None) -> int:
    """The largest cap; ``None`` is all rows."""
    return max(ALL if k is None else k for k in caps)


def with_caps(defaults: Mapping[str, int], caps: Mapping[str, int | None] | None) -> dict[str, int | None]:
    """The default caps with those of the caller in place; an unknown name is an error."""
    unknown = set(caps or {}) - set(defaults)
    if unknown:
        raise ValueError(f"no such caps: {sorted(unknown)}; there are {sorted(defaults)}")
    return {**defaults, **(caps or {})}


def within_caps(ranked: DataFrame, caps: Mapping[str, int | None], name: str = "section") -> DataFrame:
    """Keeps ranks inside the cap of their class; a cap of ``None`` keeps them all."""
    limit = F.lit(0).cast("bigint")
    for label, k in caps.items():
        limit = F.when(F.col(name) == label, F.lit(most(k)).cast("bigint")).otherwise(limit)
    return ranked.where(F.col("rank") <= limit)


def filled(lines: DataFrame) -> DataFrame:
    """Lines that hold more than white space."""
    return lines.where(not_blank(F.col("line")))
