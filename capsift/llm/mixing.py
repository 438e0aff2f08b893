"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every row gets a random key from the hash of its id.  Within a source the keys are
cut into equal ranges; the sizes of the ranges are summed where the rows are, and a
prefix sum over the (few) ranges tells in which one a source's budget ends.  Only
the rows of that range are sorted to find the row at which it ends.  So no source,
however large, is ever sorted or gathered as a whole.

Defined cases: a null text has size 0; null is a source of its own, ordered last; a
null id is hashed as the empty text; rows that share id and size are interchangeable
and share the words that are left where the cut meets them; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsift.llm.common import packed, scratch, stored, unpacked

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Hexadecimal digits of the key that name a range: 3 make 4,096 ranges per source.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` -> the same with ``target``; one row per source.

    The total is shared by weight; a source stops at ``max_epochs`` times its size and
    its excess is shared again.  Sources sorted by cap per weight fill up in that
    order, so the water level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0))).cast("double") / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    rising = weighed.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") < F.col("level"))
    surface = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return rising.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * surface).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, taken``.

    ``taken`` counts words: whole epochs of the source, plus the row's words where the
    last, partial epoch reaches it.  The row at the cut gives only what is left.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    measured = stored(docs.select("source", random_key(F.col("doc_id")).alias("key"), n_words(F.col("text")).alias("size")), folder, "sizes")
    measured = measured.withColumn("bucket", F.substring("key", 1, RANGE_DIGITS))
    sums = stored(measured.groupBy("source", "bucket").agg(F.sum("size").alias("size")), folder, "ranges")
    plan = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(plan.withColumn("epochs", epochs).withColumn("rest", words - F.col("epochs") * F.col("source_size")), folder, "plan")

    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("before", before)
    cut_range = ranges.join(plan.withColumnRenamed("source", "s"), ranges["source"].eqNullSafe(F.col("s"))).filter(
        (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size"))).select(
        F.col("s"), F.col("bucket").alias("cut_bucket"), (F.col("rest") - F.col("before")).alias("left"))
    inside = measured.join(cut_range, measured["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("cut_bucket")))
    units = inside.groupBy("source", "key", "size").agg(F.count("*").alias("n"), F.first("left").alias("left"))
    unit_words = F.col("size") * F.col("n")
    ahead = F.coalesce(F.sum(unit_words).over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    cut_row = units.withColumn("ahead", ahead).filter((F.col("ahead") <= F.col("left")) & (F.col("left") < F.col("ahead") + unit_words)).select(
        "source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"),
        F.floor((F.col("left") - F.col("ahead")) / F.col("n")).cast("long").alias("cut_words"))
    cuts = stored(plan.join(cut_row.withColumnRenamed("source", "s"), plan["source"].eqNullSafe(F.col("s")), "left").drop("s"), folder, "cuts")

    rows = packed(docs, key=random_key(F.col("doc_id")), size=n_words(F.col("text")))
    joined = rows.join(cuts, F.col("doc.source").eqNullSafe(cuts["source"]), "left")
    position, cut = F.struct("key", "size"), F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    partial = (F.when(F.col("cut_key").isNull(), 0).when(position < cut, F.col("size"))
               .when(position == cut, F.col("cut_words")).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + partial).cast("long")
    return unpacked(joined.withColumn("taken", taken), docs.columns, "size", "source_size", "target", "taken")


ORACLE = r"""
with m as (select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as key,
  cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
s as (select source, sum(size) as source_size from m group by source),
w as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight, source_size * 3 as cap from s),
l as (select *, cast((sum(source_size) over ()) - coalesce(sum(cap) over p, 0) as double)
    / ((sum(weight) over ()) - coalesce(sum(weight) over p, 0)) as level
  from w window p as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when cap / weight < level then cast(cap as double)
    else weight * (select max(level) from l where not cap / weight < level) end as target from l),
e as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from t),
r as (select *, cast(floor(target) as bigint) - epochs * source_size as rest from e),
u as (select source, key, size, count(*) as n from m group by all),
a as (select *, coalesce(sum(size * n) over (partition by source order by key, size rows between unbounded preceding and 1 preceding), 0) as ahead from u)
select m.doc_id, m.size, cast(r.source_size as bigint) as source_size, r.target,
  cast(r.epochs * m.size + case when a.ahead + a.size * a.n <= r.rest then m.size when a.ahead <= r.rest then floor((r.rest - a.ahead) / a.n) else 0 end as bigint) as taken
from m join r on m.source is not distinct from r.source
join a on a.source is not distinct from m.source and a.key = m.key and a.size = m.size
"""
