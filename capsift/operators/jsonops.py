"""JSON structure and profiles over VARIANT, without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, strip_http_headers
from capsift.operators.cut import generic_text

SCALARS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def type_of_schema(schema: Column) -> Column:
    """``object, array, string, number, boolean`` or ``null`` from a VARIANT schema."""
    out = F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array")
    for name, label in SCALARS.items():
        out = out.when(schema == name, label)
    return F.when(schema.isNotNull(), out.otherwise("number"))


def _described(rows: DataFrame, i: int) -> DataFrame:
    """Adds ``type_i`` and ``length_i`` (characters or items) of ``value_i``."""
    v, kind = F.col(f"value_{i}"), F.col(f"type_{i}")
    length = (F.when(kind == "string", F.length(F.try_variant_get(v, "$", "string")))
              .when(kind == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))))
    rows = rows.withColumn("_schema", F.schema_of_variant(v))
    rows = rows.withColumn(f"type_{i}", type_of_schema(F.col("_schema"))).drop("_schema")
    return rows.withColumn(f"length_{i}", bigint(length))


def _opened(rows: DataFrame, i: int, levels: int) -> DataFrame:
    """Level ``i + 1``: members of an object, the first item of a root array.

    An object inside an object costs two levels, an array's first item one.
    Values that stay closed keep a single row with null members.
    """
    kind, depth = F.col(f"type_{i}"), F.col(f"depth_{i}")
    root_array = (kind == "array") & F.col(f"path_{i}").rlike(r"^\$(\[0\])*$")
    is_open = (depth < levels) & ((kind == "object") | root_array)
    rows = rows.withColumn("_doc", F.when(is_open, F.col(f"value_{i}")))
    members = rows.sparkSession.tvf.variant_explode_outer(F.col("_doc").outer())
    rows = rows.lateralJoin(members).where((kind == "object") | F.col("pos").isNull() | (F.col("pos") == 0))
    step = F.when(kind == "array", "[0]").otherwise(F.concat(F.lit("."), "key"))
    rows = (rows.withColumn(f"path_{i + 1}", F.concat(f"path_{i}", step))
            .withColumn(f"depth_{i + 1}", depth + F.when(kind == "array", 1).otherwise(2))
            .withColumn(f"first_{i + 1}", F.coalesce(F.col("pos"), F.lit(0)) == 0)
            .withColumn(f"value_{i + 1}", F.col("value")))
    return _described(rows.drop("_doc", "pos", "key", "value"), i + 1)


def _parts(captures: DataFrame, keep_text: bool, levels: int = R.JSON_DEPTH) -> DataFrame:
    rows = captures.select("capture_id", "raw", F.try_parse_json("raw").alias("value_0"))
    rows = rows.withColumn("path_0", F.lit("$")).withColumn("depth_0", F.lit(0))
    rows = _described(rows, 0)
    for i in range(levels):
        rows = _opened(rows, i, levels)
    null = F.lit(None).cast("string")

    def part(i: int) -> Column:
        # A value shows on the first row of everything below it.
        shown = F.col(f"type_{i}").isNotNull()
        for j in range(i + 1, levels + 1):
            shown = shown & F.col(f"first_{j}")
        return F.when(shown, F.struct(F.col(f"path_{i}").alias("path"), F.col(f"type_{i}").alias("type"),
                                      F.col(f"length_{i}").alias("length"), null.alias("filtered")))

    parts = [part(i) for i in range(levels + 1)]
    if keep_text:
        parts.append(F.when(F.col("value_0").isNull(), F.struct(
            F.lit("$").alias("path"), F.lit("text").alias("type"), bigint(F.length("raw")).alias("length"),
            generic_text(F.col("raw")).alias("filtered"))))
    return rows.select("capture_id", F.inline(F.array_compact(F.array(*parts))))


def json_structure(captures: DataFrame, levels: int = R.JSON_DEPTH) -> DataFrame:
    """``path, type, length`` of every part down to ``levels`` levels.

    One pass over the input, no shuffle.  Values are never shown; captures that
    are no JSON give no row.
    """
    return _parts(captures, False, levels).drop("filtered")


def json_profile(structure: DataFrame) -> DataFrame:
    """Per path and type over all captures: presence and length range."""
    return structure.groupBy("path", "type").agg(
        bigint(F.count(F.lit(1))).alias("n"), bigint(F.min("length")).alias("min_length"),
        bigint(F.max("length")).alias("max_length"))


def json_schema(captures: DataFrame, *keys: str) -> DataFrame:
    """The schema that all JSON texts (of a key) have in common, merged by the aggregate, and their number.

    Members add up, numbers widen; partial schemas combine before the shuffle.  Texts that are
    no JSON do not count; without any the schema is ``VOID``.
    """
    rows = captures.select(*keys, F.try_parse_json("raw").alias("value"))
    return rows.groupBy(*keys).agg(F.schema_of_variant_agg("value").alias("schema"), bigint(F.count("value")).alias("n"))


def json_or_text(captures: DataFrame) -> DataFrame:
    """Response bodies: JSON as its structure, any other text as its generic cut."""
    return _parts(captures.withColumn("raw", strip_http_headers(F.col("raw"))), keep_text=True)
