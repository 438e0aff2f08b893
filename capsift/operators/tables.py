"""Rows out of white-space aligned tables printed by command-line tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, first_chars, trim_ws
from capsift.operators.lines import filled

#: Kinds whose first line is a column header.
WITH_HEADER = ("docker_ps", "docker_images", "kubectl")


def table_rows(lines: DataFrame) -> DataFrame:
    """``name, status, text`` per row by its ``kind``; narrow, no shuffle.

    A header is line 0, and any line that reads like the kind's header: behind blank
    lines, or before a further table in the same text.
    """
    line, kind = F.col("line"), F.col("kind")
    wide = F.split(line, r"\s{2,}", -1)
    words = F.split(trim_ws(line), r"\s+", -1)
    tabs = F.split(line, "\t", -1)
    n_wide, n_words, n_tabs = F.size(wide), F.size(words), F.size(tabs)

    def at(parts, i):
        return F.get(parts, F.lit(i))

    header = kind.isin(*WITH_HEADER) & (F.col("line_no") == 0)
    for name, pattern in R.TABLE_HEADERS.items():
        header = header | ((kind == name) & line.rlike(pattern))
    rows = filled(lines).where(~header)
    rows = rows.where(~((kind == "adb_devices") & line.startswith("List of")))
    ps, images = (kind == "docker_ps") & (n_wide >= 5), (kind == "docker_images") & (n_wide >= 3)
    pods, gh = (kind == "kubectl") & (n_words >= 3), (kind == "gh") & (n_tabs >= 3)
    device = (kind == "adb_devices") & (n_tabs >= 2)
    ps_status = F.when(at(wide, 4) != "", at(wide, 4)).otherwise(at(wide, 3))
    image = F.concat(at(wide, 0), F.lit(":"), at(wide, 1))
    image_size = F.coalesce(at(wide, 6), at(wide, 4), F.lit(""))
    last = F.element_at(wide, -1)
    text = (F.when(ps, F.concat_ws(" ", first_chars(at(wide, 0), 12), at(wide, 1),
                                   F.concat(F.lit("["), ps_status, F.lit("]")), last))
            .when(images, F.concat_ws(" ", image, image_size))
            .when(pods, F.array_join(F.slice(words, 1, 5), " "))
            .when(gh, F.array_join(F.transform(F.slice(tabs, 1, 4), trim_ws), "  "))
            .when(device, F.concat(at(tabs, 0), F.lit(" ["), trim_ws(at(tabs, 1)), F.lit("]")))
            .when(kind == "gh", first_chars(trim_ws(line), 120)).otherwise(trim_ws(line)))
    name = (F.when(ps, last).when(images, image).when(pods, at(words, 0))
            .when(gh, trim_ws(at(tabs, 0))).when(device, at(tabs, 0)))
    status = (F.when(ps, ps_status).when(images, image_size).when(pods, at(words, 2))
              .when(gh, trim_ws(at(tabs, 2))).when(device, trim_ws(at(tabs, 1))))
    return rows.select("capture_id", "line_no", "kind", name.alias("name"),
                       status.alias("status"), text.alias("text"))


def table_status_counts(rows: DataFrame) -> DataFrame:
    """Rows per kind and status over the whole table."""
    return rows.groupBy("kind", "status").agg(
        bigint(F.count(F.lit(1))).alias("n"), bigint(F.count("name")).alias("n_parsed"))
