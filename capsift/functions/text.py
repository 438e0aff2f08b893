"""Scalar helpers over strings, written as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from capsift import rules as R

WHITESPACE = " \t\n\r\f\x0b"


def bigint(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def trim_ws(col: Column) -> Column:
    """Strip ASCII white space; plain ``trim`` would strip spaces only."""
    return F.btrim(col, F.lit(WHITESPACE))


def not_blank(col: Column) -> Column:
    return F.length(trim_ws(col)) > 0


def first_chars(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def truncate_line(col: Column, width: int = R.LINE_WIDTH) -> Column:
    return F.when(F.length(col) <= width, col).otherwise(
        F.concat(first_chars(col, width - 3), F.lit("...")))


def snippet(col: Column, pattern: str | Column | None = None, width: int = R.SNIPPET_WIDTH) -> Column:
    """A window of ``width`` characters around the literal ``pattern``."""
    text = trim_ws(col)
    size = F.length(text)
    head = F.concat(first_chars(text, width - 3), F.lit("..."))
    if pattern is None or isinstance(pattern, str) and not pattern:
        return F.when(size <= width, text).otherwise(head)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = F.instr(F.lower(text), F.lower(pattern)) - 1
    start = F.greatest(F.lit(0), hit - width // 3)
    end = F.least(size, start + width)
    start = F.when(end == size, F.greatest(F.lit(0), end - width)).otherwise(start)
    window = F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when((start == 0) | (end < size), "...").otherwise(""))
    return F.when(size <= width, text).when((hit >= 0) & (pattern != ""), window).otherwise(head)


def compact_path(col: Column) -> Column:
    parts = F.split(col, "/", -1)
    short = F.concat(F.element_at(parts, 1), F.lit("/.../"),
                     F.array_join(F.slice(parts, -2, 2), "/"))
    return F.when((F.length(col) > R.PATH_WIDTH) & (F.size(parts) > 3), short).otherwise(col)


def human_size(col: Column) -> Column:
    return (F.when(col >= 1048576, F.format_string("%.1fM", col / 1048576))
            .when(col >= 1024, F.format_string("%.1fK", col / 1024))
            .otherwise(F.concat(col.cast("string"), F.lit("B"))))


def token_estimate(col: Column) -> Column:
    return tokens_of_length(F.length(col))


def tokens_of_length(length: Column) -> Column:
    return bigint(F.ceil(length / R.CHARS_PER_TOKEN))


def savings_pct(before: Column, after: Column) -> Column:
    """Percent saved, may be negative; halves round up."""
    return bigint(F.when(before > 0, F.floor((1 - after / before) * 100 + 0.5)).otherwise(0))


def saved_share(saved: Column, raw: Column) -> Column:
    """Percent of ``raw`` that the clamped ``saved`` makes up."""
    return bigint(F.when(raw > 0, F.floor(saved / raw * 100 + 0.5)).otherwise(0))


def normalize_log_line(col: Column) -> Column:
    """The template of a log line; the order of the steps matters.

    Two patterns can only match next to a fixed text, so a plain search for it
    spares most lines the regex.
    """
    out = F.regexp_replace(col, R.LOG_TIMESTAMP, "")
    for pattern, mark, hint in ((R.LOG_UUID, "<UUID>", r"-[0-9a-fA-F]{4}-"), (R.LOG_HEX, "<HEX>", None),
                                (R.LOG_NUMBER, "<NUM>", None), (R.LOG_PATH, "<PATH>", None)):
        replaced = F.regexp_replace(out, pattern, mark)
        out = replaced if hint is None else F.when(col.rlike(hint), replaced).otherwise(out)
    return trim_ws(out)


def groups(col: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of a whole-line pattern in one match; null without a match.

    The separator cannot occur in the result by chance: a line that holds it
    already is told apart by its number of parts.
    """
    marks = "".join(f"\x01${i}" for i in range(1, n + 1))
    parts = F.split(F.regexp_replace(col, pattern, marks), "\x01", -1)
    return F.when(F.size(parts) == n + 1, parts)


def strip_http_headers(col: Column) -> Column:
    return F.when(col.startswith("HTTP/"),
                  F.regexp_replace(col, r"(?s)^HTTP/.*?\r?\n\r?\n", "")).otherwise(col)


def epoch_date(col: Column) -> Column:
    """UTC date of epoch milliseconds (session time zone is pinned to UTC)."""
    return F.to_date(F.timestamp_millis(col))


def line_count(col: Column) -> Column:
    """Number of newline-separated lines, without building the array."""
    return bigint(F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1)


def contains_any(col: Column, *words: str) -> Column:
    out = col.contains(words[0])
    for word in words[1:]:
        out = out | col.contains(word)
    return out


def number_in(col: Column, pattern: str) -> Column:
    """First integer captured by ``pattern``, or null."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).cast("bigint")
