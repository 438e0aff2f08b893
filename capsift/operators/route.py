"""Which strategy or handler a command belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import line_count, trim_ws


def strategy_of(command: Column, raw: Column) -> Column:
    """First matching route; ``json`` only when the output parses as JSON."""
    return strategy_of_normal(F.lower(trim_ws(command)), raw)


def strategy_of_normal(cmd: Column, raw: Column) -> Column:
    """The same for a command that is trimmed and in lower case already."""
    out = F
    for label, pattern in R.ROUTES:
        out = out.when(cmd.rlike(pattern), label)
    is_json = cmd.rlike(R.JSON_COMMAND) & F.try_parse_json(raw).isNotNull()
    return out.when(is_json, "json").when(line_count(raw) > R.GENERIC_PASS, "generic").otherwise("passthrough")


def route_strategy(captures: DataFrame) -> DataFrame:
    """Adds ``strategy``; narrow, the rules fold into one CASE expression."""
    rows = captures.withColumn("_cmd", F.lower(trim_ws(F.col("command"))))
    return rows.withColumn("strategy", strategy_of_normal(F.col("_cmd"), F.coalesce("raw", F.lit("")))).drop("_cmd")


def reader_of(command: Column) -> Column:
    """The reader that belongs to the tool a command runs; null where none does."""
    cmd, out = trim_ws(command), F
    for reader, pattern in R.TOOL_READERS:
        out = out.when(cmd.rlike(pattern), reader)
    return out


def route_tool(commands: DataFrame) -> DataFrame:
    """Dedicated handler of a shell command with its remaining arguments.

    ``rest`` holds the search pattern for ``grep`` (its path goes to ``path``);
    both are null when no handler takes the command.
    """
    cmd = trim_ws(F.col("command"))
    tool, rest = F, F
    for label, pattern, prefix in R.HANDLERS:
        hit = cmd.rlike(pattern)
        tool = tool.when(hit, label)
        if label == "grep":
            value = F.regexp_extract(cmd, R.GREP_ARGS, 1)
        elif label == "ls":
            left = F.regexp_replace(cmd, prefix, "")
            value = F.when(left == "", ".").otherwise(left)
        else:
            value = F.regexp_replace(cmd, prefix, "") if prefix else cmd
        rest = rest.when(hit, value)
    routed = commands.withColumn("tool", tool).withColumn("rest", rest)
    return routed.withColumn("path", F.when(F.col("tool") == "grep", F.regexp_extract(cmd, R.GREP_ARGS, 2)))


def extract_search_pattern(commands: DataFrame) -> DataFrame:
    """The pattern argument of grep, rg and ag commands."""
    cmd = F.lower(trim_ws(F.col("command")))
    grep = dict(R.ROUTES)["grep"]
    return commands.where(cmd.rlike(grep)).withColumn(
        "pattern", F.regexp_extract(cmd, R.SEARCH_PATTERN, 1))
