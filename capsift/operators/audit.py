"""Audit of command logs: allowlist, shell metacharacters, path traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, trim_ws


def prefix_of(command: Column) -> Column:
    return F.regexp_extract(trim_ws(command), r"^(\S+)", 1)


def audit_allowlist(commands: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Adds ``prefix`` and ``allowed``.

    The built-in list is a fixed set of literals, tested inside the scan.  An
    ``allowed`` table (column ``prefix``) is joined; Spark broadcasts it only
    when its measured size permits.
    """
    rows = commands.withColumn("prefix", prefix_of(F.col("command")))
    if allowed is None:
        return rows.withColumn("allowed", F.col("prefix").isin(*R.ALLOWED_PREFIXES))
    marked = allowed.select("prefix").distinct().withColumn("_hit", F.lit(True))
    return (rows.join(marked, "prefix", "left")
            .withColumn("allowed", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def shell_token(text: Column) -> Column:
    """First shell metacharacter outside quotes, or the empty string."""
    bare = F.regexp_replace(text, R.QUOTED_SPAN, "\x01")
    return F.regexp_extract(bare, R.SHELL_TOKEN, 1)


def _by_token(token: Column, index: int) -> Column:
    out = F
    for mark, entry in R.SHELL_RULES.items():
        out = out.when(token == mark, entry[index])
    return out


def metachar_columns(text: Column) -> dict[str, Column]:
    """``safe, rule, reason`` plus two signals the verdict ignores."""
    token = shell_token(text)
    spans = F.regexp_extract_all(text, F.lit(R.QUOTED_SPAN), F.lit(0))

    def substitutes(span: Column) -> Column:
        plain = F.regexp_replace(span, r"\\[\s\S]", "")
        return span.startswith('"') & (plain.contains("$(") | plain.contains("`"))

    return {"safe": token == "", "rule": _by_token(token, 0), "reason": _by_token(token, 1),
            "substitution_in_quotes": F.exists(spans, substitutes),
            "bare_newline": F.regexp_replace(text, R.QUOTED_SPAN, "\x01").contains("\n")}


def audit_metachars(commands: DataFrame, text: str = "command") -> DataFrame:
    return commands.withColumns(metachar_columns(F.col(text)))


def audit_path(paths: DataFrame) -> DataFrame:
    """Path traversal, plain or percent-encoded; bad escapes are unsafe."""
    path = F.col("path")
    decoded = F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))
    rule = (F.when(decoded.isNull(), "malformed")
            .when(decoded.contains("../") | decoded.contains("/.."), "traversal")
            .when(path.rlike("(?i)%2e%2e"), "encoded_traversal"))
    return (paths.withColumn("decoded", decoded).withColumn("rule", rule)
            .withColumn("safe", F.col("rule").isNull()))


def audit_commands(commands: DataFrame) -> DataFrame:
    """The combined gate: allowlist on the command, metacharacters on its arguments."""
    at = F.instr("command", " ")
    args = F.when(at > 0, F.substring(F.col("command"), at + 1, F.length("command"))).otherwise("")
    rows = audit_allowlist(commands).withColumns(metachar_columns(args))
    denied = ~F.col("allowed")
    reason = F.when(denied, F.concat(F.lit("command not in allowlist: '"), "prefix", F.lit("'"))).otherwise(F.col("reason"))
    return (rows.withColumn("reason", reason)
            .withColumn("rule", F.when(denied, "allowlist").otherwise(F.col("rule")))
            .withColumn("safe", ~denied & F.col("safe")))


def audit_rule_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.coalesce("rule", F.lit("ok")).alias("rule")).agg(
        bigint(F.count(F.lit(1))).alias("n"), bigint(F.count_distinct("prefix")).alias("n_prefixes"))
