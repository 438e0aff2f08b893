"""The usage ledger: rows to append and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, saved_share, token_estimate


def usage_columns(raw_tokens: Column, filtered_tokens: Column) -> list[Column]:
    return [raw_tokens.alias("raw_tokens"), filtered_tokens.alias("filtered_tokens"),
            F.greatest(F.lit(0).cast("bigint"), raw_tokens - filtered_tokens).alias("tokens_saved")]


def _dated(rows: DataFrame, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns to carry along; ``ts`` is one of them where the rows have it."""
    return [*(["ts"] if "ts" in rows.columns and "ts" not in keep else []), *keep]


def usage_rows(compressed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ledger rows for captures that carry ``raw`` and ``filtered`` text."""
    return compressed.select(
        F.col("capture_id").alias("id"), *_dated(compressed, keep), F.col("command").alias("raw_cmd"), "tool",
        *usage_columns(token_estimate(F.col("raw")), token_estimate(F.col("filtered"))),
        F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("block_reason"))


def capture_savings(compressed: DataFrame, captures: DataFrame) -> DataFrame:
    """Ledger rows from ``compressed`` (token counts) joined to their captures, ready to be appended."""
    about = captures.select("capture_id", *_dated(captures), "command", "tool")
    return compressed.select("capture_id", "strategy", "raw_tokens", "filtered_tokens").join(about, "capture_id").select(
        F.col("capture_id").alias("id"), *_dated(about), F.col("command").alias("raw_cmd"), "tool", "strategy",
        *usage_columns(F.col("raw_tokens"), F.col("filtered_tokens")),
        F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("block_reason"))


def beside_published(savings: DataFrame) -> DataFrame:
    """Savings per strategy with the published range and whether its lower end is reached."""
    low, high = F, F
    for name, (least, most) in R.SAVINGS_BANDS.items():
        low, high = low.when(F.col("strategy") == name, least), high.when(F.col("strategy") == name, most)
    return savings.select("*", bigint(low).alias("published_low"), bigint(high).alias("published_high"),
                          (F.col("pct") >= low).alias("reaches"))


def blocked_rows(verdicts: DataFrame, id_col: str = "command_id") -> DataFrame:
    """Zero-token ledger rows for commands the audit refused."""
    zero = F.lit(0).cast("bigint")
    return verdicts.where(~F.col("safe")).select(
        F.col(id_col).alias("id"), *_dated(verdicts), F.col("command").alias("raw_cmd"), F.lit("run").alias("tool"),
        zero.alias("raw_tokens"), zero.alias("filtered_tokens"), zero.alias("tokens_saved"),
        F.lit(True).alias("blocked"), F.col("reason").alias("block_reason"))


def recent_failures(captures: DataFrame, n: int = R.FAILURES_KEPT) -> DataFrame:
    """Raw text of the newest failed captures (top-n, no global sort)."""
    order = [F.col("ts").desc()] if "ts" in captures.columns else []
    return captures.where(F.col("exit_code") != 0).orderBy(*order, F.col("capture_id").desc()).limit(n)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    def total(name: str) -> Column:
        return bigint(F.coalesce(F.sum(name), F.lit(0)))

    return ledger.agg(
        bigint(F.count(F.lit(1))).alias("runs"), bigint(F.count_if("blocked")).alias("blocked_runs"),
        total("raw_tokens").alias("raw_tokens"), total("filtered_tokens").alias("filtered_tokens"),
        total("tokens_saved").alias("tokens_saved"),
    ).withColumn("savings_pct", saved_share(F.col("tokens_saved"), F.col("raw_tokens")))


def ledger_daily(ledger: DataFrame, days: int | None = R.LEDGER_DAYS) -> DataFrame:
    """Runs and savings per UTC date, newest first."""
    daily = ledger.groupBy(F.to_date("ts").alias("date")).agg(
        bigint(F.count(F.lit(1))).alias("runs"), bigint(F.sum("tokens_saved")).alias("tokens_saved"))
    return daily if days is None else daily.orderBy(F.col("date").desc()).limit(days)


def ledger_history(ledger: DataFrame, n: int = R.LEDGER_HISTORY) -> DataFrame:
    """The newest ``n`` runs, ties broken by id."""
    if n < 1:
        raise ValueError("n must be at least 1")
    newest = ledger.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
    return newest.select(
        "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "tool",
        bigint("tokens_saved").alias("tokens_saved"),
        saved_share(F.col("tokens_saved"), F.col("raw_tokens")).alias("pct"),
        F.substring("raw_cmd", 1, R.COMMAND_WIDTH).alias("raw_cmd"))


def ledger_by_tool(ledger: DataFrame) -> DataFrame:
    """Savings by date and tool with subtotals; null marks a rolled-up level."""
    return ledger.withColumn("date", F.to_date("ts")).rollup("date", "tool").agg(
        bigint(F.count(F.lit(1))).alias("runs"), bigint(F.sum("raw_tokens")).alias("raw_tokens"),
        bigint(F.sum("tokens_saved")).alias("tokens_saved"), F.avg("tokens_saved").alias("avg_saved"),
        bigint(F.grouping_id()).alias("level"),
    ).withColumn("pct", saved_share(F.col("tokens_saved"), F.col("raw_tokens")))


def ledger_quantiles(ledger: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate median and 90th percentile of savings per tool."""
    q = F.percentile_approx("tokens_saved", F.array(F.lit(0.5), F.lit(0.9)), accuracy)
    return ledger.groupBy("tool").agg(q.alias("q"), bigint(F.count(F.lit(1))).alias("runs")).select(
        "tool", "runs", bigint(F.col("q")[0]).alias("p50"), bigint(F.col("q")[1]).alias("p90"))


def savings_by(usage: DataFrame, *keys: str) -> DataFrame:
    """Measured token savings per key."""
    return usage.groupBy(*keys).agg(
        bigint(F.count(F.lit(1))).alias("runs"), bigint(F.sum("raw_tokens")).alias("raw_tokens"),
        bigint(F.sum("filtered_tokens")).alias("filtered_tokens"), bigint(F.sum("tokens_saved")).alias("tokens_saved"),
    ).withColumn("pct", saved_share(F.col("tokens_saved"), F.col("raw_tokens")))
