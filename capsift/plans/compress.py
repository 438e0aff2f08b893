"""End to end: route captures, compact each by its strategy, account the tokens."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from capsift import rules as R
from capsift.functions.text import not_blank, savings_pct, token_estimate, tokens_of_length
from capsift.operators import cells, compact, paged, render
from capsift.operators.route import reader_of, route_strategy, strategy_of
from capsift.session import durable_dir

Strategy = Callable[[DataFrame], DataFrame]


def narrow(text: compact.Text) -> Strategy:
    """A column expression over ``raw`` and ``command`` as a strategy."""
    def apply(captures: DataFrame) -> DataFrame:
        kept = [c for c in captures.columns if c not in ("raw", "command")]
        return captures.select(*kept, text(F.col("raw"), F.col("command")).alias("filtered"))
    return apply


#: What the router chooses from; a column expression over one cell each.
NARROW: dict[str, compact.Text] = {
    "git-status": compact.git_status, "git-log": cells.git_log, "git-diff": cells.git_diff, "git-simple": compact.git_simple,
    "gradle-tasks": cells.tasks, "gradle": compact.gradle, "logcat": compact.logcat, "adb-devices": compact.adb_devices,
    "adb-install": compact.adb_install, "test": compact.test_generic, "build": compact.build, "ls": cells.ls, "find": cells.find,
    "grep": cells.grep, "docker": cells.docker, "logs": cells.logs, "json": compact.json, "generic": compact.generic,
    "passthrough": compact.passthrough,
}

#: Routed strategies that need a shuffle: none.  Strategies of a caller's own may.
GROUPED: dict[str, Strategy] = {}

#: Formats with a reader of their own, chosen by the tool or by the caller.
DEDICATED: dict[str, compact.Text] = {
    "cargo": cells.cargo, "pytest": cells.pytest, "go": cells.go, "vitest": cells.vitest, "playwright": cells.playwright,
    "tsc": cells.tsc, "lint": cells.lint, "ruff": cells.ruff, "golangci": cells.golangci, "diff": cells.diff,
    "next": compact.next_build, "prettier": compact.prettier, "npm": compact.npm, "pnpm": compact.pnpm,
    "pip": compact.pip, "prisma": compact.prisma, "docker-images": compact.docker_images,
    "kubectl": cells.kubectl, "gh": compact.gh, "curl": compact.curl, "env": compact.env,
    "summary": compact.summary, "read": compact.read, "read-head": compact.read_start,
    "read-signatures": compact.read_signatures,
}

READERS: dict[str, compact.Text] = {**NARROW, **DEDICATED}
STRATEGIES: dict[str, Strategy] = {name: narrow(text) for name, text in READERS.items()}

#: A command that was not found printed no output of its own format.
NOT_FOUND = 127


def not_found(captures: DataFrame) -> Column:
    """Whether the exit code, or the whole text, says that the command does not exist."""
    says = F.col("raw").rlike(R.NOT_FOUND_TEXT)
    return says | F.coalesce(F.col("exit_code") == NOT_FOUND, F.lit(False)) if "exit_code" in captures.columns else says


def compress_with(captures: DataFrame, strategy: str | Strategy) -> DataFrame:
    """One strategy for all captures: the path of a dedicated reader.

    Null ``raw`` is empty text.  Where the command was not found, the text is cut
    generically: no reader may call a missing tool a success.
    """
    fn = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    captures = captures.withColumn("raw", F.coalesce("raw", F.lit("")))
    missing = not_found(captures)
    kept = fn(captures.where(~missing)).select("capture_id", "filtered")
    return kept.unionByName(STRATEGIES["generic"](captures.where(missing)).select("capture_id", "filtered"))


def routed_captures(captures: DataFrame, by: str = "command") -> DataFrame:
    """``capture_id, command, raw, strategy, raw_tokens``.

    ``by="command"`` takes the router's 19 strategies; ``by="tool"`` the reader that the
    capture's ``tool`` names, else the one that belongs to its command, else the router's.
    """
    routed = route_strategy(captures.withColumn("raw", F.coalesce("raw", F.lit(""))))
    chosen = F.col("strategy")
    if by == "tool":
        named = F.when(F.col("tool").isin(*READERS), F.col("tool")) if "tool" in captures.columns else F.lit(None).cast("string")
        chosen = F.coalesce(named, reader_of(F.col("command")), chosen)
    elif by != "command":
        raise ValueError("by is 'command' or 'tool'")
    routed = routed.withColumn("strategy", F.when(not_found(routed), "generic").otherwise(chosen))
    return routed.select("capture_id", "command", "raw", "strategy", token_estimate(F.col("raw")).alias("raw_tokens"))


@lru_cache(maxsize=256)
def _text(fn: compact.Text, gateway: int) -> Column:
    """A reader's expression; putting one together takes a thousand calls to the JVM, so each is made once."""
    return fn(F.col("raw"), F.col("command"))


def narrow_texts(routed: DataFrame, texts: Mapping[str, compact.Text] = NARROW) -> DataFrame:
    """All narrow strategies in one scan: one CASE, whose taken branch alone runs."""
    text, gateway = F, id(routed.sparkSession.sparkContext._gateway)
    for name, fn in texts.items():
        text = text.when(F.col("strategy") == name, _text(fn, gateway))
    rows = routed.where(F.col("strategy").isin(*texts))
    return rows.select("capture_id", "strategy", "raw_tokens", text.alias("filtered"))


def _measured(texts: DataFrame) -> DataFrame:
    out = texts.withColumn("filtered_tokens", token_estimate(F.col("filtered")))
    return out.select("capture_id", "strategy", "filtered", "raw_tokens", "filtered_tokens",
                      savings_pct(F.col("raw_tokens"), F.col("filtered_tokens")).alias("savings_pct"))


def compress(captures: DataFrame | Mapping[str, DataFrame], extra: Mapping[str, Strategy] | None = None, by: str = "command") -> DataFrame:
    """``capture_id, strategy, filtered, raw_tokens, filtered_tokens, savings_pct``.

    ``captures`` holds ``capture_id, command, raw`` (and ``tool``, which ``by="tool"`` reads).
    All readers run in one scan without a shuffle.  ``extra`` adds strategies of the caller's
    own or puts them in place of others; each of these scans the input once more.

    Captures whose text may be larger than a cell come as line tables, see :func:`compress_lines`.
    """
    if isinstance(captures, Mapping):
        return compress_lines(captures, extra, by)
    routed, extra = routed_captures(captures, by), extra or {}
    texts = READERS if by == "tool" else NARROW
    found = narrow_texts(routed, {name: text for name, text in texts.items() if name not in extra})
    for name, strategy in extra.items():
        found = found.unionByName(strategy(routed.where(F.col("strategy") == name)).select(*found.columns))
    return _measured(found)


#: A capture beyond this many lines or characters is never put together in one cell.  While cells are put
#: together a task holds those of up to 128 captures.
CELL_LINES, CELL_CHARS = 1 << 13, 1 << 20


def captures_of(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``capture_id, command`` and exit code of line tables by command, a row per capture."""
    return _united([rows.select(*_keys(rows)).distinct().withColumn("command", F.lit(command)) for command, rows in sources.items()])


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _keys(rows: DataFrame) -> list[str]:
    return [name for name in ("capture_id", "exit_code") if name in rows.columns]


def _readers(session: SparkSession, commands: list[str], by: str) -> list[tuple[str, str | None]]:
    """Per command the reader that takes its captures, and the pages of that reader if it has any.

    Only for captures that are no JSON and have more lines than a short text.
    """
    if by not in ("command", "tool"):
        raise ValueError("by is 'command' or 'tool'")
    chosen = []
    for text in commands:
        command = F.lit(text)
        routed = strategy_of(command, F.lit("\n" * R.GENERIC_PASS))
        reader = F.coalesce(reader_of(command), routed) if by == "tool" else routed
        unsure = (reader == "generic") & F.lower(command).rlike(R.JSON_COMMAND)
        chosen.append(F.struct(reader.alias("reader"), F.when(~unsure, paged.paged_as(reader, command)).alias("pages")))
    row = session.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(chosen)]).first()
    return [(c.reader, c.pages) for c in row]


def _large(rows: DataFrame, reader: paged.Paged, cell_lines: int, cell_chars: int) -> DataFrame:
    """The captures that are read as pages, with what their lines tell, from one combining pass."""
    line = F.col("line")
    odd = F.coalesce(F.max(line.contains("\n") | F.col("line_no").isNull()), F.lit(False))
    if "exit_code" in rows.columns:
        code = F.col("exit_code")
        odd = odd | ~F.min(code).eqNullSafe(F.max(code)) | ~F.count(code).isin(0, F.count(F.lit(1))) | F.coalesce(F.max(code) == NOT_FOUND, F.lit(False))
    facts = {"n_lines": F.count("line"), "n_chars": F.sum(F.length("line")), "n_filled": F.count_if((line >= "!") | not_blank(line)),
             "n_items": reader.items() if reader.items else F.lit(0).cast("bigint")}
    known = rows.groupBy("capture_id").agg(*[fact.alias(name) for name, fact in facts.items()], odd.alias("odd"), reader.takes().alias("takes"))
    size = (F.col("n_lines") > cell_lines) | (F.col("n_chars") > cell_chars)
    kept = F.col("capture_id").isNotNull() & size & (F.col("n_filled") > R.GENERIC_PASS) & ~F.col("odd") & F.col("takes")
    return known.where(kept).select("capture_id", *facts)


def _from_pages(lines: DataFrame, large: DataFrame, command: str, strategy: str, reader: paged.Paged) -> DataFrame:
    pages = render.sized_pages(reader.page(lines, F.lit(command)))
    text, chars = F.col("filtered"), F.col("chars")
    if reader.trimmed:
        text = F.regexp_replace(text, r"\s+$", "")
        chars = F.length(text)
    if reader.heading is not None:
        heading = reader.heading(F.lit(command))
        text, chars = F.concat(heading, F.lit("\n"), text), F.length(heading) + 1 + chars
    out = large.join(pages, "capture_id", "left").select(
        "capture_id", F.lit(strategy).alias("strategy"), F.coalesce(text, F.lit(reader.empty)).alias("filtered"),
        tokens_of_length(F.col("n_chars") + F.col("n_lines") - 1).alias("raw_tokens"),
        tokens_of_length(F.coalesce(chars, F.lit(len(reader.empty)))).alias("filtered_tokens"))
    return out.withColumn("savings_pct", savings_pct(F.col("raw_tokens"), F.col("filtered_tokens")))


def compress_lines(sources: Mapping[str, DataFrame], extra: Mapping[str, Strategy] | None = None, by: str = "command",
                   cell_lines: int | None = None, cell_chars: int | None = None) -> DataFrame:
    """The rows of :func:`compress` from line tables: command -> ``capture_id, line_no, line`` (and ``exit_code``).

    A ``capture_id`` names one capture, a line without text leaves no trace.  Small captures are joined to cells.
    A larger one is read as pages (:data:`paged.PAGED`), so that no task holds its text; those whose reader has no
    pages, that a reader's pages don't take, whose command was not found or whose lines hold line ends are cells of any size.

    Which captures are large is found when this is called, by one combining pass whose rows are written and read
    again; there are no more of them than lines by ``cell_lines``, so they are broadcast.  All else is lazy.
    """
    cell_lines, cell_chars = cell_lines or CELL_LINES, cell_chars or CELL_CHARS
    extra, session = extra or {}, next(iter(sources.values())).sparkSession
    readers = _readers(session, list(sources), by)
    paging = {i: paged.PAGED[pages] for i, (strategy, pages) in enumerate(readers) if pages is not None and strategy not in extra}
    large, found = {}, []
    if paging:
        tables = list(sources.values())
        known = _united([_large(tables[i], reader, cell_lines, cell_chars).withColumn("source", F.lit(i)) for i, reader in paging.items()])
        path = f"{durable_dir(session)}/large-{uuid4().hex}"
        known.write.partitionBy("source").parquet(path)
        known = session.read.schema(known.schema).parquet(path)
        large = {row.source: known.where(F.col("source") == row.source).drop("source") for row in known.select("source").distinct().collect()}
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    small = []
    for i, (command, rows) in enumerate(sources.items()):
        if i in large:
            ids = F.broadcast(large[i].select("capture_id"))
            lines = rows.where(F.col("line").isNotNull()).select("capture_id", "line_no", "line").join(ids, "capture_id", "left_semi")
            found.append(_from_pages(lines, large[i], command, readers[i][0], paging[i]))
            rows = rows.join(ids, "capture_id", "left_anti")
        small.append(rows.withColumn("command", F.lit(command)))
    captures = _united(small)
    captures = captures.groupBy("command", *_keys(captures)).agg(joined.alias("raw"))
    return _united([compress(captures, extra, by), *found])


def with_header(compressed: DataFrame, exit_code: str = "exit_code") -> DataFrame:
    """Adds ``shown``: the text under its exit code or compression rate."""
    rate = F.format_string("[%d%% compression: %d→%d tokens]", "savings_pct", "raw_tokens", "filtered_tokens")
    header = F.when(F.col(exit_code) != 0, F.format_string("[exit: %d]", exit_code)).otherwise(rate)
    return compressed.withColumn("shown", F.concat(header, F.lit("\n"), "filtered"))
