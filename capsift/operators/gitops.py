"""Version-control output: status, history, diffs and one-line outcomes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from capsift import rules as R
from capsift.functions.text import bigint, first_chars, not_blank, number_in, trim_ws, truncate_line
from capsift.operators.compact import _let
from capsift.operators.lines import ALL, CHUNK, capped, carry, chunk_of, classed, most, with_caps, within_caps


def status_summary(lines: DataFrame, caps: Mapping[str, int | None] | None = None) -> DataFrame:
    """Porcelain status by section: counts and the first files of each.

    A file may be in two sections.  Conflicts are one row with their number; a cap for
    ``conflict`` lists their files.  ``caps`` replaces the default caps by section,
    ``None`` for all rows.
    """
    listed_conflicts = "conflict" in (caps or {})
    caps = with_caps(R.STATUS_CAPS, caps)
    line = F.col("line")
    x, y, pair = F.substring(line, 1, 1), F.substring(line, 2, 1), F.substring(line, 1, 2)
    branch, untracked = line.startswith("##"), pair == "??"
    entry = ~branch & ~untracked
    rows = classed(lines.where(line.rlike(R.STATUS_LINE)), [
        F.when(branch, "branch"), F.when(untracked, "untracked"),
        F.when(entry & x.isin(*"MADRC"), "staged"), F.when(entry & y.isin(*"MD"), "modified"),
        F.when(entry & pair.isin(*R.STATUS_CONFLICTS), "conflict")])
    rows = rows.withColumn("file", F.substring(line, F.lit(4), F.length(line)))
    listed = within_caps(
        capped(rows, ["capture_id", "section"], [F.col("line_no")], most(*caps.values()),
               {"total": ("sum", F.lit(1))}, limit_first=True), caps)
    file = (F.when(F.col("section") == "branch", trim_ws(F.col("file")))
            .when((F.col("section") != "conflict") | F.lit(listed_conflicts), F.col("file")).otherwise(""))
    return listed.select("capture_id", "section", "rank", file.alias("file"), bigint("total").alias("total"))


def commit_blocks(captures: DataFrame) -> DataFrame:
    """History split at its end-of-commit marker; narrow."""
    blocks = captures.where(F.col("raw").contains(R.LOG_BLOCK_END)).select(
        "capture_id", F.posexplode(F.split("raw", R.LOG_BLOCK_END, -1)).alias("line_no", "block"))
    return blocks.withColumn("line_no", bigint("line_no"))


def commit_log(blocks: DataFrame) -> DataFrame:
    """Header and first body line that is no trailer, per commit; narrow."""
    lines = F.split(trim_ws(F.col("block")), "\n", -1)
    body = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), trim_ws),
                    lambda s: (F.length(s) > 0) & ~s.rlike(R.LOG_TRAILER))
    return blocks.where(not_blank(F.col("block"))).select(
        "capture_id", "line_no", truncate_line(trim_ws(F.element_at(lines, 1))).alias("header"),
        truncate_line(F.get(body, F.lit(0))).alias("body"))


def commit_log_verbose(lines: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Plain history: short hash and subject per commit.

    Only lines that begin a commit, or can be its subject, are shuffled, as the text they can show:
    of a subject or one-line commit no more than tells whether it is too long.  The test names the line once,
    as in ``diff_stat``; by their beginnings the three kinds of lines are then told apart.
    """
    line = F.col("line")
    kind = F.when(line.startswith("    "), "subject").when(line.startswith("commit"), "full").otherwise("oneline")
    oneline = F.concat(first_chars(F.regexp_extract(line, R.LOG_ONELINE, 1), 7), F.lit(" "), F.regexp_extract(line, R.LOG_ONELINE, 2))
    shown = lambda text: first_chars(text, R.LINE_WIDTH + 1)
    text = (F.when(line.startswith("    "), shown(trim_ws(line)))
            .when(line.startswith("commit"), first_chars(F.regexp_extract(line, R.LOG_COMMIT, 1), 7)).otherwise(shown(oneline)))
    events = lines.where(line.rlike(R.LOG_EVENT)).select("capture_id", "line_no", kind.alias("kind"), text.alias("text"))
    text, of = F.col("text"), lambda kind: F.col("kind") == kind
    rows = carry(events, {"commit_line": F.when(~of("subject"), F.col("line_no"))}, chunk)
    commits = rows.where(F.col("commit_line").isNotNull()).groupBy("capture_id", "commit_line").agg(
        F.max(F.when(of("full"), text)).alias("full_hash"), F.max(F.when(of("oneline"), text)).alias("oneline"),
        F.min_by(text, F.when(of("subject"), F.col("line_no"))).alias("subject"))
    text = F.coalesce("oneline", F.concat_ws(" ", "full_hash", "subject"))
    return commits.select("capture_id", bigint("commit_line").alias("line_no"),
                          truncate_line(text).alias("commit"))


# --- diffs --------------------------------------------------------------------


_NEVER = 1 << 62

#: What a line of a diff can be, by its first characters; any other line is 0.
_GIT, _HUNK, _OLD, _NEW, _PLUS, _MINUS = range(1, 7)


def _kind(line: Column) -> Column:
    starts = {_GIT: "diff --git", _HUNK: "@@", _OLD: "--- ", _NEW: "+++ ", _PLUS: "+", _MINUS: "-"}
    kind = F
    for value, start in starts.items():
        kind = kind.when(line.startswith(start), value)
    return kind.otherwise(0)


def _file_name(line: Column) -> Column:
    git = F.coalesce(F.get(F.split(line, " b/", -1), F.lit(1)), F.lit("unknown"))
    path = F.split(F.substring(line, F.lit(5), F.length(line)), "\t", -1)[0]
    return F.when(line.startswith("diff --git"), git).otherwise(F.regexp_replace(path, "^b/", ""))


def _chunk_borders(rows: DataFrame, plain: bool, size: int, hunk_cap: int = 0) -> DataFrame:
    """What each chunk of a diff needs to know of its neighbours as ``before``, one row per chunk.

    One pass gives each chunk's first and last marks; for diffs made without git also the
    numbers of its ``---`` and ``+++`` lines, at most a chunk's.  Which of the ``+++`` lines is the
    chunk's last header depends on what came before: both answers are worked out, and windows
    over the chunks of a capture choose.  With ``hunk_cap`` also how many headers the earlier chunks show
    at least: of one line number no more than the cap are shown, so no more count per chunk.
    """
    kind, no, chunk = F.col("kind"), F.col("line_no"), F.col("_chunk")
    git, hunk, old, new = (kind == value for value in (_GIT, _HUNK, _OLD, _NEW))
    header = F.struct(no.alias("at"), F.col("name"))
    sums = {
        "first_git": F.min(F.when(git, no)), "last_git": F.max_by(header, F.when(git, no)),
        "first_hunk": F.min(F.when(hunk, no)), "last_hunk": F.max(F.when(hunk, no)),
        "last_change": F.max(F.when(kind >= _OLD, no)),
        "n_git": F.count(F.when(git, 1)), "n_hunk": F.count(F.when(hunk, 1))}
    if plain:
        sums |= {"olds": F.collect_list(F.when(old, no)), "news": F.collect_list(F.when(new, header)),
                 "begins_new": F.max((no == chunk * size) & new), "ends_old": F.max((no == chunk * size + size - 1) & old)}
    ends = rows.groupBy("capture_id", "_chunk").agg(*[value.alias(name) for name, value in sums.items()])
    none = F.lit(None).cast("struct<at:bigint,name:string>")
    if plain:
        numbers = F.transform("news", lambda x: x["at"])
        before_git = F.coalesce("first_git", F.lit(_NEVER))
        paired = F.array_max(F.filter(F.array_intersect(numbers, F.transform("olds", lambda x: x + 1)), lambda n: n < before_git))
        early = F.array_max(F.filter(numbers, lambda n: n < F.least(before_git, F.coalesce("first_hunk", F.lit(_NEVER)))))
        first = F.when(F.col("begins_new"), chunk * size)
        named = lambda at: F.get(F.filter("news", lambda x: x["at"] == at), F.lit(0))

        def last_headers(paired: Column, early: Column) -> Column:
            return F.struct(named(paired).alias("late"), named(F.coalesce(paired, first)).alias("late_after_old"),
                            named(F.greatest(paired, early)).alias("early"))

        # Found before the search, else each of the numbers would be looked for anew at every line.
        ends = ends.withColumn("last_headers", _let(last_headers, paired=paired, early=early))
    chunks = Window.partitionBy("capture_id").orderBy("_chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda name: F.coalesce(F.max(F.col(name).isNotNull()).over(earlier), F.lit(False))
    beside = lambda fn, name, step: F.coalesce(fn(name).over(chunks) & (fn("_chunk").over(chunks) == chunk + step), F.lit(False))
    ends = ends.withColumns({
        "git_before": seen("first_git"), "hunk_before": seen("first_hunk"),
        "old_before": beside(F.lag, "ends_old", -1) if plain else F.lit(False),
        "new_after": beside(F.lead, "begins_new", 1) if plain else F.lit(False)})
    file_end = F.when(F.col("first_git").isNotNull(), F.col("last_git"))
    if plain:
        file_end = (file_end.when(F.col("git_before"), none).when(~F.col("hunk_before"), F.col("last_headers.early"))
                    .when(F.col("old_before"), F.col("last_headers.late_after_old")).otherwise(F.col("last_headers.late")))
    ends = ends.withColumn("file_end", file_end)
    at = F.greatest("file_end.at", "last_hunk")
    mark_end = F.when(at.isNotNull(), F.struct(at.alias("at"), F.coalesce(at == F.col("last_hunk"), F.lit(False)).alias("in_hunk")))
    ends = ends.withColumn("mark_end", mark_end)
    carried = {"file": "file_end", "mark": "mark_end", "change_at": "last_change"}
    ends = ends.withColumns({f"{name}_before": F.last(end, ignorenulls=True).over(earlier) for name, end in carried.items()})
    # Every git line is a header, and every hunk of a file that is known by then is shown.
    headers = F.col("n_git") + F.when(F.col("file_before").isNotNull(), F.col("n_hunk")).otherwise(0)
    shown_before = F.sum(F.least(headers, F.lit(hunk_cap))).over(earlier)
    return ends.select("capture_id", "_chunk", F.struct(
        "git_before", "hunk_before", "old_before", "new_after", *[F.col(f"{name}_before").alias(name) for name in carried],
        shown_before.alias("shown_before")).alias("before"))


def _diff_state(lines: DataFrame, plain: bool, chunk: int | None, texts: bool = False, hunk_cap: int = 0) -> DataFrame:
    """Each diff line with its file and hunk, carried from the last header.

    Inside a hunk ``---`` and ``+++`` are removed and added text, not headers.  In diffs without
    ``diff --git`` any ``+++`` line before the first hunk is a header, later only one right after
    a ``---`` line, which then is the old name and no removed text.  What comes from earlier chunks
    lies as a row before the chunk's first line, so lines are never a side of a join.

    Lines are dealt out by chunk and sorted as they are, or without ``texts`` as kind and name alone;
    whatever follows from the text is worked out behind that.
    """
    kind, no = F.col("kind"), F.col("line_no")
    git, hunk, old, new = (kind == value for value in (_GIT, _HUNK, _OLD, _NEW))
    keys = ["capture_id", "_chunk"]
    name = _file_name(F.col("line"))
    rows = lines.select("capture_id", bigint("line_no").alias("line_no"), "line",
                        (bigint(F.lit(0)) if chunk is None else chunk_of(size=chunk)).alias("_chunk"))
    marked = rows.withColumn("kind", _kind(F.col("line")))
    marked = marked.withColumn("name", F.when(git | new if plain else git, name)).drop("line")
    size = chunk or _NEVER
    inside = Window.partitionBy(*keys).orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if chunk is None:
        before = F.lit(None).cast("struct<git_before:boolean,hunk_before:boolean,old_before:boolean,new_after:boolean,"
                                  "file:struct<at:bigint,name:string>,mark:struct<at:bigint,in_hunk:boolean>,change_at:bigint,"
                                  "shown_before:bigint>")
        rows = (rows if texts else marked).withColumn("before", before)
    else:
        borders = _chunk_borders(marked, plain, chunk, hunk_cap).withColumn("line_no", F.col("_chunk") * chunk - 1)
        rows = (rows if texts else marked).unionByName(borders, allowMissingColumns=True)
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "line_no")
    if texts:
        rows = rows.withColumn("kind", F.when(F.col("before").isNull(), _kind(F.col("line"))))
        rows = rows.withColumn("name", F.when(git | new if plain else git, name))
    header = git
    if plain:
        known = lambda name: F.coalesce(F.first(F.col("before")[name]).over(upto), F.lit(False))
        beside = lambda fn, test, step: fn(test).over(inside) & (fn(no).over(inside) == no + step)
        rows = rows.withColumns({
            "_git": known("git_before") | F.coalesce(F.max(git).over(upto), F.lit(False)),
            "_hunk": known("hunk_before") | F.coalesce(F.max(hunk).over(upto), F.lit(False)),
            "_after_old": F.coalesce(beside(F.lag, old, -1), known("old_before") & (no == F.col("_chunk") * size)),
            "_before_new": F.coalesce(beside(F.lead, new, 1), known("new_after") & (no == F.col("_chunk") * size + size - 1))})
        loose = ~F.col("_git")
        rows = rows.where(~F.coalesce(loose & old & F.col("_hunk") & F.col("_before_new"), F.lit(False)))
        header = git | (loose & new & (~F.col("_hunk") | F.col("_after_old")))
    rows = rows.withColumn("is_header", F.coalesce(header, F.lit(False)))
    starts = F.col("is_header")

    def carried(name: str, value: Column) -> Column:
        return F.last(F.coalesce(value, F.col("before")[name]), ignorenulls=True).over(upto)

    rows = rows.withColumns({
        "file": carried("file", F.when(starts, F.struct(no.alias("at"), F.col("name")))),
        "mark": carried("mark", F.when(starts | hunk, F.struct(no.alias("at"), (hunk & ~starts).alias("in_hunk")))),
        "change_at": carried("change_at", F.when(kind >= _OLD, no)),
        "shown_before": carried("shown_before", F.lit(None).cast("bigint"))})
    return rows.where(kind.isNotNull() & F.col("file").isNotNull()).select(
        "capture_id", "_chunk", "line_no", *(["line", "shown_before"] if texts else []), "kind", "is_header", hunk.alias("is_hunk"),
        F.col("file.at").alias("file_at"), F.col("file.name").alias("file"),
        F.col("mark.at").alias("mark_at"), (F.col("mark.in_hunk") & ~hunk).alias("in_hunk"),
        F.coalesce(F.col("change_at") > F.col("mark.at"), F.lit(False)).alias("after_change"))


def diff_stat(lines: DataFrame, plain: bool = True, chunk: int | None = CHUNK) -> DataFrame:
    """Added and removed lines per file, over the whole capture.

    ``plain=False`` looks for no headers of diffs made without git.
    """
    # Context counts for nothing here, and of the other lines no text but names is needed.  The test names
    # the line once: it is put in the place of a line's expression, which may be long.
    rows = _diff_state(lines.where(F.substring("line", 1, 1).isin("d", "@", "+", "-")), plain, chunk)
    kind = F.col("kind")
    return rows.groupBy("capture_id", "file_at", "file").agg(
        bigint(F.count_if(F.col("in_hunk") & kind.isin(_NEW, _PLUS))).alias("added"),
        bigint(F.count_if(F.col("in_hunk") & kind.isin(_OLD, _MINUS))).alias("removed"),
        bigint(F.count_if(F.col("is_hunk"))).alias("hunks")).withColumn("file_at", bigint("file_at"))


def _page_rows(rows: DataFrame, hunk_cap: int, cap: int, size: int) -> DataFrame:
    """Of the rows to show those that can be among the first ``cap`` of a capture, chunk by chunk and without a shuffle.

    A hunk keeps ``hunk_cap`` rows of a chunk at most.  Only of the hunk that began in an earlier chunk some may
    still fall out, so a row of the page is among the chunk's first ``cap + hunk_cap``, and its hunk ends
    ``hunk_cap`` rows further.  Rows of that earlier hunk and of the last one pass all, as they are counted
    with those of other chunks; ``rest`` of the last header is the number of rows that stay behind.
    """
    chunk = Window.partitionBy("capture_id", "_chunk").orderBy("line_no")
    upto = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    group, mark_at, at = F.struct("mark_at", "kind"), F.col("mark_at"), F.col("_at")
    rows = rows.withColumns({"_at": F.row_number().over(chunk), "_before": F.lag(group).over(chunk), "_last": F.max("mark_at").over(whole)})
    rows = rows.withColumn("_begins", F.max(F.when(~group.eqNullSafe(F.col("_before")), at)).over(upto)).where(at < F.col("_begins") + hunk_cap)
    earlier = F.coalesce(mark_at < F.col("_chunk") * size, F.lit(True))
    rows = rows.withColumns({"_at": F.row_number().over(chunk), "_earlier": F.count(F.when(earlier, 1)).over(upto)})
    near = F.when(F.coalesce("shown_before", F.lit(0)) < cap, min(cap + 2 * hunk_cap, ALL)).otherwise(0)
    first, ends = F.greatest(near, F.col("_earlier")), mark_at.eqNullSafe(F.col("_last"))
    header = ends & ~mark_at.eqNullSafe(F.col("_before.mark_at"))
    rest = F.when(header, F.greatest(at - 1 - first, F.lit(0))).otherwise(0)
    return rows.withColumn("rest", rest).where((at <= first) | ends).drop("_at", "_before", "_last", "_begins", "_earlier")


def diff_condense(lines: DataFrame, plain: bool = True, hunk_cap: int = R.DIFF_HUNK_CAP,
                  cap: int = R.DIFF_CAP, chunk: int | None = CHUNK) -> DataFrame:
    """File and hunk headers plus the first 30 lines of each hunk, 200 in all.

    Context shows only after the first change of its hunk.
    """
    rows, line = _diff_state(lines, plain, chunk, True, hunk_cap), F.col("line")
    shown_as = (F.when(F.col("is_header"), "file").when(F.col("is_hunk"), "hunk")
                .when(F.col("in_hunk") & F.col("after_change") & ~line.startswith("\\"), "line"))
    rows = _page_rows(rows.withColumn("kind", shown_as).where(F.col("kind").isNotNull()), hunk_cap, cap, chunk or _NEVER)
    # Headers are groups of one here, so one pass ranks them along with the hunks.  The few rows that a chunk
    # passes on meet by capture for all that follows.
    shown = capped(rows.repartition("capture_id"), ["capture_id", "mark_at", "kind"], [F.col("line_no")], hunk_cap, {"n_hunk": ("sum", F.lit(1))},
                   split=F.col("_chunk"))
    info = trim_ws(F.coalesce(F.get(F.split(line, "@@", -1), F.lit(1)), F.lit("")))
    shown = shown.select(
        "capture_id", "line_no", "file", "file_at", F.col("mark_at").alias("hunk_at"), "kind",
        F.when(F.col("kind") == "file", F.col("file")).when(F.col("kind") == "hunk", info).otherwise(line).alias("line"),
        ((F.col("kind") == "line") & (F.col("n_hunk") >= hunk_cap)).alias("truncated"), "rest")
    out = capped(shown, ["capture_id"], [F.col("line_no")], cap, {"n_rows": ("sum", 1 + F.col("rest"))})
    return out.select("capture_id", "rank", bigint("line_no").alias("line_no"), "file",
                      bigint("file_at").alias("file_at"), bigint("hunk_at").alias("hunk_at"), "kind", "line",
                      "truncated", bigint("n_rows").alias("n_rows"))


# --- outcomes -------------------------------------------------------------------


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.col("line_no")))


def _final(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("line_no")))


def git_outcome(lines: DataFrame) -> DataFrame:
    """What push, pull, commit and add did, one row per capture."""
    line, text = F.col("line"), trim_ws(F.col("line"))
    action = F.regexp_extract(trim_ws(F.lower("command")), r"^git\s+(push|pull|commit|add)(\s|$)", 1)
    words = F.split(text, r"\s+", -1)
    changed = line.contains("file") & line.contains("changed")
    per_capture = (lines.withColumn("action", action).where(F.col("action") != "")
                   .groupBy("capture_id", "action").agg(
        F.max(line.contains("up-to-date") | line.contains("Already up to date")).alias("current"),
        _first(F.element_at(words, -1), line.contains("->") & (F.size(words) >= 3)).alias("target"),
        F.max(line.contains("nothing to commit")).alias("no_commit"),
        _first(first_chars(F.regexp_extract(line, R.COMMIT_REF, 1), 7), not_blank(line)).alias("sha"),
        _first(text, line.contains("changed")).alias("shortstat"),
        F.max(not_blank(line)).alias("any_text"),
        *[_final(number_in(line, rf"(\d+) {word}"), changed).alias(name) for word, name in
          (("file", "files"), ("insertion", "insertions"), ("deletion", "deletions"))]))
    act = F.col("action")
    status = (F.when(act.isin("push", "pull") & F.col("current"), "up-to-date")
              .when((act == "commit") & F.col("no_commit"), "nothing-to-commit")
              .when((act == "add") & ~F.col("any_text"), "nothing-to-add").otherwise("ok"))
    done = F.col("status") == "ok"
    ref = (F.when(done & (act == "push"), F.col("target"))
           .when(done & (act == "commit"), F.nullif(F.col("sha"), F.lit("")))
           .when(done & (act == "add"), F.col("shortstat")))
    out = per_capture.withColumn("status", status)
    return out.select("capture_id", "action", "status", ref.alias("ref"), *[
        bigint(F.when(done & act.isin("pull", "add"), F.coalesce(name, F.lit(0)))).alias(name)
        for name in ("files", "insertions", "deletions")])


def install_outcome(lines: DataFrame) -> DataFrame:
    """Device installs: installed, failed with its reason, or unknown."""
    line = F.col("line")
    seen = (lines.where(F.lower(trim_ws(F.col("command"))).rlike(r"^adb\s+install"))
            .groupBy("capture_id").agg(
        F.max(line.contains("Success")).alias("ok"),
        _first(F.regexp_extract(line, R.INSTALL_FAILURE, 1), line.rlike(R.INSTALL_FAILURE)).alias("reason")))
    status = F.when(F.col("ok"), "installed").when(F.col("reason").isNotNull(), "failed").otherwise("unknown")
    return seen.select("capture_id", status.alias("status"),
                       F.when(~F.col("ok"), F.col("reason")).alias("detail"))
