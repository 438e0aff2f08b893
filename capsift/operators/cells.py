"""Compact text for formats that group lines, out of one cell.

FIXED VALUES: the phrases of the texts, as in ``compact``.

The counterpart of ``render`` for captures whose text lies in one cell anyway: lines are cut
into pieces at header lines, or sorted by key and cut where the key changes, so a text is
walked a few times and never leaves the task that read it.  Like the functions of ``compact``
these are column expressions of ``raw`` and ``command``; all of them fit in one CASE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from capsift import rules as R
from capsift.functions.text import (bigint, compact_path, contains_any, first_chars, groups, human_size, normalize_log_line, not_blank,
                                    number_in, snippet, trim_ws, truncate_line)
from capsift.operators import compact
from capsift.operators.compact import _filled, _first, _head, _joined, _last, _let, _lines, _none, _one, build, git_log_blocks
from capsift.operators.cut import generic_text


def _pieces(items: Column, starts: Callable[[Column, Column], Column], first: int | None = None) -> Column:
    """Slices of ``items``, each from one start to the next; what is before the first start is left out.

    ``first`` is for texts that show no more than so many pieces: the others are not cut out.
    """
    def cut(l: Column) -> Column:
        at = F.filter(F.transform(l, lambda x, i: F.when(starts(x, i), i)), lambda i: i.isNotNull())
        return _let(lambda at: F.transform(at if first is None else _head(at, first), lambda a, j: F.slice(
            l, a + 1, F.coalesce(F.get(at, j + 1), F.size(l)) - a)), at=at)
    return _let(cut, l=items)


def _runs(items: Column, key: str, cap: int | None = None) -> Column:
    """Sorted structs as runs of equal ``key``: ``n`` and the first ``cap`` of its ``rows``.

    ``sort_array`` compares natively, ``array_sort`` by an expression per pair; they order the same as no struct is null.
    """
    def cut(l: Column) -> Column:
        new = lambda x, i: (i == 0) | ~x[key].eqNullSafe(F.get(l, i - 1)[key])
        at = F.filter(F.transform(l, lambda x, i: F.when(new(x, i), i)), lambda i: i.isNotNull())

        def run(a: Column, n: Column) -> Column:
            return F.struct(n.alias("n"), F.slice(l, a + 1, n if cap is None else F.least(n, F.lit(cap))).alias("rows"))

        return _let(lambda at: F.transform(at, lambda a, j: run(a, F.coalesce(F.get(at, j + 1), F.size(l)) - a)), at=at)
    return _let(cut, l=F.sort_array(items))


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _some(when: Column, items: Column) -> Column:
    return F.when(when, items).otherwise(_none())


def _each(items: Column, fn: Callable[..., Column]) -> Column:
    """The arrays that ``fn`` gives for each item, as one."""
    return F.flatten(F.transform(items, fn))


# --- logs ---------------------------------------------------------------------------------


def logs(raw: Column, command: Column) -> Column:
    """Totals, then the most frequent templates of errors and warnings."""
    def severity(low: Column) -> Column:
        return (F.when(contains_any(low, "error", "fatal", "panic"), "error")
                .when(low.contains("warn"), "warn").when(low.contains("info"), "info"))

    def templates(rows: Column, name: str) -> Column:
        mine = F.transform(F.filter(rows, lambda r: r["severity"] == name), lambda r: F.struct(
            normalize_log_line(r["line"]).alias("template"), r["at"].alias("at"), r["line"].alias("line")))
        return F.sort_array(F.transform(_runs(mine, "template", 1), lambda g: F.struct(
            (-g["n"]).alias("less"), g["rows"][0]["at"].alias("at"), g["rows"][0]["template"].alias("template"),
            g["rows"][0]["line"].alias("line"))))

    def shown(found: Column, name: str, title: str, word: str) -> Column:
        cap = R.LOG_TOP[name]
        text = lambda t: F.concat(F.when(t["less"] < -1, F.format_string("  [x%d] ", -t["less"])).otherwise("  "),
                                  truncate_line(t["line"], R.EXEMPLAR_WIDTH))
        more = _one(F.format_string(f"  ... +%d more unique {word}", F.size(found) - cap), F.size(found) > cap)
        return _some(F.size(found) > 0, F.concat(F.array(F.lit(title)), F.transform(_head(found, cap), text), more))

    def text(r: Column, e: Column, w: Column) -> Column:
        total = lambda found: F.aggregate(found, F.lit(0), lambda n, t: n - t["less"])
        infos = F.size(F.filter(r, lambda x: x["severity"] == "info"))
        return _joined(
            F.array(F.lit("Log Summary"), F.format_string("  [error] %d errors (%d unique)", total(e), F.size(e)),
                    F.format_string("  [warn] %d warnings (%d unique)", total(w), F.size(w)),
                    F.format_string("  [info] %d info messages", infos), F.lit("")),
            shown(e, "error", "[ERRORS]", "errors"), _one(F.lit(""), F.size(e) > 0), shown(w, "warn", "[WARNINGS]", "warnings"))

    rows = F.filter(F.transform(_lines(raw), lambda s, i: F.struct(severity(F.lower(s)).alias("severity"), i.alias("at"), s.alias("line"))),
                    lambda r: r["severity"].isNotNull())
    return _let(lambda r: _let(lambda e, w: text(r, e, w), e=templates(r, "error"), w=templates(r, "warn")), r=rows)


def docker(raw: Column, command: Column) -> Column:
    """Containers, images or logs, as the command asks."""
    return F.when(command.rlike(R.LOGS_OF % "docker"), logs(raw, command)).otherwise(compact.docker(raw, command))


def kubectl(raw: Column, command: Column) -> Column:
    """Resources, or logs where the command asks for them."""
    return F.when(command.rlike(R.LOGS_OF % "kubectl"), logs(raw, command)).otherwise(compact.kubectl(raw, command))


# --- listings, paths, search results, tasks ------------------------------------------------------


def _entry(s: Column, dropped: tuple[str, ...]) -> Column:
    """Name, size and kind of a listing line; null where it is no entry."""
    kind = F.when(s.rlike(R.LS_LINE), "ls").when(s.contains("<DIR>"), "dir").when(
        s.rlike(R.WINDOWS_LINE) & ~contains_any(s, "File(s)", "Dir(s)"), "file")

    def parts(k: Column) -> Column:
        return F.when(k == "ls", F.split(s, r"\s+", -1)).when(k == "dir", groups(s, r"^.*" + R.WINDOWS_DIR, 1)).when(
            k == "file", groups(s, R.WINDOWS_FILE_LINE, 2))

    def entry(k: Column, p: Column) -> Column:
        long = F.when(F.size(p) >= 9, F.array_join(F.slice(p, F.lit(9), F.greatest(F.size(p), F.lit(1))), " "))
        name = trim_ws(F.when(k == "ls", long).when(k == "dir", F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(2))))
        size = F.when(k == "ls", F.get(p, F.lit(4))).when(k == "file", F.replace(F.get(p, F.lit(1)), F.lit(","), F.lit("")))
        return _let(lambda name: F.when(name.isNotNull() & ~name.isin(*dropped), F.struct(
            name.alias("name"), ((k == "dir") | ((k == "ls") & s.startswith("d"))).alias("is_dir"),
            bigint(F.coalesce(size.try_cast("bigint"), F.lit(0))).alias("size"))), name=name)

    return _let(lambda k: F.when(k.isNotNull(), _let(entry, k=k, p=parts(k))), k=kind)


def ls(raw: Column, command: Column, show_all: bool = False) -> Column:
    """Folders, files with sizes, and the most frequent extensions."""
    dropped = ("", ".", "..") + (() if show_all else R.NOISE_DIRS)

    def text(d: Column, f: Column) -> Column:
        ext = lambda e: F.regexp_extract(e["name"], r"(\.[^.]*)$", 1)
        named = F.transform(f, lambda e, i: F.struct(F.when(ext(e) == "", "no ext").otherwise(ext(e)).alias("ext"), i.alias("at")))
        kinds = F.sort_array(F.transform(_runs(named, "ext", 1), lambda g: F.struct(
            (-g["n"]).alias("less"), g["rows"][0]["at"].alias("at"), g["rows"][0]["ext"].alias("ext"))))

        def tail(k: Column) -> Column:
            most = F.array_join(F.transform(_head(k, R.EXT_CAP), lambda x: F.format_string("%d %s", -x["less"], x["ext"])), ", ")
            more = F.when(F.size(k) > R.EXT_CAP, F.format_string(", +%d more", F.size(k) - R.EXT_CAP)).otherwise("")
            return F.concat(F.format_string("\n%d files, %d dirs", F.size(f), F.size(d)),
                            F.when(F.size(k) > 0, F.concat(F.lit(" ("), most, more, F.lit(")"))).otherwise(""))

        listed = _joined(F.transform(d, lambda e: F.concat(e["name"], F.lit("/"))),
                         F.transform(f, lambda e: F.concat(e["name"], F.lit(" "), human_size(e["size"]))), F.array(_let(tail, k=kinds)))
        return F.when(F.size(d) + F.size(f) == 0, "(empty)").otherwise(listed)

    entries = _present(F.transform(_filled(raw), lambda s: _entry(s, dropped)))
    return _let(lambda e: _let(text, d=F.filter(e, lambda x: x["is_dir"]), f=F.filter(e, lambda x: ~x["is_dir"])), e=entries)


def find(raw: Column, command: Column) -> Column:
    """Up to 30 paths as they are, more of them by folder."""
    def folders(k: Column) -> Column:
        above = lambda s: F.regexp_extract(s, r"^(.*)/[^/]*$", 1)
        rows = F.transform(k, lambda s, i: F.struct(F.when(above(s) == "", ".").otherwise(above(s)).alias("dir"), i.alias("at"),
                                                    F.regexp_extract(s, r"([^/]*)$", 1).alias("name")))
        found = F.sort_array(F.transform(_runs(rows, "dir", R.FIND_ALL), lambda g: F.struct(
            g["rows"][0]["at"].alias("at"), g["rows"][0]["dir"].alias("dir"), g["n"].alias("n"), F.transform(g["rows"], lambda r: r["name"]).alias("names"))))

        def line(g: Column) -> Column:
            names = F.when(g["n"] <= R.FIND_ALL, g["names"]).otherwise(_head(g["names"], R.FIND_HEAD))
            more = F.when(g["n"] > R.FIND_ALL, F.format_string(" ... +%d more", g["n"] - R.FIND_HEAD)).otherwise("")
            return F.concat(F.format_string("%s/ (%d): ", g["dir"], g["n"]), F.array_join(names, ", "), more)

        return _joined(F.array(F.format_string("%d files found", F.size(k))), F.transform(found, line))

    return _let(lambda k: F.when(F.size(k) == 0, "(no results)").when(F.size(k) <= R.FIND_PASS, F.array_join(k, "\n")).otherwise(folders(k)),
                k=_filled(raw))


def _match(s: Column, i: Column) -> Column:
    """``file, at, colon`` of a search result; its text, after the colon, is taken where it is shown."""
    after = F.locate(":", F.substring(s, 3, 1 << 30))
    drive = (F.substring(s, 2, 1) == ":") & s.rlike(R.GREP_DRIVE)  # few lines reach the pattern
    at = F.when(drive & (after > 0), F.instr(s, ":") + after).otherwise(F.instr(s, ":"))
    return _let(lambda at: F.struct(F.substring(s, F.lit(1), at - 1).alias("file"), i.alias("at"), at.alias("colon")), at=at)


def _numbered(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the row (0 if there is none) and the content of a search result."""
    def parsed(digits: Column) -> Column:
        return body(F.when(digits != "", digits.cast("bigint")).otherwise(F.lit(0).cast("bigint")),
                    F.when(digits != "", F.substring(text, F.length(digits) + 2, F.length(text))).otherwise(text))
    return _let(parsed, digits=F.regexp_extract(text, R.GREP_ROW, 1))


def grep(raw: Column, command: Column) -> Column:
    """Matches by file; long ones are cut around the pattern that the command searched for."""
    pattern = F.regexp_extract(F.lower(command), R.SEARCH_PATTERN, 1)

    def listed(m: Column, k: Column) -> Column:
        runs = _runs(F.transform(m, lambda s, i: _match(s, i)), "file", R.GREP_PER_FILE)

        def page(g: Column) -> Column:
            rows = _each(g, lambda x: F.transform(x["rows"], lambda r, i: F.struct(x["n"].alias("n"), i.alias("place"), r.alias("r"))))

            def lines(r: Column) -> Column:
                def of(x: Column, i: Column) -> Column:
                    def line(row: Column, content: Column) -> Column:
                        digits = row.cast("string")
                        number = F.when(row > 0, F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), 4 - F.length(digits))), digits)).otherwise("   ?")
                        return F.concat(F.lit("  "), number, F.lit(": "), snippet(content, pattern))

                    whole = F.get(m, x["r"]["at"])
                    text = F.substring(whole, x["r"]["colon"] + 1, F.length(whole))
                    ends = F.coalesce(F.get(r, i + 1)["place"], F.lit(0)) == 0
                    return F.concat(
                        _one(F.format_string("[file] %s (%d):", compact_path(x["r"]["file"]), x["n"]), x["place"] == 0),
                        F.array(_let(lambda text: _numbered(text, line), text=text)),
                        _one(F.format_string("  +%d", x["n"] - R.GREP_PER_FILE), ends & (x["n"] > R.GREP_PER_FILE)), _one(F.lit(""), ends))

                rest = F.size(m) - F.size(r)
                return F.regexp_replace(_joined(F.array(F.format_string("%d matches in %dF:\n", F.size(m), F.size(g))), _each(r, of),
                                                _one(F.format_string("... +%d", rest), rest > 0)), r"\s+$", "")

            return _let(lines, r=_head(rows, R.GREP_OVERALL))

        quiet = _let(lambda k: F.when(F.size(k) == 0, "(no matches)").otherwise(F.array_join(_head(k, 20), "\n")), k=k)
        return F.when(F.size(m) == 0, quiet).otherwise(_let(page, g=runs))

    return _let(lambda l: _let(lambda m: listed(m, F.filter(l, not_blank)), m=F.filter(l, lambda s: s.contains(":"))), l=_lines(raw))


def tasks(raw: Column, command: Column) -> Column:
    """Build tasks under their group header, the first eight of each."""
    def is_task(s: Column) -> Column:
        return s.rlike(r"^[A-Za-z0-9_]") & s.contains(" - ")

    def is_header(s: Column) -> Column:
        return s.endswith(" tasks") & ~s.startswith(" ")

    def under(lines: Column, group: Column) -> Column:
        return F.transform(F.filter(lines, is_task), lambda s: F.struct(group.alias("group"), trim_ws(s).alias("task")))

    def text(l: Column, p: Column) -> Column:
        before = F.slice(l, F.lit(1), F.size(l) - F.aggregate(p, F.lit(0), lambda n, x: n + F.size(x)))
        name = lambda x: trim_ws(F.regexp_replace(F.get(x, F.lit(0)), r"^(.*?) tasks", "$1"))
        items = F.concat(under(before, F.lit("other")), _each(p, lambda x: under(x, name(x))))
        rows = F.transform(items, lambda t, i: F.struct(t["group"].alias("group"), i.alias("at"), t["task"].alias("task")))
        found = F.sort_array(F.transform(_runs(rows, "group", R.TASK_CAP), lambda g: F.struct(
            g["rows"][0]["at"].alias("at"), g["n"].alias("n"), g["rows"].alias("rows"))))

        def lines(g: Column) -> Column:
            return F.concat(F.array(F.format_string("%s (%d):", g["rows"][0]["group"], g["n"])),
                            F.transform(g["rows"], lambda r: F.concat(F.lit("  "), r["task"])),
                            _one(F.format_string("  ... +%d more", g["n"] - R.TASK_CAP), g["n"] > R.TASK_CAP))

        return _let(lambda f, n: F.when(n == 0, generic_text(raw)).otherwise(
            _joined(F.array(F.format_string("%d tasks available", n)), _each(f, lines))), f=found, n=F.size(rows))

    return _let(lambda l: _let(lambda p: text(l, p), p=_pieces(l, lambda s, i: is_header(s))), l=_filled(raw))


# --- version control ------------------------------------------------------------------------------


def _marked(raw: Column, plain: bool) -> Column:
    """Lines as ``s, header``; old names of diffs made without git are left out."""
    git = lambda s: s.startswith("diff --git")
    if not plain:
        return F.transform(_lines(raw), lambda s: F.struct(s.alias("s"), git(s).alias("header")))
    place = lambda l, test: F.coalesce(F.nullif(F.array_position(F.transform(l, test), True), F.lit(0)) - 1, F.lit(1 << 40))

    def marks(l: Column, g: Column, h: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            old, new = s.startswith("--- "), s.startswith("+++ ")
            after_old = F.coalesce(F.get(l, i - 1).startswith("--- "), F.lit(False))
            before_new = F.coalesce(F.get(l, i + 1).startswith("+++ "), F.lit(False))
            return F.struct(s.alias("s"), (git(s) | ((i < g) & new & ((i < h) | after_old))).alias("header"),
                            ((i < g) & old & (i > h) & before_new).alias("old"))
        return F.filter(F.transform(l, one), lambda x: ~x["old"])

    return _let(lambda l: _let(lambda g, h: marks(l, g, h), g=place(l, git), h=place(l, lambda s: s.startswith("@@"))), l=_lines(raw))


def _condensed(raw: Column, plain: bool) -> Column:
    changes = lambda s: s.startswith("+") | s.startswith("-")

    def hunk_rows(h: Column, f: Column, j: Column) -> Column:
        """The header row of a hunk and its first shown lines."""
        lines = F.transform(F.slice(h, F.lit(2), F.size(h)), lambda x: x["s"])
        info = trim_ws(F.coalesce(F.get(F.split(F.get(h, F.lit(0))["s"], "@@", -1), F.lit(1)), F.lit("")))

        def rows(l: Column) -> Column:
            first = F.array_position(F.transform(l, changes), True).cast("int")
            open_ = F.when(first > 0, F.filter(F.slice(l, F.greatest(first, F.lit(1)), F.size(l)), lambda s: ~s.startswith("\\"))).otherwise(_none())
            row = lambda text, cut: F.struct(text.alias("text"), cut.alias("cut"), f.alias("file"), j.alias("hunk"))
            return _let(lambda o: F.concat(
                F.array(row(F.concat(F.lit("  @@ "), info, F.lit(" @@")), F.lit(False))),
                F.transform(_head(o, R.DIFF_HUNK_CAP), lambda s: row(F.concat(F.lit("  "), s), F.size(o) >= R.DIFF_HUNK_CAP))), o=open_)

        return _let(rows, l=lines)

    def counted(hunks: Column, sign: str) -> Column:
        return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(F.filter(F.slice(h, F.lit(2), F.size(h)), lambda x: x["s"].startswith(sign))))

    def name(s: Column) -> Column:
        git = F.coalesce(F.get(F.split(s, " b/", -1), F.lit(1)), F.lit("unknown"))
        path = F.split(F.substring(s, F.lit(5), F.length(s)), "\t", -1)[0]
        return F.when(s.startswith("diff --git"), git).otherwise(F.regexp_replace(path, "^b/", "")) if plain else git

    def file_of(p: Column, i: Column) -> Column:
        def whole(h: Column) -> Column:
            head = F.struct(F.concat(F.lit("\n"), name(F.get(p, F.lit(0))["s"])).alias("text"), F.lit(False).alias("cut"), i.alias("file"), F.lit(-1).alias("hunk"))
            return F.struct(counted(h, "+").alias("added"), counted(h, "-").alias("removed"),
                            F.concat(F.array(head), _each(h, lambda x, j: hunk_rows(x, i, j))).alias("rows"))
        return _let(whole, h=_pieces(p, lambda x, k: x["s"].startswith("@@") & ~x["header"]))

    def text(f: Column, r: Column) -> Column:
        """``r`` are all rows that could be shown, and one more at least where rows are left out."""
        def page(s: Column) -> Column:
            def lines(x: Column, i: Column) -> Column:
                after, of = F.get(s, i + 1), F.get(f, x["file"])
                hunk_ends = F.coalesce((after["file"] != x["file"]) | (after["hunk"] != x["hunk"]), F.lit(True))
                file_ends = F.coalesce(after["file"] != x["file"], F.lit(True))
                return F.concat(F.array(x["text"]), _one(F.lit("  ... (truncated)"), x["cut"] & hunk_ends), _one(
                    F.format_string("  +%d -%d", of["added"], of["removed"]), file_ends & (of["added"] + of["removed"] > 0)))

            over = F.size(r) > R.DIFF_CAP
            return _joined(_each(s, lines), _one(F.lit("\n... (more changes truncated)"), over),
                           _one(F.lit("[full diff available — use git diff directly]"), over | F.exists(s, lambda x: x["cut"])))
        return F.when(F.size(r) == 0, "").otherwise(_let(page, s=_head(r, R.DIFF_CAP)))

    # A file has a row at least, so one file more than rows are shown tells that rows are left out.
    files = F.transform(_pieces(_marked(raw, plain), lambda x, i: x["header"], R.DIFF_CAP + 1), file_of)
    return _let(lambda f: _let(lambda r: text(f, r), r=_each(f, lambda x: x["rows"])), f=files)


def git_diff(raw: Column, command: Column) -> Column:
    return _condensed(raw, False)


def diff(raw: Column, command: Column) -> Column:
    """Diffs with or without ``diff --git`` headers."""
    return _condensed(raw, True)


def git_log(raw: Column, command: Column) -> Column:
    """One line per commit, from blocks with an end mark or from plain history."""
    def commit(p: Column) -> Column:
        head = F.get(p, F.lit(0))
        short = F.when(head.rlike(R.LOG_ONELINE), F.concat(
            first_chars(F.regexp_extract(head, R.LOG_ONELINE, 1), 7), F.lit(" "), F.regexp_extract(head, R.LOG_ONELINE, 2)))
        subject = trim_ws(_first(F.filter(F.slice(p, F.lit(2), F.size(p)), lambda s: s.startswith("    ") & not_blank(s))))
        return truncate_line(F.coalesce(short, F.concat_ws(" ", first_chars(F.regexp_extract(head, R.LOG_COMMIT, 1), 7), subject)))

    plain = _let(lambda p: F.when(F.size(p) == 0, trim_ws(raw)).otherwise(F.array_join(F.transform(p, commit), "\n")),
                 p=_pieces(_lines(raw), lambda s, i: (s >= "0") & (s < "g") & (s.rlike(R.LOG_COMMIT) | s.rlike(R.LOG_ONELINE))))  # both begin with 0-9 or a-f
    return F.when(raw.contains(R.LOG_BLOCK_END), git_log_blocks(raw, command)).otherwise(plain)


# --- diagnostics ---------------------------------------------------------------------------------------


def _by_file(found: Column, heading: Callable[[Column, Column], Column], item: Callable[[Column], Column], quiet: Column) -> Column:
    """``found`` holds ``file, at`` and what ``item`` shows; files by first appearance, ten items each."""
    def text(r: Column) -> Column:
        files = F.sort_array(F.transform(_runs(r, "file", R.PER_FILE_CAP), lambda g: F.struct(
            g["rows"][0]["at"].alias("at"), g["n"].alias("n"), g["rows"].alias("rows"))))

        def lines(g: Column) -> Column:
            return F.concat(F.array(g["rows"][0]["file"]), F.transform(g["rows"], item),
                            _one(F.format_string("  ... +%d more", g["n"] - R.PER_FILE_CAP), g["n"] > R.PER_FILE_CAP))

        return F.when(F.size(r) == 0, quiet).otherwise(_let(lambda f: _joined(F.array(heading(r, f)), _each(f, lines)), f=files))

    return _let(text, r=found)


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def tsc(raw: Column, command: Column) -> Column:
    def row(s: Column, i: Column) -> Column:
        return _let(lambda p: F.when(p.isNotNull(), F.struct(
            trim_ws(_field(p, 1)).alias("file"), i.alias("at"), _field(p, 2).cast("bigint").alias("row"), _field(p, 3).cast("bigint").alias("col"),
            _field(p, 4).alias("severity"), _field(p, 5).alias("rule"), trim_ws(_field(p, 6)).alias("message"))),
            p=F.when(s.contains("): "), groups(s, R.TSC, 6)))

    item = lambda r: F.format_string("  %s %d:%d %s: %s", F.when(r["severity"] == "error", "E").otherwise("W"), r["row"], r["col"], r["rule"], r["message"])
    heading = lambda r, f: F.format_string("%d TypeScript error(s) in %d file(s):", F.size(F.filter(r, lambda x: x["severity"] == "error")), F.size(f))
    quiet = F.when(raw.contains("error TS"), generic_text(raw)).otherwise("tsc ok")
    return _by_file(_present(F.transform(_lines(raw), row)), heading, item, quiet)


def ruff(raw: Column, command: Column) -> Column:
    def issue(file: Column, at: Column, row: Column, col: Column, rule: Column, message: Column) -> Column:
        return F.struct(file.alias("file"), at.alias("at"), row.alias("row"), col.alias("col"), rule.alias("rule"), message.alias("message"))

    def row(s: Column, i: Column) -> Column:
        return _let(lambda p: F.when(p.isNotNull(), issue(
            trim_ws(_field(p, 1)), i, _field(p, 2).cast("bigint"), _field(p, 3).cast("bigint"), _field(p, 4), trim_ws(_field(p, 5)))),
            p=F.when(s.rlike(r":\d+: [A-Z]\d"), groups(s, R.RUFF, 5)))

    reported = F.transform(F.from_json(raw, R.RUFF_SCHEMA), lambda r, i: issue(
        r["filename"], i, r["location"]["row"], r["location"]["column"], r["code"], r["message"]))
    place = lambda r: F.when(r["row"].isNull(), "?").otherwise(F.format_string("%d:%d", r["row"], r["col"]))
    item = lambda r: F.concat(F.lit("  "), place(r), F.lit(" "), r["rule"], F.lit(" "), r["message"])
    heading = lambda r, f: F.format_string("%d issue(s) in %d file(s):", F.size(r), F.size(f))
    found = F.when(raw.rlike(r"^\s*\["), F.coalesce(reported, F.array().cast(
        "array<struct<file:string,at:int,row:bigint,col:bigint,rule:string,message:string>>"))).otherwise(_present(F.transform(_lines(raw), row)))
    return _by_file(found, heading, item, F.lit("ruff ok"))


def lint(raw: Column, command: Column) -> Column:
    """Distinct messages by level and rule; both levels are counted in the heading."""
    def row(s: Column, i: Column) -> Column:
        def of(e: Column, b: Column) -> Column:
            severity = F.when(e.isNotNull(), _field(e, 3)).otherwise("error")
            rule = F.when(e.isNotNull(), _field(e, 5)).otherwise("lint")
            message = trim_ws(F.when(e.isNotNull(), _field(e, 4)).otherwise(_field(b, 4)))
            return F.when(e.isNotNull() | b.isNotNull(), F.struct(F.struct(severity.alias("severity"), rule.alias("rule")).alias("key"), i.alias("at"), message.alias("message")))
        return _let(of, e=F.when(s.rlike(r"^\s+\d"), groups(s, R.ESLINT, 5)), b=F.when(s.contains("━"), groups(s, R.BIOME, 4)))

    def text(r: Column) -> Column:
        rules = F.sort_array(F.transform(_runs(r, "key"), lambda g: F.struct(
            g["rows"][0]["at"].alias("at"), g["rows"][0]["key"].alias("key"), F.array_distinct(F.transform(g["rows"], lambda x: x["message"])).alias("messages"))))
        count = lambda level: F.size(F.filter(r, lambda x: x["key"]["severity"] == level))

        def lines(g: Column) -> Column:
            key, n = g["key"], F.size(g["messages"])
            named = F.when(key["rule"] == "lint", "lint").otherwise(F.concat_ws(" ", key["severity"], key["rule"]))
            return F.concat(F.array(F.concat(F.lit("  "), named, F.format_string(" (%d):", n))),
                            F.transform(_head(g["messages"], R.PER_RULE_CAP), lambda m: F.concat(F.lit("    "), m)),
                            _one(F.format_string("    ... +%d more", n - R.PER_RULE_CAP), n > R.PER_RULE_CAP))

        low = F.lower(raw)
        quiet = F.when(low.contains("problem") | low.contains("error"), generic_text(raw)).otherwise("lint ok")
        return F.when(F.size(r) == 0, quiet).otherwise(_let(lambda g: _joined(
            F.array(F.format_string("%d error(s), %d warning(s) across %d rule(s):", count("error"), count("warning"), F.size(g))), _each(g, lines)), g=rules))

    return _let(text, r=_present(F.transform(_lines(raw), row)))


def golangci(raw: Column, command: Column) -> Column:
    """JSON reports by linter; plain text falls back to the build summary."""
    def text(x: Column) -> Column:
        rows = F.transform(x, lambda r, i: F.struct(r["FromLinter"].alias("linter"), i.alias("at"), r["Text"].alias("message"), F.coalesce(F.when(
            r["Pos"]["Filename"].isNotNull(), F.concat(r["Pos"]["Filename"], F.lit(":"), r["Pos"]["Line"].cast("string"))), F.lit("?")).alias("place")))
        found = F.sort_array(F.transform(_runs(rows, "linter", R.PER_LINTER_CAP), lambda g: F.struct(
            g["rows"][0]["at"].alias("at"), g["n"].alias("n"), g["rows"].alias("rows"))))

        def lines(g: Column) -> Column:
            return F.concat(F.array(F.format_string("%s (%d):", g["rows"][0]["linter"], g["n"])),
                            F.transform(g["rows"], lambda r: F.format_string("  %s: %s", r["place"], r["message"])),
                            _one(F.format_string("  ... +%d more", g["n"] - R.PER_LINTER_CAP), g["n"] > R.PER_LINTER_CAP))

        listed = _let(lambda g: _joined(F.array(F.format_string("%d issue(s) across %d linter(s):", F.size(x), F.size(g))), _each(g, lines)), g=found)
        return F.when(F.size(x) == 0, "golangci-lint ok").otherwise(listed)

    issues = F.from_json(F.when(raw.rlike(r"^\s*\{"), raw), R.GOLANGCI_SCHEMA)["Issues"]
    return _let(lambda x: F.when(x.isNull(), build(raw, command)).otherwise(text(x)), x=issues)


# --- test runners ------------------------------------------------------------------------------------------


def _number(s: Column, word: str, pattern: str) -> Column:
    return F.when(s.contains(word), number_in(s, pattern))


def _outcome(bad: Column, failed: Column, passes: Column, failures: Column, quiet: Column) -> Column:
    """``FAILED`` with its lines, ``PASSED``, or ``quiet`` where ``passes`` is null."""
    listed = _joined(F.array(failed), _head(F.array_distinct(_present(failures)), R.TEST_CAP))
    return F.when(bad > 0, listed).otherwise(F.coalesce(passes, quiet))


def _passed(n: Column) -> Column:
    return F.format_string("PASSED: %d tests", n)


def cargo(raw: Column, command: Column) -> Column:
    """All summaries added up; output without one is a build's."""
    def text(l: Column, c: Column) -> Column:
        total = lambda i: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, p: n + _field(p, i).cast("bigint"))
        failures = F.transform(l, lambda s: F.when(trim_ws(s).rlike(R.CARGO_FAILURE), trim_ws(s)))
        return _let(lambda p, f: _outcome(f, F.format_string("FAILED: %d/%d tests", f, p + f), _passed(p), failures, F.lit("")), p=total(2), f=total(3))

    ran = _let(lambda l: _let(lambda c: text(l, c), c=_present(F.transform(l, lambda s: F.when(
        s.contains("test result:"), groups(s, "^.*" + R.CARGO_SUMMARY + ".*$", 3))))), l=_lines(raw))
    return F.when(raw.rlike(R.CARGO_SUMMARY), ran).otherwise(build(raw, command))


def pytest(raw: Column, command: Column) -> Column:
    def text(l: Column, last: Column) -> Column:
        def in_block(p: Column) -> Column:
            return F.get(p, F.lit(0)).rlike(R.PYTEST_BLOCK_OPEN)

        def failure(s: Column, inside: Column) -> Column:
            return (F.when(s.rlike("^FAILED "), trim_ws(s)).when(inside & s.rlike(R.PYTEST_ASSERT), first_chars(trim_ws(s), 120)))

        def failures(p: Column) -> Column:
            before = F.slice(l, F.lit(1), F.size(l) - F.aggregate(p, F.lit(0), lambda n, x: n + F.size(x)))
            return F.concat(F.transform(before, lambda s: failure(s, F.lit(False))),
                            _each(p, lambda x: _let(lambda inside: F.transform(x, lambda s: failure(s, inside)), inside=in_block(x))))

        found = _let(failures, p=_pieces(l, lambda s, i: s.rlike(R.PYTEST_BLOCK_OPEN) | s.rlike(R.PYTEST_BLOCK_CLOSE)))
        zero = lambda n: F.coalesce(n, F.lit(0).cast("bigint"))
        return _let(lambda p, f: _outcome(f, F.format_string("FAILED: %d/%d tests", f, p + f), F.when(p > 0, _passed(p)), found, generic_text(raw)),
                    p=zero(_number(last, "passed", R.PASSED)), f=zero(_number(last, "failed", R.FAILED)))

    def is_summary(s: Column) -> Column:
        return s.contains(R.PYTEST_RULE) & (_number(s, "passed", R.PASSED).isNotNull() | _number(s, "failed", R.FAILED).isNotNull())

    return _let(lambda l: _let(lambda last: text(l, last), last=_last(F.filter(l, is_summary))), l=_lines(raw))


def go(raw: Column, command: Column) -> Column:
    """Tests and packages that failed are told apart; events or plain text."""
    def event(s: Column) -> Column:
        return F.from_json(F.when(s.startswith("{"), s), "Action string, Test string")

    def text(l: Column, e: Column, events: Column) -> Column:
        named = lambda x: F.coalesce(x["Test"], F.lit("")) != ""
        count = lambda items, test: F.size(F.filter(items, test))
        of = lambda action, has: count(e, lambda x: (x["Action"] == action) & (named(x) if has else ~named(x)))
        passed = F.when(events, of("pass", True)).otherwise(count(l, lambda s: s.rlike(R.GO_PASS_TEST) | s.rlike(R.GO_PASS_PACKAGE)))
        failed = F.when(events, of("fail", True)).otherwise(count(l, lambda s: s.rlike(R.GO_FAIL_TEST)))
        packages = F.when(events, of("fail", False)).otherwise(count(l, lambda s: s.rlike(R.GO_FAIL_PACKAGE)))
        failures = F.transform(l, lambda s, i: F.when(s.rlike(R.GO_FAIL_TEST), trim_ws(s)).when(
            (F.get(e, i)["Action"] == "fail") & (F.get(e, i)["Test"] != ""), F.concat(F.lit("FAIL "), F.get(e, i)["Test"])))
        return _let(lambda p, f, k: _outcome(f + k, F.format_string("FAILED: %d tests", F.when(f > 0, f).otherwise(f + k)), _passed(p), failures, F.lit("")),
                    p=passed, f=failed, k=packages)

    return _let(lambda l: _let(lambda e, events: text(l, e, events), e=F.transform(l, event), events=F.exists(l, lambda s: s.contains(R.GO_JSON))), l=_lines(raw))


def _ticked(l: Column, summary: Column, passed: Column, failed: Column, ticks: Column, crosses: Column, failures: Column) -> Column:
    """Numbers of a summary if there is one, else counted tick lines."""
    zero = lambda n: F.coalesce(bigint(n), F.lit(0).cast("bigint"))
    return _let(lambda p, f: _outcome(f, F.format_string("FAILED: %d/%d tests", f, p + f), _passed(p), failures, F.lit("")),
                p=zero(F.when(summary, passed).otherwise(ticks)), f=zero(F.when(summary, failed).otherwise(crosses)))


def _count(l: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(l, test))


def _numbers(s: Column) -> Column:
    return _number(s, "passed", R.PASSED).isNotNull() | _number(s, "failed", R.FAILED).isNotNull()


def vitest(raw: Column, command: Column) -> Column:
    def text(l: Column, last: Column) -> Column:
        failures = F.transform(l, lambda s: F.when(s.rlike(R.VITEST_FAIL), trim_ws(s)).when(s.rlike(R.VITEST_DETAIL), first_chars(trim_ws(s), 120)))
        return _ticked(l, last.isNotNull(), _number(last, "passed", R.PASSED), _number(last, "failed", R.FAILED),
                       _count(l, lambda s: s.rlike(R.VITEST_PASS)), _count(l, lambda s: s.rlike(R.VITEST_FAIL)), failures)

    ran = _let(lambda l: _let(lambda last: text(l, last), last=_last(F.filter(l, lambda s: _numbers(s) & s.rlike(R.VITEST_SUMMARY)))), l=_lines(raw))
    return F.when(raw.rlike("(?i)No test files found|no tests found"), "no test files found").otherwise(ran)


def playwright(raw: Column, command: Column) -> Column:
    def text(l: Column, first: Column) -> Column:
        tick = lambda s: s.rlike(R.PLAYWRIGHT_PASS) & s.rlike(R.PLAYWRIGHT_TIMING)
        final = lambda word, pattern: _last(_present(F.transform(l, lambda s: _number(s, word, pattern))))
        failures = F.transform(l, lambda s, i: F.when(s.rlike(R.PLAYWRIGHT_FAIL), trim_ws(s)).when(
            (first > 0) & (i + 1 > first) & s.rlike(R.PLAYWRIGHT_DETAIL), F.concat(F.lit("  "), first_chars(trim_ws(s), 100))))
        return _ticked(l, F.exists(l, lambda s: _numbers(s) & s.rlike(R.PLAYWRIGHT_SUMMARY)), final("passed", R.PASSED), final("failed", R.FAILED),
                       _count(l, tick), _count(l, lambda s: s.rlike(R.PLAYWRIGHT_FAIL)), failures)

    return _let(lambda l: _let(lambda first: text(l, first), first=F.array_position(F.transform(l, lambda s: s.rlike(R.PLAYWRIGHT_FAIL)), True)), l=_lines(raw))
