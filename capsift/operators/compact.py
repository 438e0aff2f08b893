"""Compact text of one capture, for formats that need no grouping.

FIXED VALUES: the phrases that texts are made of (headings, counts, "ok" lines) are part of the
formats and stand where they are used, plainly.

Each function maps ``raw`` (and ``command`` where it matters) to the compact
text, as one column expression over the lines of one cell.  So all of them fit
in a single CASE over one scan, only the branch taken is evaluated, and the text
never leaves the task that read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from capsift import rules as R
from capsift.functions.text import first_chars, line_count, not_blank, strip_http_headers, trim_ws
from capsift.operators.cut import (_tail, generic_text, head_text, read_full_text, read_head_text,
                                   summary_text, tail_text)
from capsift.operators.jsonops import type_of_schema
from capsift.operators.noise import mask_value

Text = Callable[[Column, Column], Column]


def _let(body: Callable[..., Column], **values: Column) -> Column:
    """``body`` over values that are computed once per row, however often used."""
    names = list(values)
    packed = F.struct(*[values[name].alias(name) for name in names])
    return F.get(F.transform(F.array(packed), lambda s: body(**{name: s[name] for name in names})), F.lit(0))


def _none() -> Column:
    return F.array().cast("array<string>")


def _lines(raw: Column) -> Column:
    return F.split(raw, "\n", -1)


def _filled(raw: Column) -> Column:
    return F.filter(_lines(raw), not_blank)


def _trimmed(raw: Column) -> Column:
    return F.filter(F.transform(_lines(raw), trim_ws), lambda s: s != "")


def _head(items: Column, k: int) -> Column:
    return F.slice(items, 1, k)


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def _one(text: Column, when: Column) -> Column:
    return F.when(when, F.array(text)).otherwise(_none())


def _block(count: Column, fmt: str, items: Column) -> Column:
    """A counted heading with its items, nothing when the count is zero."""
    return F.when(count > 0, F.concat(F.array(F.format_string(fmt, count)), items)).otherwise(_none())


def _listed(items: Column, fmt: str, k: int, indent: str, more: str) -> Column:
    """Heading, first ``k`` items and a line for the rest."""
    n = F.size(items)
    shown = F.transform(_head(items, k), lambda s: F.concat(F.lit(indent), s))
    return F.concat(_block(n, fmt, shown), _one(F.format_string(more, n - k), n > k))


def _last(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


# --- whole text ------------------------------------------------------------------


def passthrough(raw: Column, command: Column) -> Column:
    return trim_ws(raw)


def generic(raw: Column, command: Column) -> Column:
    return generic_text(raw)


def summary(raw: Column, command: Column) -> Column:
    return summary_text(raw)


def read(raw: Column, command: Column) -> Column:
    return read_full_text(raw, command)


def read_start(raw: Column, command: Column) -> Column:
    return read_head_text(raw)


def read_signatures(raw: Column, command: Column) -> Column:
    def body(l: Column, s: Column) -> Column:
        some = _joined(F.array(F.format_string("%s (%d lines, %d signatures):", command, F.size(l), F.size(s))), s)
        none = _joined(F.array(F.format_string("%s (%d lines, no signatures detected):", command, F.size(l))),
                       _head(l, R.SIGNATURE_FALLBACK))
        return F.when(F.size(s) > 0, some).otherwise(none)

    return _let(body, l=_lines(raw), s=F.filter(
        _lines(raw), lambda s: s.rlike(R.SIGNATURES[0]) | s.rlike(R.SIGNATURES[1])))


# --- builds and logs -----------------------------------------------------------------


def _is_build_error(s: Column) -> Column:
    return s.rlike(R.BUILD_ERROR) & ~s.startswith("0 error")


def _is_build_warning(s: Column) -> Column:
    return ~_is_build_error(s) & s.rlike(R.BUILD_WARNING) & ~s.startswith("0 warning")


def build(raw: Column, command: Column) -> Column:
    def text(e: Column, w: Column) -> Column:
        listed = _joined(_block(F.size(e), "%d error(s):", _head(F.array_distinct(e), R.BUILD_CAPS["error"])),
                         _block(F.size(w), "%d warning(s):", _head(F.array_distinct(w), R.BUILD_CAPS["warning"])))
        return F.when(F.size(e) + F.size(w) == 0, "build ok").otherwise(listed)

    return _let(lambda t: _let(text, e=F.filter(t, _is_build_error), w=F.filter(t, _is_build_warning)),
                t=_trimmed(raw))


def gradle(raw: Column, command: Column) -> Column:
    def text(r: Column, i: Column, f: Column, e: Column, w: Column) -> Column:
        distinct = F.array_distinct(w)
        warnings = F.when(F.size(w) <= R.GRADLE_CAPS["warning"], _block(F.size(w), "%d warning(s):", distinct)).otherwise(
            _block(F.size(w), f"%d warning(s) (showing first {R.GRADLE_WARNING_SHORT}):",
                   _head(distinct, R.GRADLE_WARNING_SHORT)))
        listed = _joined(_one(r, r.isNotNull()), _one(i, i.isNotNull()),
                         _block(F.size(f), "Failed tasks(%d):", _head(f, R.GRADLE_CAPS["failed_task"])),
                         _block(F.size(e), "%d error(s):", _head(F.array_distinct(e), R.GRADLE_CAPS["error"])), warnings)
        nothing = r.isNull() & (F.size(e) + F.size(w) == 0)
        return F.when(nothing, generic_text(raw)).otherwise(listed)

    return _let(lambda t: _let(
        text, r=_last(F.filter(t, lambda s: s.rlike(R.GRADLE_RESULT))),
        i=_last(F.filter(t, lambda s: s.rlike(R.GRADLE_TIME))), f=F.filter(t, lambda s: s.rlike(R.GRADLE_FAILED_TASK)),
        e=F.filter(t, lambda s: s.rlike(R.GRADLE_ERROR) & ~s.startswith("0 error")),
        w=F.filter(t, lambda s: s.rlike(R.GRADLE_WARNING) & ~s.startswith("0 warning"))), t=_trimmed(raw))


def next_build(raw: Column, command: Column) -> Column:
    def done(s: Column) -> Column:
        return s.rlike(R.NEXT_TICK) & s.rlike(R.NEXT_DONE)

    def text(d: Column, e: Column, w: Column) -> Column:
        listed = _joined(_block(F.size(e), "%d error(s):", _head(e, R.NEXT_CAPS["error"])),
                         _block(F.size(w), "%d warning(s):", _head(w, R.NEXT_CAPS["warning"])))
        quiet = F.when(d, "next build ok").otherwise(generic_text(raw))
        return F.when(F.size(e) + F.size(w) == 0, quiet).otherwise(listed)

    kept = F.filter(_trimmed(raw), lambda s: ~s.rlike(R.NEXT_PROGRESS) & ~s.rlike(R.NEXT_ROUTE))
    return _let(lambda t: _let(
        text, d=F.exists(t, done), e=F.filter(t, lambda s: ~done(s) & s.rlike(R.NEXT_ERROR)),
        w=F.filter(t, lambda s: ~done(s) & s.rlike(R.NEXT_WARNING))), t=kept)


def logcat(raw: Column, command: Column) -> Column:
    def fatal(s):
        return s.rlike(R.LOGCAT_FATAL)

    def error(s):
        return ~fatal(s) & s.rlike(R.LOGCAT_ERROR)

    def text(t: Column, f: Column, e: Column, w: Column) -> Column:
        parts = [F.array(F.format_string("logcat: %d lines", F.size(t)))]
        for items, fmt, cap in ((f, "FATAL (%d):", "fatal"), (e, "ERRORS (%d):", "error"), (w, "WARNINGS (%d):", "warning")):
            parts.append(_block(F.size(items), fmt, _head(F.array_distinct(items), R.LOGCAT_CAPS[cap])))
        recent = F.concat(F.array(F.lit("(no errors/warnings found)"), F.lit("recent:")),
                          _tail(_filled(raw), R.LOGCAT_RECENT))
        quiet = F.size(f) + F.size(e) + F.size(w) == 0
        return _joined(*parts, F.when(quiet, recent).otherwise(_none()))

    full = _let(lambda t: _let(
        text, t=t, f=F.filter(t, lambda s: fatal(s) | s.rlike(R.LOGCAT_CRASH)), e=F.filter(t, error),
        w=F.filter(t, lambda s: ~fatal(s) & ~error(s) & s.rlike(R.LOGCAT_WARNING))), t=_trimmed(raw))
    return F.when(line_count(raw) <= R.LOGCAT_PASS, trim_ws(raw)).otherwise(full)


# --- tests ------------------------------------------------------------------------------


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint"), F.lit(0))


def test_generic(raw: Column, command: Column) -> Column:
    """Any test runner: the last summary decides, failures only when some failed."""
    def counts(l: Column, last: Column, plain: Column, cargo: Column) -> Column:
        jest = F.coalesce(last.rlike(R.JEST_SUMMARY), F.lit(False))

        def summed(group: int) -> Column:
            return F.aggregate(cargo, F.lit(0).cast("bigint"), lambda acc, s: acc + _int(s, R.CARGO_SUMMARY, group))

        def count(word: str, group: int) -> Column:
            return F.when(jest, _int(last, word)).when(last.isNotNull(), summed(group)).otherwise(_int(plain, word))

        return _let(lambda p, f, t: text(l, f, F.coalesce(t, p + f)), p=count(R.PASSED, 2), f=count(R.FAILED, 3),
                    t=F.when(jest, _int(last, R.JEST_TOTAL)))

    def text(l: Column, failed: Column, total: Column) -> Column:
        failures = F.array_distinct(F.transform(F.filter(l, lambda s: (
            s.rlike(R.GENERIC_FAILURE) & not_blank(s) & ~s.contains("test result:"))), trim_ws))
        listed = _joined(F.array(F.format_string("FAILED: %d/%d tests", failed, total)), _head(failures, R.TEST_CAP))
        return (F.when((failed == 0) & (total > 0), F.format_string("PASSED: %d tests", total))
                .when(failed > 0, listed).otherwise(generic_text(raw)))

    def is_summary(s: Column) -> Column:
        return s.rlike(R.JEST_SUMMARY) | s.rlike(R.CARGO_SUMMARY)

    return _let(lambda l: _let(
        counts, l=l, last=_last(F.filter(l, is_summary)),
        plain=_first(F.filter(l, lambda s: s.rlike(R.PASSED) & ~is_summary(s))),
        cargo=F.filter(l, lambda s: s.rlike(R.CARGO_SUMMARY))), l=_lines(raw))


# --- version control ------------------------------------------------------------------------


def git_status(raw: Column, command: Column) -> Column:
    def entry(s):
        return s.rlike(R.STATUS_LINE) & ~s.startswith("##") & ~s.startswith("??")

    def after(s):
        return F.substring(s, F.lit(4), F.length(s))

    def files(l, test):
        return F.transform(F.filter(l, test), after)

    def porcelain(b: Column, s: Column, m: Column, u: Column, c: Column) -> Column:
        def section(items: Column, fmt: str, cap: str) -> Column:
            return _listed(items, fmt, R.STATUS_CAPS[cap], "   ", "   ... +%d more")

        return _joined(
            b, section(s, "+ Staged: %d files", "staged"), section(m, "~ Modified: %d files", "modified"),
            section(u, "? Untracked: %d files", "untracked"), _block(F.size(c), "conflicts: %d files", _none()),
            _one(F.lit("clean — nothing to commit"), F.size(s) + F.size(m) + F.size(u) + F.size(c) == 0))

    def verbose(v: Column) -> Column:
        # Everything up to the line that says there is nothing to commit.
        stop = F.array_position(F.transform(v, lambda s: (
            s.contains("nothing to commit") & s.contains("working tree clean"))), True).cast("int")
        upto = _joined(F.slice(v, F.lit(1), F.greatest(stop - 1, F.lit(0))), F.array(trim_ws(F.get(v, stop - 1))))
        return F.when(F.size(v) == 0, "ok").when(stop > 0, upto).otherwise(F.array_join(v, "\n"))

    def either(l: Column) -> Column:
        short = _let(
            porcelain, b=F.transform(F.filter(l, lambda s: s.startswith("##")), lambda s: F.concat(F.lit("* "), trim_ws(after(s)))),
            s=files(l, lambda s: entry(s) & F.substring(s, 1, 1).isin(*"MADRC")),
            m=files(l, lambda s: entry(s) & F.substring(s, 2, 1).isin(*"MD")),
            u=files(l, lambda s: s.startswith("?? ")),
            c=files(l, lambda s: entry(s) & F.substring(s, 1, 2).isin(*R.STATUS_CONFLICTS)))
        long = _let(verbose, v=F.filter(l, lambda s: not_blank(s) & ~trim_ws(s).rlike(R.STATUS_HINT)))
        return F.when(F.exists(l, lambda s: s.rlike(R.STATUS_LINE)), short).otherwise(long)

    return _let(either, l=_lines(raw))


def git_log_blocks(raw: Column, command: Column) -> Column:
    """Histories with an end-of-commit marker: header and first body line."""
    def cut(s: Column) -> Column:
        return F.when(F.length(s) <= R.LINE_WIDTH, s).otherwise(
            F.concat(first_chars(s, R.LINE_WIDTH - 3), F.lit("...")))

    def commit(block: Column) -> Column:
        lines = F.transform(F.split(block, "\n", -1), trim_ws)
        body = _first(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))),
                               lambda s: (s != "") & ~s.rlike(R.LOG_TRAILER)))
        return F.concat(cut(_first(lines)), F.coalesce(F.concat(F.lit("\n  "), cut(body)), F.lit("")))

    blocks = F.filter(F.transform(F.split(raw, R.LOG_BLOCK_END, -1), trim_ws), lambda s: s != "")
    return trim_ws(F.array_join(F.transform(blocks, commit), "\n"))


def git_simple(raw: Column, command: Column) -> Column:
    """``ok`` with the one fact that matters after push, pull, commit or add."""
    action = F.regexp_extract(trim_ws(F.lower(command)), r"^git\s+(push|pull|commit|add)(\s|$)", 1)
    current = raw.contains("up-to-date") | raw.contains("Already up to date")
    lines = _lines(raw)
    target = _first(F.filter(lines, lambda s: s.contains("->") & (F.size(F.split(trim_ws(s), r"\s+", -1)) >= 3)))
    target = F.element_at(F.split(trim_ws(target), r"\s+", -1), -1)
    pushed = F.when(current, "ok (up-to-date)").otherwise(
        F.concat(F.lit("ok"), F.coalesce(F.concat(F.lit(" "), target), F.lit(""))))
    stat = _last(F.filter(lines, lambda s: s.contains("file") & s.contains("changed")))
    pulled = _let(lambda s: F.when(_int(s, r"(\d+) file") > 0, F.format_string(
        "ok %d files +%d -%d", _int(s, r"(\d+) file"), _int(s, r"(\d+) insertion"), _int(s, r"(\d+) deletion")))
        .otherwise("ok"), s=stat)
    sha = first_chars(F.regexp_extract(_first(_filled(raw)), R.COMMIT_REF, 1), 7)
    committed = F.when(F.coalesce(sha, F.lit("")) == "", "ok").otherwise(F.concat(F.lit("ok "), sha))
    changed = _first(F.filter(lines, lambda s: s.contains("changed")))
    return (F.when(action == "push", pushed)
            .when(action == "pull", F.when(current, "ok (up-to-date)").otherwise(pulled))
            .when(action == "commit", F.when(raw.contains("nothing to commit"), "ok (nothing to commit)").otherwise(committed))
            .when(action == "add", F.when(changed.isNotNull(), F.concat(F.lit("ok "), trim_ws(changed)))
                  .when(trim_ws(raw) == "", "ok (nothing to add)").otherwise("ok"))
            .otherwise(head_text(raw)))


# --- devices, containers, tables ----------------------------------------------------------------


def adb_devices(raw: Column, command: Column) -> Column:
    devices = F.transform(F.filter(_filled(raw), lambda s: ~s.startswith("List of")), lambda s: F.when(
        s.contains("\t"), F.concat(F.split(s, "\t", -1)[0], F.lit(" ["), trim_ws(F.split(s, "\t", -1)[1]), F.lit("]")))
        .otherwise(trim_ws(s)))
    return _let(lambda d: F.when(F.size(d) == 0, "(no devices)").otherwise(
        F.format_string("%d device(s): %s", F.size(d), F.array_join(d, ", "))), d=devices)


def adb_install(raw: Column, command: Column) -> Column:
    return F.when(raw.contains("Success"), "ok installed").when(
        raw.rlike(R.INSTALL_FAILURE), F.concat(F.lit("FAILED: "), F.regexp_extract(raw, R.INSTALL_FAILURE, 1))
    ).otherwise(tail_text(raw))


def _table(raw: Column, row: Callable[[Column], Column], label: Column, empty: Column) -> Column:
    """A table with a header line: one compact line per row under a count."""
    def text(f: Column) -> Column:
        rows = F.transform(F.slice(f, F.lit(2), F.greatest(F.size(f), F.lit(1))), row)
        head = F.concat((F.size(f) - 1).cast("string"), F.lit(" "), label)
        return F.when(F.size(f) <= 1, empty).otherwise(_joined(F.array(head), rows))

    return _let(text, f=_filled(raw))


def _container(s: Column) -> Column:
    p = F.split(s, r"\s{2,}", -1)
    state = F.when(F.get(p, F.lit(4)) != "", F.get(p, F.lit(4))).otherwise(F.get(p, F.lit(3)))
    return F.when(F.size(p) >= 5, F.concat(first_chars(p[0], 12), F.lit(" "), p[1], F.lit(" ["), state,
                                           F.lit("] "), F.element_at(p, -1))).otherwise(trim_ws(s))


def _image(s: Column) -> Column:
    p = F.split(s, r"\s{2,}", -1)
    size = F.coalesce(F.get(p, F.lit(6)), F.get(p, F.lit(4)), F.lit(""))
    return F.when(F.size(p) >= 3, F.concat(p[0], F.lit(":"), p[1], F.lit(" "), size)).otherwise(trim_ws(s))


def docker_ps(raw: Column, command: Column) -> Column:
    return _table(raw, _container, F.lit("container(s)"), F.lit("(no containers)"))


def docker_images(raw: Column, command: Column) -> Column:
    return _table(raw, _image, F.lit("image(s)"), F.lit("(no images)"))


def docker(raw: Column, command: Column) -> Column:
    """Containers or images, as the command asks."""
    images = command.rlike(r"^\s*docker\s+images")
    return F.when(images, docker_images(raw, command)).otherwise(docker_ps(raw, command))


def _resource(s: Column) -> Column:
    p = F.split(trim_ws(s), r"\s+", -1)
    return F.when(F.size(p) >= 3, F.array_join(F.slice(p, 1, 5), " ")).otherwise(trim_ws(s))


def kubectl(raw: Column, command: Column) -> Column:
    return _table(raw, _resource, F.lit("resource(s)"), F.lit("(no resources)"))


def _item(s: Column) -> Column:
    p = F.split(s, "\t", -1)
    return F.when(F.size(p) >= 3, F.array_join(F.transform(F.slice(p, 1, 4), trim_ws), "  ")).otherwise(
        first_chars(trim_ws(s), 120))


def _gh_listed(command: Column) -> Column:
    return F.regexp_replace(trim_ws(command), r"^gh\s+", "")


def gh(raw: Column, command: Column) -> Column:
    """Tab-separated rows; the heading names the command after ``gh``."""
    return _let(lambda r: F.when(F.size(r) == 0, "(no results)").otherwise(
        _joined(F.array(F.format_string("%d item(s) [%s]:", F.size(r), _gh_listed(command))), r)), r=F.transform(_filled(raw), _item))


# --- package managers, environment -------------------------------------------------------------------


def npm(raw: Column, command: Column) -> Column:
    def text(e: Column, s: Column) -> Column:
        return (F.when(F.size(e) > 0, F.array_join(_head(e, R.NPM_ERROR_CAP), "\n"))
                .when(F.size(s) > 0, F.array_join(_head(s, R.NPM_SUMMARY_CAP), "\n")).otherwise(generic_text(raw)))

    kept = F.filter(_trimmed(raw), lambda s: ~(
        (s.rlike(R.NPM_NOISE) & ~s.rlike("(?i)error")) | s.rlike(R.NPM_SPINNER)))
    return _let(lambda t: _let(text, e=F.filter(t, lambda s: s.rlike(R.NPM_ERROR)),
                               s=F.filter(t, lambda s: ~s.rlike(R.NPM_ERROR) & s.rlike(R.NPM_SUMMARY))), t=kept)


def pnpm(raw: Column, command: Column) -> Column:
    def text(k: Column, d: Column) -> Column:
        head = F.coalesce(_first(F.filter(k, lambda s: s.rlike(R.PNPM_SUMMARY))),
                          F.format_string("%d packages", F.size(d)))
        rest = F.when(F.size(d) > R.PNPM_CAP, F.format_string("\n... +%d more", F.size(d) - R.PNPM_CAP)).otherwise("")
        long = F.concat(head, F.lit("\n"), F.array_join(_head(d, R.PNPM_CAP), "\n"), rest)
        return F.when(F.size(k) <= R.PNPM_PASS, F.array_join(k, "\n")).otherwise(long)

    kept = F.filter(_filled(raw), lambda s: ~trim_ws(s).rlike(R.PNPM_NOISE))
    return _let(lambda k: _let(text, k=k, d=F.filter(k, lambda s: s.rlike(R.PNPM_DEPENDENCY))), k=kept)


def pip(raw: Column, command: Column) -> Column:
    def text(k: Column) -> Column:
        long = F.format_string("%d packages\n%s\n... +%d more", F.size(k),
                               F.array_join(_head(k, R.PIP_CAP), "\n"), F.size(k) - R.PIP_CAP)
        return F.when(F.size(k) <= R.PIP_PASS, F.array_join(k, "\n")).otherwise(long)

    return _let(text, k=F.filter(_filled(raw), lambda s: ~trim_ws(s).rlike(R.PIP_NOISE)))


def prettier(raw: Column, command: Column) -> Column:
    return _let(lambda k: F.when(F.size(k) == 0, "prettier ok").otherwise(F.format_string(
        "%d file(s) need formatting:\n%s", F.size(k), F.array_join(_head(k, R.PRETTIER_CAP), "\n"))),
        k=F.filter(_filled(raw), lambda s: ~s.rlike(R.PRETTIER_BANNER)))


def prisma(raw: Column, command: Column) -> Column:
    kept = F.filter(_trimmed(raw), lambda s: (
        ~s.rlike(R.PRISMA_BOX) & ~s.rlike(R.PRISMA_RULE) & s.rlike(R.PRISMA_KEEP)))
    return _let(lambda k: F.when(F.size(k) > 0, F.array_join(k, "\n")).otherwise(generic_text(raw)), k=kept)


def env(raw: Column, command: Column) -> Column:
    def masked(s: Column) -> Column:
        at = F.instr(s, "=")
        return mask_value(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)), s)
    return _let(lambda k: F.when(F.size(k) == 0, "(no matching vars)").otherwise(F.array_join(k, "\n")),
                k=F.transform(F.filter(_lines(raw), lambda s: s.contains("=")), masked))


# --- JSON --------------------------------------------------------------------------------------------


def _described(value: Column, depth: int) -> Column:
    """Structure of a VARIANT down to three levels, members in key order."""
    pad = "  " * depth
    if depth >= R.JSON_DEPTH:
        return F.lit(pad + "...")
    kind = type_of_schema(F.schema_of_variant(value))
    items = F.try_variant_get(value, "$", "array<variant>")

    def member(key: Column, val: Column) -> Column:
        inner = type_of_schema(F.schema_of_variant(val))
        text = (F.when(inner == "string", F.format_string("string(%d)", F.length(F.try_variant_get(val, "$", "string"))))
                .when(inner == "array", F.format_string("Array(%d)", F.size(F.try_variant_get(val, "$", "array<variant>"))))
                .when(inner == "object", F.concat(F.lit("{\n"), _described(val, depth + 2), F.lit(f"\n{pad}  }}")))
                .otherwise(inner))
        return F.concat(F.lit(pad + "  "), key, F.lit(": "), text)

    members = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")),
                          lambda e: member(e["key"], e["value"]))
    listed = F.concat(F.format_string(f"{pad}Array(%d) [\n", F.size(items)),
                      _described(F.get(items, F.lit(0)), depth + 1), F.lit(f"\n{pad}]"))
    return (F.when(kind == "object", F.when(F.size(members) == 0, pad + "{}").otherwise(F.array_join(members, "\n")))
            .when(kind == "array", F.when(F.size(items) == 0, pad + "[]").otherwise(listed))
            .otherwise(F.concat(F.lit(pad), kind)))


def json(raw: Column, command: Column) -> Column:
    return _let(lambda v: F.when(v.isNotNull(), _described(v, 0)).otherwise(generic_text(raw)), v=F.try_parse_json(raw))


def curl(raw: Column, command: Column) -> Column:
    """JSON bodies as structure, others as generic cut; headers are dropped."""
    return json(strip_http_headers(raw), command)
