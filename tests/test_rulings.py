"""Golden captures: one per ruling where the naive reading of a format is wrong."""

from capsift.operators import builds, diagnostics, gitops, ledger, logs, matches, route, testruns
from capsift.plans.compress import compress_with
from capsift.sources.readers import captures as build_captures
from conftest import dicts


def outcome(lines, fmt):
    return testruns.test_outcomes(lines, (fmt,)).first().asDict()


def test_counters_are_read_apart(make_lines):
    for fmt in ("pytest", "generic"):
        got = outcome(make_lines({1: "===== 1 failed, 2 passed in 0.1s ====="}), fmt)
        assert (got["passed"], got["failed"], got["total"]) == (2, 1, 3)


def test_cargo_sums_over_crates(make_lines):
    text = "test result: FAILED. 1 passed; 2 failed; 0 ignored\ntest result: ok. 5 passed; 0 failed; 0 ignored"
    got = outcome(make_lines({1: text}), "cargo")
    assert (got["passed"], got["failed"]) == (6, 2)


def test_summary_wins_over_ticks(make_lines):
    got = outcome(make_lines({1: " ✓ a\n ✓ b\n × c\n Tests  1 failed | 2 passed"}), "vitest")
    assert (got["passed"], got["failed"]) == (2, 1)
    got = outcome(make_lines({1: " ✓ a\n ✓ b\n × c"}), "vitest")
    assert (got["passed"], got["failed"]) == (2, 1)


def test_go_packages_are_no_tests(make_lines):
    got = outcome(make_lines({1: "--- FAIL: TestA (0.0s)\nFAIL\texample/p 0.1s"}), "go")
    assert (got["failed"], got["failed_packages"]) == (1, 1)


def test_pytest_block_lines(make_lines):
    text = "____ test_a ____\nE   assert 1 == 2\n=====\nassert outside\nFAILED t.py::a"
    got = dicts(testruns.test_failures(make_lines({1: text}), ("pytest",)), "rank")
    # Four underscores open no block.
    assert [r["line"] for r in got] == ["FAILED t.py::a"]
    got = dicts(testruns.test_failures(make_lines({1: "_" + text}), ("pytest",), chunk=2), "rank")
    assert [r["line"] for r in got] == ["E   assert 1 == 2", "FAILED t.py::a"]


DIFF = """diff --git a/q.sql b/q.sql
--- a/q.sql
+++ b/q.sql
@@ -1,3 +1,3 @@
 keep
--- an old sql comment
+++ a new one
-x"""


def test_removed_comment_lines_count(make_lines):
    for plain in (True, False):
        row = gitops.diff_stat(make_lines({1: DIFF}), plain).first()
        assert (row["file"], row.added, row.removed) == ("q.sql", 1, 2)


PLAIN = """--- old/a.py\t2024-01-01
+++ b/a.py\t2024-01-02
@@ -1 +1 @@
-x
+y
--- old/b.py
+++ b/b.py
@@ -2 +2 @@
+z"""


def test_diff_without_git_header(make_lines):
    for chunk in (None, 2, 3, 65536):
        got = dicts(gitops.diff_stat(make_lines({1: PLAIN}), chunk=chunk), "file_at")
        assert [(r["file"], r["added"], r["removed"]) for r in got] == [("a.py", 1, 1), ("b.py", 1, 0)]


def test_context_only_after_a_change(make_lines):
    got = dicts(gitops.diff_condense(make_lines({1: DIFF.replace("-x", " tail\n@@ -9 +9 @@\n ctx\n+n")})), "line_no")
    assert [r["line"] for r in got] == ["q.sql", "-1,3 +1,3", "--- an old sql comment", "+++ a new one", " tail",
                                       "-9 +9", "+n"]


def test_diff_caps(make_lines):
    long = "diff --git a/f b/f\n@@ -1 +1 @@\n" + "\n".join(f"+l{i}" for i in range(40))
    shown = gitops.diff_condense(make_lines({1: long}))
    assert shown.where("kind = 'line'").count() == 30 and shown.where("truncated").count() == 30
    assert gitops.diff_stat(make_lines({1: long})).first().added == 40
    many = "\n".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +1 @@\n+a" for i in range(100))
    assert gitops.diff_condense(make_lines({1: many})).count() == 200


def test_json_shows_no_values(make_captures):
    text = compress_with(make_captures((1, "c", '{"a": 42, "b": true, "s": "secret"}')), "json").first().filtered
    assert text == "  a: number\n  b: boolean\n  s: string(6)"


def test_subcommand_decides_the_outcome(spark):
    rows = [(1, 0, 'git commit -m "push x"', "[main abcdef123] push x")]
    df = spark.createDataFrame(rows, "capture_id long, line_no long, command string, line string")
    got = gitops.git_outcome(df).first()
    assert (got.action, got.status, got.ref) == ("commit", "ok", "abcdef1")


def test_lint_counts_both_levels(make_captures):
    text = compress_with(make_captures((1, "eslint .", "f.js\n  1:2  warning  Unexpected y  no-y")), "lint").first().filtered
    assert text.startswith("0 error(s), 1 warning(s) across 1 rule(s):")


def test_stderr_survives_success(spark):
    df = spark.createDataFrame([(1, "t", "c", 0, "out\r\n", "warn\r"), (2, "t", "c", 0, "out", "")],
                               "capture_id long, tool string, command string, exit_code int, stdout string, stderr string")
    assert [r["raw"] for r in dicts(build_captures(df), "capture_id")] == ["out\n\nwarn", "out"]


def test_logcat_counts_a_line_once(make_lines):
    text = "\n".join(["I/a: x"] * 25 + ["F/AndroidRuntime: FATAL EXCEPTION"])
    got = dicts(logs.logcat_summary(make_lines({1: text})))
    assert [(r["section"], r["total"]) for r in got] == [("fatal", 1)]


def test_logcat_quiet_and_short(make_lines):
    quiet = dicts(logs.logcat_summary(make_lines({1: "\n".join(f"I/a: {i}" for i in range(30))})), "rank")
    assert [r["line"] for r in quiet] == [f"I/a: {i}" for i in range(29, 19, -1)]
    assert {r["section"] for r in dicts(logs.logcat_summary(make_lines({1: "I/a: x\nE/b: y"})))} == {"pass"}


def test_images_use_the_image_rule(make_captures):
    raw = "REPOSITORY   TAG   IMAGE ID   CREATED   SIZE\nnginx   latest   abc   2 days ago   100MB"
    assert compress_with(make_captures((1, "docker images", raw)), "docker").first().filtered == "1 image(s)\nnginx:latest 100MB"


def test_headers_are_stripped(make_captures):
    raw = 'HTTP/1.1 200 OK\nx: y\n\n{"a": [1, 2]}'
    assert compress_with(make_captures((1, "curl x", raw)), "curl").first().filtered == "  a: Array(2)"


def test_history_ties_break_by_id(spark):
    rows = [(1, "2024-01-01 00:00:00"), (3, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, ts string").selectExpr(
        "id", "cast(ts as timestamp) as ts", "'c' as raw_cmd", "'t' as tool", "10L as raw_tokens", "5L as tokens_saved")
    assert [r.id for r in ledger.ledger_history(df, 2).collect()] == [3, 2]
    try:
        ledger.ledger_history(df, 0)
        raise AssertionError("n = 0 must be rejected")
    except ValueError:
        pass


def test_windows_paths(make_lines):
    got = dicts(matches.parse_matches(make_lines({1: "C:\\x.py:3:y\nsrc/a.py:7:z:w\nplain:text\nnothing"})), "line_no")
    assert [(r["file"], r["row"], r["content"]) for r in got] == [("C:\\x.py", 3, "y"), ("src/a.py", 7, "z:w"), ("plain", 0, "text")]


def test_conflicts(make_lines):
    got = {r["section"]: r["total"] for r in dicts(gitops.status_summary(make_lines({1: "## main\nDU a\nAA b\nUU c\n    d\nM  e"})))}
    assert got == {"branch": 1, "conflict": 3, "staged": 3}


def test_verbose_status_is_no_porcelain(make_captures):
    raw = "On branch main\n    indented\nnothing to commit, working tree clean\nlater"
    text = compress_with(make_captures((1, "git status", raw)), "git-status").first().filtered
    assert text == "On branch main\n    indented\nnothing to commit, working tree clean"


def test_not_found_inside_a_log_changes_nothing(make_captures):
    raw = "file not found in cache, continuing\ntest result: ok. 3 passed; 0 failed; 0 ignored"
    assert compress_with(make_captures((1, "cargo test", raw)), "cargo").first().filtered == "PASSED: 3 tests"


def test_camel_case_targets_route_to_build(spark):
    df = spark.createDataFrame([(1, "x assembleDebug", ""), (2, "cat test.log", ""), (3, "cat data.json", "no json"),
                                (4, "cat data.json", "[1]"), (5, "x", "\n" * 45)], "capture_id long, command string, raw string")
    assert [r["strategy"] for r in dicts(route.route_strategy(df), "capture_id")] == ["build", "test", "passthrough", "json", "generic"]


def test_build_errors_win_and_totals_count_repeats(make_lines):
    got = dicts(builds.build_issues(make_lines({1: "error: a warning: b\nerror: a warning: b\n0 errors found\nwarning: w"})), "section")
    assert [(r["section"], r["total"], r["n_distinct"]) for r in got] == [("error", 2, 1), ("warning", 1, 1)]


def test_biome_and_missing_location(make_lines, spark):
    found = diagnostics.diagnostics(make_lines({1: "src/a.ts 3:4 ━━━━ lint/style: use const"}))
    assert (found.first().tool, found.first().file, found.first().rule) == ("biome", "src/a.ts", "lint")
    raw = '[{"filename":"p.py","message":"m","code":"E1"}]'
    df = spark.createDataFrame([(1, 0, raw)], "capture_id long, line_no long, raw string")
    assert diagnostics.json_diagnostics(df).first().row is None
