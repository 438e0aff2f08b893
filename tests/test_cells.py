"""Cell readers against the readers over line tables, on texts made of each format's own lines."""

import random

import pytest
from pyspark.sql import functions as F

from capsift.operators import cells, render
from capsift.plans import catalog
from capsift.plans.compress import compress
from capsift.plans.views import view
from conftest import SF_DIR

catalog.load()

PARTS = {
    "logs": ["2024-01-01 10:00:00 ERROR job 1234 failed", "2024-01-02 10:00:00 ERROR job 9999 failed", "WARN disk /dev/sda1 low", "warning x", "INFO ok", "panic: 0xff",
             "plain", "", "FATAL " + "y" * 120, *[f"error kind{chr(97 + i)}" for i in range(14)], *[f"warn kind{chr(97 + i)}" for i in range(8)]],
    "ls": ["-rw-r--r--  1 root root 2048 Jan 1 10:00 a b.py", "drwxr-xr-x 2 r r 40 Jan 1 10:00 src", "drwxr-xr-x 2 r r 40 Jan 1 10:00 node_modules", "total 8",
           "-rw-r--r-- 1 r r 5 Jan 1 10:00 noext", "01/02/2024  10:00 AM    <DIR>          wdir", "01/02/2024  10:00 AM         1,234,567 w f.ts", "1 File(s) 5",
           *[f"-rw-r--r-- 1 r r {10 ** i} Jan 1 10:00 f{i}.e{i}" for i in range(8)], "drwxr-xr-x 2 r r 40 Jan 1 10:00 .", "", "-rw-r--r-- 1 r r x"],
    "find": ["a/b/c.py", "a/b/d.py", "a/b/e.py", "a/b/f.py", "a/b/g.py", "a/b/h.py", "top", "x/y", "/abs/z", "q/" + "n" * 30, ""],
    "grep": ["src/a.py:3:needle here", "src/a.py:7:" + "pad " * 50 + "needle" + " t" * 60, "src/b.py:no row", "C:\\x.py:3:y", "/very/long/path/that/goes/on/and/on/for/more/than/fifty/x.py:12345:z",
             "nothing", "", *[f"f{i}.py:{i}:needle" for i in range(14)]],
    "tasks": ["Build tasks", "-----------", "build - Builds it", "clean - Cleans", "Help tasks", "help - Shows", "tasks - all tasks", "   indented tasks", "other line", "",
              *[f"t{i} - task {i}" for i in range(9)]],
    "diff": ["diff --git a/x.py b/x.py", "diff --git a/y b/y", "--- a/x.py\t2024", "+++ b/x.py\t2024", "@@ -1,3 +1,4 @@ def f", "+new", "-old", " ctx", "--- comment", "+++ more", "\\ No newline", "", "diff --git broken",
             *["+line"] * 12, "@@"],
    "history": ["commit abcdef1234567890", "Author: A <a@b>", "", "    Fix the thing " + "long " * 20, "    second", "abcdef1 one line", "    ", "text", "commit 1234abc"],
    "tsc": ["src/a.ts(1,2): error TS2304: Bad", "src/a.ts(3,4): warning TS1: W", "src/b.ts(5,6): error TS7: Other  ", "noise error TS", "", *["src/c.ts(1,1): error TS1: n"] * 12],
    "ruff": ["pkg/a.py:1:2: E501 line too long", "pkg/b.py:3:4: F401 unused", "noise", "", *["pkg/c.py:1:1: E1 n"] * 12],
    "lint": ["/src/a.js", "  1:2  error  Unexpected x  no-x", "  3:4  warning  Unexpected y  no-y", "  5:6  error  Other  no-x", "src/a.ts 3:4 ━━━━ lint/style: use const", "3 problems", "",
             *[f"  1:2  error  Message {i}  no-x" for i in range(7)]],
    "cargo": ["test result: ok. 3 passed; 0 failed; 0 ignored", "test result: FAILED. 1 passed; 2 failed; 0 ignored", "test a ... FAILED", "test b ... ok", "thread 'm' panicked at x", "error: x", "warning: y", "",
              *[f"test t{i} ... FAILED" for i in range(25)]],
    "pytest": ["_____ test_a _____", "E   assert 1 == 2", "    assert x", "===== 1 failed, 2 passed in 0.1s =====", "===== 5 passed =====", "FAILED t.py::a - x", "plain", "", "=======", "E  " + "z" * 150, "2 passed"],
    "go": ["--- FAIL: TestA (0.0s)", "--- PASS: TestB (0.0s)", "FAIL\texample/p 0.1s", "ok  \texample/q 0.2s", '{"Action":"fail","Test":"TJ"}', '{"Action":"pass","Test":"TK"}', '{"Action":"fail"}', "", "{broken"],
    "vitest": [" ✓ a", " × c", "FAIL x", "PASS y", " Tests  1 failed | 2 passed", "Tests  3 passed", "AssertionError: z", "Expected 1", "", "no tests found"],
    "playwright": ["✓ a (1.2s)", "✗ b", "2 passed (3s)", "1 failed", "expect(x) to be", "Error: y", "", "passed without time"],
}
JSON = {
    "ruff": ['[{"filename":"p.py","message":"m","code":"E1","location":{"row":1,"column":2}},{"filename":"q.py","message":"n","code":"E2"}]', "[]", "[broken"],
    "golangci": ['{"Issues":[{"FromLinter":"l1","Text":"t","Pos":{"Filename":"f.go","Line":3}},{"FromLinter":"l2","Text":"u"}]}', '{"Issues":[]}', '{"Issues":null}', "error: build", "{x",
                 '{"Issues":[' + ",".join(['{"FromLinter":"a","Text":"t"}'] * 8) + "]}"],
}
READERS = {
    "logs": (cells.logs, render.log_text, "cat x.log"), "ls": (cells.ls, render.ls_text, "ls"), "find": (cells.find, render.find_text, "find ."),
    "grep": (cells.grep, render.grep_text, "rg -n needle src"), "tasks": (cells.tasks, render.tasks_text, "gradle tasks"),
    "git-diff": (cells.git_diff, render.git_diff_text, "git diff"), "diff": (cells.diff, render.diff_text, "diff a b"),
    "history": (cells.git_log, render.history_text, "git log"), "tsc": (cells.tsc, render.tsc_text, "tsc"), "ruff": (cells.ruff, render.ruff_text, "ruff"),
    "lint": (cells.lint, render.lint_text, "eslint"), "golangci": (cells.golangci, render.golangci_text, "golangci-lint"),
    **{f: (getattr(cells, f), render.runner_text(f), f) for f in ("cargo", "pytest", "go", "vitest", "playwright")},
}


def texts(name, parts):
    rng = random.Random(name)
    out = ["", "\n\n", "plain", *JSON.get(name, [])]
    out += ["\n".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 4, 8, 20, 60, 260]))) for _ in range(40)] if parts else []
    return out + (["\n".join(parts), "\n".join(parts * 3)] if parts else [])


@pytest.mark.parametrize("name", sorted(READERS))
def test_cells_equal_line_tables(spark, name):
    cell, table, command = READERS[name]
    rows = [(i, command, t) for i, t in enumerate(texts(name, PARTS.get("diff" if name == "git-diff" else name)))]
    df = spark.createDataFrame(rows, "capture_id long, command string, raw string").repartition(4).cache()
    got = {r.capture_id: r.filtered for r in df.select("capture_id", cell(F.col("raw"), F.col("command")).alias("filtered")).collect()}
    want = {r.capture_id: r.filtered for r in table(df).collect()}
    for i, _, raw in rows:
        assert got[i] == want[i], raw


def test_cells_are_narrow(spark):
    df = spark.createDataFrame([(1, "x", "y")], "capture_id long, command string, raw string")
    for name, (cell, _, _) in READERS.items():
        plan = df.select(cell(F.col("raw"), F.col("command")))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan, name


def test_tool_texts_are_sorted_natively(spark):
    """No comparison by an expression per pair of lines."""
    for rows in (view(spark, SF_DIR, "v_tool_runs"), compress(view(spark, SF_DIR, "v_tool_runs"), by="tool")):
        assert "array_sort(" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("files", [1, 199, 200, 201, 202, 450])
def test_diffs_at_the_border_of_their_cap(spark, files):
    """Files that only have a header, one hunk at the very end: the same text as from the line tables."""
    raw = "\n".join(f"diff --git a/f{i} b/f{i}" for i in range(files)) + "\n@@ -1 +1 @@\n+a\n-b"
    rows = spark.createDataFrame([(1, "git diff", raw)], "capture_id long, command string, raw string")
    cell = rows.select(cells.git_diff(F.col("raw"), F.col("command"))).first()[0]
    assert cell == render.git_diff_text(rows).first().filtered
    assert ("more changes truncated" in cell) == (files + 3 > 200)


def test_search_results_with_drives_and_rows(spark):
    raw = "\n".join(["C:\\a\\b.py:12:x:y", "C:\\a\\b.py:z", "d:e", "no match", "C:/k:", "a:7:", "é:ü:5:ö"])
    rows = spark.createDataFrame([(1, "rg x", raw), (2, "rg x", "none\n\nat all"), (3, "rg x", "")], "capture_id long, command string, raw string")
    got = {r.capture_id: r.filtered for r in rows.select("capture_id", cells.grep(F.col("raw"), F.col("command")).alias("filtered")).collect()}
    assert got == {r.capture_id: r.filtered for r in render.grep_text(rows).collect()}
    assert got[1].startswith("6 matches in 5F:") and "    12: x:y" in got[1] and got[2] == "none\nat all"
