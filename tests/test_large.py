"""Captures that are too large for a cell: the same rows from their lines, and no text of theirs in a cell."""

import random

from pyspark.sql import functions as F

import capsift.plans.compress as plans
from capsift.plans import catalog
from capsift.plans.compress import compress, compress_lines
from capsift.plans.q_tools import TOOLS, tool_lines
from capsift.plans.views import view
from conftest import SF_DIR
from test_cells import PARTS

catalog.load()

#: command -> lines that its texts are made of
TEXTS = {
    "git status": ["## main...origin", "M  a.py", " M b.py", "?? c.py", "UU d.py", "MM e.py", "!! f", "A  g", "", "## second"], "git log": PARTS["history"],
    "git diff": PARTS["diff"], "rg -n needle src": PARTS["grep"] + ["end:  "], "find . -type f": PARTS["find"] + ["\t", " "], "ls -la": PARTS["ls"], "npx tsc --noEmit": PARTS["tsc"],
    "eslint src": PARTS["lint"], "ruff check .": PARTS["ruff"] + ["a(1,2): error TS1: x.py:1:2: E1 y"], "cargo build": ["error: a", "warning: b", "0 errors found", "error: c", "x", ""],
    "cargo test": PARTS["cargo"], "pytest": PARTS["pytest"], "go test ./...": PARTS["go"], "npx vitest run": PARTS["vitest"][:-1],
    "npm install": ["npm warn deprecated", "added 3 packages", " npm ERR! x ", "done", "", "notice error audited", "⠋ added"], "pip install x": ["Collecting x", "WARNING y", "", " Requirement already z", "  b"],
    "kubectl logs web": PARTS["logs"], "kubectl get pods": ["NAME   READY   STATUS", "pod-1   1/1   Running   2   3d   10.0.0.1", "odd", "", "  "],
    "docker ps": ["CONTAINER ID  IMAGE", "c1234567890abcdef  img:1  \"run\"  2 days ago  Up  80/tcp  web", "odd", ""], "gh pr list": ["#1\tname\tOPEN\tx", "y" * 130, "", " "],
    "printenv": ["API_KEY=1", "PATH=" + "v" * 100, "none", ""], "./gradlew tasks": PARTS["tasks"], "make": ["a", "b", "", *[f"l{i}" for i in range(60)]], "cat x.json": ["[1]", "x"],
}


def lines_of(spark, texts):
    rows = [(i, code, n * 3, line) for i, (code, lines) in enumerate(texts) for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "capture_id long, exit_code int, line_no long, line string").repartition(5)


def test_pages_equal_cells(spark):
    """Random texts around the bound, and those that pages don't take: nothing found, line ends, a missing tool, a line without text."""
    rng, sources, joined = random.Random(7), {}, F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    for command, parts in TEXTS.items():
        texts = [(0, [rng.choice(parts) for _ in range(n)]) for n in (1, 49, 50, 51, 60, 90, 300, 900)]
        for few in range(2):  # texts of some of the lines only
            some = rng.sample(parts, max(1, len(parts) // 3))
            texts += [(0, [rng.choice(some) for _ in range(n)]) for n in (55, 400)]
        texts += [(127, parts * 20), (0, [*parts * 20, "a\nb"]), (0, [*parts * 20, None]), (0, ["plain"] * 99), (0, [""] * 99), (0, ["no tests found", *parts * 20]), (0, ["", "[", *parts * 20])]
        sources[command] = lines_of(spark, texts).withColumn("capture_id", F.col("capture_id") + 1000 * len(sources)).cache()
    whole = plans._united([rows.groupBy("capture_id", "exit_code").agg(joined.alias("raw")).withColumn("command", F.lit(command)) for command, rows in sources.items()])
    routed = ("git status", "cargo build", "rg -n needle src", "pip install x", "make", "cat x.json")
    for by, commands in (("tool", tuple(TEXTS)), ("command", routed)):
        want = {r.capture_id: r for r in compress(whole.where(F.col("command").isin(*commands)), by=by).collect()}
        got = {r.capture_id: r for r in compress_lines({c: sources[c] for c in commands}, by=by, cell_lines=50).collect()}
        assert got.keys() == want.keys()
        for i, row in want.items():
            assert got[i] == row, (list(TEXTS)[i // 1000], i)


def test_large_texts_stay_out_of_cells(spark, monkeypatch):
    """The query's rows with a bound that most captures are beyond, and the longest text that reaches a cell."""
    want = sorted(map(tuple, catalog.QUERIES["savings_by_strategy"](spark, SF_DIR).collect()))
    longest, narrow = [], plans.narrow_texts

    def seen(routed, *texts):
        longest.append(routed.agg(F.max(F.size(F.split("raw", "\n", -1)))).first()[0])
        return narrow(routed, *texts)

    monkeypatch.setattr(plans, "narrow_texts", seen)
    monkeypatch.setattr(plans, "CELL_LINES", 45, raising=False)
    assert sorted(map(tuple, catalog.QUERIES["savings_by_strategy"](spark, SF_DIR).collect())) == want
    assert max(longest) <= 45


def test_tool_lines_are_the_view(spark):
    lines = tool_lines(spark, SF_DIR)
    assert list(lines) == list(TOOLS)
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "line")))["line"], "\n")
    rows = plans._united([rows.groupBy("capture_id", "exit_code").agg(joined.alias("raw")).withColumn("command", F.lit(c)) for c, rows in lines.items()])
    whole = view(spark, SF_DIR, "v_tool_runs")
    assert rows.select(*whole.columns).exceptAll(whole).isEmpty() and whole.exceptAll(rows.select(*whole.columns)).isEmpty()
