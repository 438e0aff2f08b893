"""The end-to-end job: routing, own strategies, headers, missing text."""

from pyspark.sql import functions as F

from capsift.plans.compress import NARROW, GROUPED, STRATEGIES, compress, compress_with, with_header
from conftest import dicts


def test_mixed_captures(spark):
    rows = [(1, "git status", 0, "## main\nM  a.py"), (2, "cat app.log", 0, "ERROR x\nERROR x"),
            (3, "docker ps", 127, "bash: docker: command not found"), (4, "ls -la", 0, None),
            (5, "rg needle src", 0, "src/a.py:3:" + "pad " * 60 + "needle" + " tail" * 60), (6, "make", 2, "x\n" * 60)]
    captures = spark.createDataFrame(rows, "capture_id long, command string, exit_code int, raw string")
    got = dicts(compress(captures), "capture_id")
    assert [r["strategy"] for r in got] == ["git-status", "logs", "generic", "ls", "grep", "generic"]
    texts = {r["capture_id"]: r["filtered"] for r in got}
    assert texts[1] == "* main\n+ Staged: 1 files\n   a.py"
    assert "  [x2] ERROR x" in texts[2] and texts[3] == rows[2][3] and texts[4] == "(empty)" and texts[6] == "x"
    assert "needle" in texts[5] and "..." in texts[5]  # cut around what the command searched for
    shown = with_header(compress(captures).join(captures.select("capture_id", "exit_code"), "capture_id"))
    heads = [r["shown"].split("\n")[0] for r in dicts(shown, "capture_id")]
    assert heads[0].endswith("tokens]") and heads[2] == "[exit: 127]" and heads[5] == "[exit: 2]"


def test_own_strategy(spark, make_captures):
    def shout(captures):
        return captures.select("capture_id", "strategy", "raw_tokens", F.upper("raw").alias("filtered"))

    captures = make_captures((1, "cat app.log", "abc"), (2, "git push", "x"))
    assert [r["filtered"] for r in dicts(compress(captures, {"logs": shout}), "capture_id")] == ["ABC", "ok"]


def test_narrow_and_grouped_cover_the_router():
    from capsift.rules import ROUTES

    routed = {name for name, _ in ROUTES} | {"json", "generic", "passthrough"}
    assert routed == set(NARROW) | set(GROUPED) and len(routed) == 19


def test_every_strategy_takes_any_text(spark, make_captures):
    """No reader fails on, or loses, a capture that is not in its format."""
    captures = make_captures((1, "x", "plain words"), (2, "x", ""), (3, "x", "a\n" * 50), (4, "x", "{\"a\": [1]}"))
    for name in STRATEGIES:
        assert compress_with(captures, name).where("filtered is not null").select("capture_id").distinct().count() == 4, name


def test_missing_command_is_no_success(spark):
    text = "bash: X: command not found"
    captures = spark.createDataFrame([(1, "x", text, 127), (2, "x", None, 0)], "capture_id long, command string, raw string, exit_code int")
    for name in ("tsc", "ruff", "cargo", "kubectl"):
        found = {r.capture_id: r.filtered for r in compress_with(captures, name).collect()}
        assert found[1] == text and set(found) >= {1}
    plain = spark.createDataFrame([(1, "x", "sh: 1: tsc: not found"), (2, "x", "a.ts(1,2): error TS1: tool not found\nmore")],
                                  "capture_id long, command string, raw string")
    found = {r.capture_id: r.filtered for r in compress_with(plain, "tsc").collect()}
    assert found[1] == "sh: 1: tsc: not found" and "TS1" in found[2] and found[2] != plain.collect()[1].raw
    routed = spark.createDataFrame([(1, "make build", text, 127)], "capture_id long, command string, raw string, exit_code int")
    assert [(r.strategy, r.filtered) for r in compress(routed).collect()] == [("generic", text)]


def test_cargo_without_tests_passes(spark, make_captures):
    raw = "running 0 tests\n\ntest result: ok. 0 passed; 0 failed; 0 ignored"
    assert compress_with(make_captures((1, "cargo test", raw)), "cargo").first().filtered == "PASSED: 0 tests"
