"""Sources, sinks and streams over files written by the test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from capsift.operators import ledger
from capsift.operators.ledger import ledger_daily
from capsift.plans.views import table, view
from capsift.sources import readers, sinks
from capsift.streaming.ledger import stream_ledger_daily
from capsift.streaming.logs import stream_log_templates
from capsift.streaming.run import read_stream, run_available
from conftest import SF_DIR, dicts


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a.log": "x\r\ny", "sub/b.py": "z", "node_modules/c.js": "q", "plain": "p"}.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(tmp_path / "in")


def test_text_files_become_captures(spark, tree):
    got = {r.path.rsplit("/", 1)[1]: r.raw for r in readers.text_captures(spark, tree).collect()}
    assert got == {"a.log": "x\ny", "b.py": "z", "c.js": "q", "plain": "p"}


def test_listing_prunes_noise_and_content(spark, tree):
    df = readers.listing(spark, tree)
    assert {(r["name"], r["ext"], r["size"]) for r in df.collect()} == {("a.log", ".log", 4), ("b.py", ".py", 1), ("plain", "no ext", 1)}
    assert readers.listing(spark, tree, show_all=True).count() == 4
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_captures_from_files(spark, tmp_path, fmt):
    src = view(spark, SF_DIR, "v_captures")
    src.write.format(fmt).save(str(tmp_path / fmt))
    got = readers.read_captures(spark, str(tmp_path / fmt), fmt, None if fmt != "json" else src.schema.simpleString()[7:-1].replace(":", " "))
    assert got.select("capture_id", "raw").exceptAll(readers.captures(src).select("capture_id", "raw")).count() == 0


def test_ledger_round_trip(spark, tmp_path):
    rows, path = view(spark, SF_DIR, "v_ledger").withColumn("block_reason", F.lit(None).cast("string")), str(tmp_path / "ledger")
    sinks.append_ledger(rows.where("id % 2 = 0"), path)
    sinks.append_ledger(rows.where("id % 2 = 1"), path)
    back = spark.read.parquet(path)
    assert ledger.ledger_summary(back).first() == ledger.ledger_summary(rows).first()
    assert "PartitionFilters: [isnotnull(date" in back.where("date = date'2024-01-05'")._jdf.queryExecution().executedPlan().toString()


def test_failures_are_kept_whole(spark, tmp_path):
    captures = readers.captures(view(spark, SF_DIR, "v_captures"))
    sinks.write_failures(captures, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == captures.where("exit_code <> 0").count()
    sinks.write_failures(captures, str(tmp_path / "few"), 5)
    want = [r.capture_id for r in captures.where("exit_code <> 0").orderBy(F.desc("capture_id")).limit(5).collect()]
    assert sorted(r.capture_id for r in spark.read.parquet(str(tmp_path / "few")).collect()) == sorted(want)


@pytest.fixture
def ledger_files(spark, tmp_path):
    """The ledger as several files in time order."""
    path = str(tmp_path / "stream")
    rows = view(spark, SF_DIR, "v_ledger").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(5, "ts").write.parquet(path)
    return path


def test_daily_stream_complete_equals_batch(spark, ledger_files):
    got = run_available(spark, stream_ledger_daily(read_stream(spark, ledger_files)), "t", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger_daily(spark.read.parquet(ledger_files), None).collect()))


def test_daily_stream_append_equals_batch_on_closed_days(spark, ledger_files):
    stream = stream_ledger_daily(read_stream(spark, ledger_files, files_per_trigger=1), delay="40 days")
    assert run_available(spark, stream, "t").count() == 0  # nothing closes within the delay
    batch = {r["date"]: (r["runs"], r["tokens_saved"]) for r in ledger_daily(spark.read.parquet(ledger_files), None).collect()}
    got = {r["date"]: (r["runs"], r["tokens_saved"]) for r in run_available(
        spark, stream_ledger_daily(read_stream(spark, ledger_files)), "t").collect()}
    assert got and all(batch[day] == value for day, value in got.items())
    closed = max(batch) - dt.timedelta(days=2)
    assert {day for day in batch if day <= closed} <= set(got)


def test_replayed_lines_count_once(spark, tmp_path):
    lines = view(spark, SF_DIR, "v_log_lines").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "lines")
    lines.write.parquet(path)
    lines.where("line_no % 3 = 0").write.mode("append").parquet(path)  # replay
    once = run_available(spark, stream_log_templates(read_stream(spark, path), delay="3650 days"), "t", "complete")
    both = run_available(spark, stream_log_templates(read_stream(spark, path), delay="3650 days", dedupe=False), "t", "complete")
    plain = spark.createDataFrame(stream_log_templates(lines, dedupe=False).collect(), once.schema)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, plain.collect()))
    assert both.agg(F.sum("n")).first()[0] > once.agg(F.sum("n")).first()[0]


def test_template_state_shrinks_with_the_watermark(spark, tmp_path):
    """Lines that come in time order: two days of delay lose no window, and passed days leave the state."""
    lines = view(spark, SF_DIR, "v_log_lines").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = lines.agg(F.min("ts"), F.max("ts")).first()
    days = (last - first).days + 1
    path, out, state = (str(tmp_path / name) for name in ("lines", "out", "state"))
    totals = []
    for start in range(0, days, 5):
        at = F.lit(first) + F.make_dt_interval(days=F.lit(start))
        lines.where((F.col("ts") >= at) & (F.col("ts") < at + F.make_dt_interval(days=F.lit(5)))).write.mode("append").parquet(path)
        stream = stream_log_templates(read_stream(spark, path + "/"), delay="2 days")
        query = stream.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
        totals.append(max(op["numRowsTotal"] for op in query.lastProgress["stateOperators"] if op["operatorName"] == "dedupeWithinWatermark"))
    severe = lines.count()
    assert len(totals) >= 4 and totals[-1] < severe / 2 and max(totals) < 0.7 * severe
    batch = stream_log_templates(lines, dedupe=False)
    closed = batch.where(F.col("window_start") < F.lit(last) - F.make_dt_interval(days=F.lit(3)))
    got = spark.read.parquet(out)
    assert closed.count() > 0 and closed.exceptAll(got).count() == 0 and got.exceptAll(batch).count() == 0


@pytest.mark.parametrize("root", ["a+b/build", "c[1]/build/", "build/x.y"])
def test_listing_judges_folders_below_the_root(spark, tmp_path, root):
    """Noise names above the root, and signs of a pattern in it, change nothing."""
    for name in ("one.txt", "build/two.txt", "sub/three.txt"):
        path = tmp_path / root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    at = str(tmp_path / root).replace("[", "\\[").replace("]", "\\]")  # the reader takes brackets as a glob
    assert {r["name"] for r in readers.listing(spark, at).collect()} == {"one.txt", "three.txt"}


def test_usage_and_blocked_rows_are_appended(spark, tmp_path):
    stamp = dt.datetime(2024, 1, 5, 10)
    runs = spark.createDataFrame([(1, stamp, "ls", "run", "a" * 40, "a")], "capture_id long, ts timestamp, command string, tool string, raw string, filtered string")
    refused = spark.createDataFrame([(2, stamp, "rm -rf /", False, "no")], "command_id long, ts timestamp, command string, safe boolean, reason string")
    path = str(tmp_path / "ledger")
    sinks.append_ledger(ledger.usage_rows(runs), path)
    sinks.append_ledger(ledger.blocked_rows(refused), path)
    got = ledger.ledger_summary(spark.read.parquet(path)).first()
    assert (got.runs, got.blocked_runs, got.raw_tokens) == (2, 1, 10)
    with pytest.raises(ValueError):
        sinks.append_ledger(ledger.usage_rows(runs.drop("ts")), path)


def test_stream_goes_on_in_its_folder(spark, tmp_path):
    rows = view(spark, SF_DIR, "v_ledger").withColumn("ts", F.col("ts").cast("timestamp"))
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    daily = lambda: stream_ledger_daily(read_stream(spark, source + "/"))
    rows.where("id % 2 = 0").write.parquet(source)
    run_available(spark, daily(), "t", "complete", folder)
    rows.where("id % 2 = 1").write.mode("append").parquet(source)
    got = run_available(spark, daily(), "t", "complete", folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger_daily(rows, None).collect()))
