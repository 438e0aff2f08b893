"""Physical plans: what must not shuffle, scan or sort globally."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from capsift.plans import catalog
from capsift.plans.compress import compress, narrow_texts, routed_captures
from capsift.plans.views import view
from capsift.sources.readers import captures
from conftest import SF_DIR

NARROW = ["src_captures", "explode_lines", "compress_generic", "summary_6", "read_full", "read_head", "head_n", "tail_n",
          "search", "search_pages", "snippet", "route_strategy", "route_tool", "audit_allowlist", "audit_metachars",
          "audit_path", "audit_commands", "drop_noise_dirs", "mask_env", "mask_text", "diagnostics", "json_diagnostics",
          "json_structure", "json_or_text", "commit_log", "table_rows", "listing_entries", "sink_ledger", "sink_blocked"]


catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_narrow_queries_do_not_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "Exchange" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {
    "compress", "compress_runs", "capture_savings", "stream_ledger_daily", "stream_log_templates"}))
def test_no_query_crosses_or_calls_python(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "SinglePartition, ENSURE"):
        if bad == "SinglePartition, ENSURE" and name in ("ledger_summary",):
            continue  # one row of totals
        assert bad not in text, bad


def test_json_is_read_once(spark):
    for name in ("json_structure", "json_or_text"):
        scans = plan(entry.queries()[name](spark, SF_DIR)).count("FileScan")
        assert scans == (1 if name == "json_structure" else 2)  # the second input of json_or_text is its own table


def test_newest_rows_use_top_n(spark):
    for name in ("ledger_history", "sink_failures", "ledger_daily"):
        assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, SF_DIR))


def test_ranks_are_cut_before_the_shuffle(spark):
    for name in ("tail_lines", "capped_list", "unformatted_files"):
        text = plan(entry.queries()[name](spark, SF_DIR))
        assert "row_number(), 10, Partial" in text or "row_number(), 20, Partial" in text


def test_repeats_combine_before_the_shuffle(spark):
    assert "partial_count" in plan(entry.queries()["build_issues"](spark, SF_DIR))


def test_scans_prune_columns(spark):
    text = plan(entry.queries()["token_estimate"](spark, SF_DIR))
    assert "ReadSchema: struct<role:string,text:string>" in text


def test_narrow_strategies_share_one_scan(spark):
    text = plan(narrow_texts(routed_captures(captures(view(spark, SF_DIR, "v_captures")))))
    assert text.count("FileScan") == 1 and "Exchange" not in text


def test_text_is_cut_per_task_before_it_is_shuffled(spark):
    for name in ("matches_by_file", "diag_by_file", "diag_by_file_ruff", "diag_by_linter", "next_issues", "status_summary"):
        text = plan(entry.queries()[name](spark, SF_DIR))
        assert "WindowGroupLimit" in text and ", Partial" in text, name


def test_compression_is_one_scan(spark):
    df = captures(view(spark, SF_DIR, "v_captures"))
    for by in ("command", "tool"):
        text = plan(compress(df, by=by))
        assert text.count("FileScan") == 1 and "Exchange" not in text
