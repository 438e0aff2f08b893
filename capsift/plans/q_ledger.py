"""Ledger queries."""

from pyspark.sql import functions as F

from capsift.functions.text import epoch_date
from capsift.operators import cut, ledger as ops
from capsift.plans.catalog import register
from capsift.plans.q_cuts import _UNIQ, GENERIC_FILTERED
from capsift.plans.sql import query, share, tokens
from capsift.plans.views import table, view
from capsift.sources.readers import captures as build_captures
from capsift.streaming.ledger import stream_ledger_daily as stream_daily
from capsift.streaming.run import read_stream, run_available


@register("sink_ledger", query("v_captures",
    ("d", "select *, stdout || case when stderr <> '' then chr(10) || stderr else '' end as raw from v_captures"),
    ("d2", "select *, string_split(raw, chr(10)) as l from d"),
    ("ex", "select capture_id, generate_subscripts(l, 1) as line_no, unnest(l) as line from d2"),
    ("u", _UNIQ[1][:_UNIQ[1].index("from (select doc_id")] + "from ex\n" + _UNIQ[1][_UNIQ[1].index("where regexp_replace(line"):]),
    ("o", f"select capture_id, command, tool, raw, {GENERIC_FILTERED} as filtered from d2 left join u using (capture_id)"),
    final=f"""select capture_id as id, command as raw_cmd, tool, {tokens('raw')} as raw_tokens, {tokens('filtered')} as filtered_tokens,
greatest(0, {tokens('raw')} - {tokens('filtered')}) as tokens_saved, false as blocked, null::varchar as block_reason from o"""))
def sink_ledger(spark, sf_dir):
    rows = build_captures(view(spark, sf_dir, "v_captures"))
    return ops.usage_rows(rows.withColumn("filtered", cut.generic_text(F.col("raw"))))


@register("sink_failures", query("v_captures", final=(
    "select capture_id, tool, command, exit_code, stdout || case when stderr <> '' then chr(10) || stderr else '' end as raw "
    "from v_captures where exit_code <> 0 order by capture_id desc limit 20")))
def sink_failures(spark, sf_dir):
    return ops.recent_failures(build_captures(view(spark, sf_dir, "v_captures")))


@register("ledger_summary", query("v_ledger", final=f"""select count(*) as runs, count(*) filter (where blocked) as blocked_runs, cast(sum(raw_tokens) as bigint) as raw_tokens,
cast(sum(filtered_tokens) as bigint) as filtered_tokens, cast(sum(tokens_saved) as bigint) as tokens_saved, {share('sum(tokens_saved)', 'sum(raw_tokens)')} as savings_pct from v_ledger"""))
def ledger_summary(spark, sf_dir):
    return ops.ledger_summary(view(spark, sf_dir, "v_ledger"))


_DAILY = "select cast(ts as date) as date, count(*) as runs, cast(sum(tokens_saved) as bigint) as tokens_saved from v_ledger group by 1"


@register("ledger_daily", query("v_ledger", final=_DAILY + " order by 1 desc limit 30"))
def ledger_daily(spark, sf_dir):
    return ops.ledger_daily(view(spark, sf_dir, "v_ledger"))


@register("ledger_history", query("v_ledger", final=f"""select id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, tool, cast(tokens_saved as bigint) as tokens_saved,
{share('tokens_saved', 'raw_tokens')} as pct, substring(raw_cmd, 1, 60) as raw_cmd from v_ledger order by ts desc, id desc limit 20"""))
def ledger_history(spark, sf_dir):
    return ops.ledger_history(view(spark, sf_dir, "v_ledger"))


@register("ledger_by_tool", query("v_ledger", ("d", "select *, cast(ts as date) as date from v_ledger"), final=f"""select date, tool, count(*) as runs,
cast(sum(raw_tokens) as bigint) as raw_tokens, cast(sum(tokens_saved) as bigint) as tokens_saved, avg(tokens_saved) as avg_saved, grouping_id(date, tool) as level,
{share('sum(tokens_saved)', 'sum(raw_tokens)')} as pct from d group by rollup(date, tool)"""))
def ledger_by_tool(spark, sf_dir):
    return ops.ledger_by_tool(view(spark, sf_dir, "v_ledger"))


@register("ledger_quantiles", query("v_ledger", final=(
    "select tool, count(*) as runs, cast(quantile_disc(tokens_saved, 0.5) as bigint) as p50, cast(quantile_disc(tokens_saved, 0.9) as bigint) as p90 from v_ledger group by tool")))
def ledger_quantiles(spark, sf_dir):
    return ops.ledger_quantiles(view(spark, sf_dir, "v_ledger"))


@register("epoch_date", "select event_id, cast(make_timestamp(epoch_ms(ts) * 1000) as date) as date from events")
def epoch_dates(spark, sf_dir):
    """Epoch milliseconds back to UTC dates."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", epoch_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("date"))


@register("stream_ledger_daily", query("v_ledger", final=_DAILY))
def stream_ledger_daily(spark, sf_dir):
    """Complete mode over the whole input equals the batch query."""
    events = read_stream(spark, f"{sf_dir}/events.parquet")
    raw, kept = F.floor(F.col("value") * 10), F.floor(F.col("value") * 3) + F.col("event_id") % 20
    saved = F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.greatest(F.lit(0), raw - kept))
    return run_available(spark, stream_daily(events.withColumn("tokens_saved", saved)), "ledger-daily", "complete")
