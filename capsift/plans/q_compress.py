"""Rendering and end-to-end compression queries."""

from pyspark.sql import functions as F

from capsift.operators import ledger as ledger_ops
from capsift.operators import render as ops
from capsift.operators.ledger import capture_savings
from capsift.plans.catalog import register
from capsift.plans.compress import compress
from capsift.plans.q_audit import _CASE
from capsift.plans.sql import cut, query, severity, share, template, tokens, trimmed
from capsift.plans.views import view
from capsift.sources.readers import captures as build_captures


def _log_text(source: str) -> tuple:
    """Steps ending in ``tx`` (capture_id, filtered): the log summary's text."""
    return (
        ("s", f"select capture_id, line_no, line, {severity('line')} as severity from {source} where {trimmed('line')} <> ''"),
        ("g", f"select capture_id, severity, {template('line')} as template, count(*) as n, min(line_no) as line_no, "
              "arg_min(line, line_no) as first_line from s where severity in ('error', 'warn') group by all"),
        ("r", "select *, row_number() over w as r, count(*) over (partition by capture_id, severity) as u, "
              "sum(n) over (partition by capture_id, severity) as t, case severity when 'error' then 10 else 5 end as cap "
              "from g window w as (partition by capture_id, severity order by n desc, line_no, template)"),
        ("h", f"""select i.capture_id, coalesce(max(t) filter (where severity = 'error'), 0) as e, coalesce(max(u) filter (where severity = 'error'), 0) as eu,
  coalesce(max(t) filter (where severity = 'warn'), 0) as w, coalesce(max(u) filter (where severity = 'warn'), 0) as wu
  from (select distinct capture_id from {source}) i left join r using (capture_id) group by i.capture_id"""),
        ("f", "select capture_id, count(*) as infos from s where severity = 'info' group by capture_id"),
        ("pg", f"""select capture_id, 0 as o1, 0 as o2, 'Log Summary' || chr(10) || '  [error] ' || e || ' errors (' || eu || ' unique)' || chr(10) ||
  '  [warn] ' || w || ' warnings (' || wu || ' unique)' || chr(10) || '  [info] ' || coalesce(infos, 0) || ' info messages' || chr(10) as text from h left join f using (capture_id)
union all select capture_id, case severity when 'error' then 1 else 2 end, 0, case severity when 'error' then '[ERRORS]' else '[WARNINGS]' end from r where r = 1
union all select capture_id, case severity when 'error' then 1 else 2 end, r, '  ' || case when n > 1 then '[x' || n || '] ' else '' end || {cut('first_line', 100)} from r where r <= cap
union all select capture_id, case severity when 'error' then 1 else 2 end, 1000, '  ... +' || (u - cap) || ' more unique ' || case severity when 'error' then 'errors' else 'warnings' end from r where r = 1 and u > cap
union all select capture_id, 1, 1001, '' from r where r = 1 and severity = 'error'"""),
        ("tx", "select capture_id, string_agg(text, chr(10) order by o1, o2) as filtered from pg group by capture_id"))


@register("render", query("v_log_lines", *_log_text("v_log_lines"), final="select capture_id, filtered from tx"))
def render(spark, sf_dir):
    """Log summaries as text, one per source."""
    lines = view(spark, sf_dir, "v_log_lines")
    return ops.page_text(ops.log_page(lines))


@register("render_tokens", query("v_log_lines", *_log_text("v_log_lines"), final=f"select capture_id, {tokens('filtered')} as filtered_tokens from tx"))
def render_tokens(spark, sf_dir):
    """Their tokens, summed without building any text."""
    lines = view(spark, sf_dir, "v_log_lines")
    return ops.page_tokens(ops.log_page(lines))


_RAW = ("c", "select capture_id, command, tool, stdout || case when stderr <> '' then chr(10) || stderr else '' end as raw from v_captures")
_RAW_LINES = ("src", "select capture_id, cast(generate_subscripts(string_split(raw, chr(10)), 1) - 1 as bigint) as line_no, unnest(string_split(raw, chr(10))) as line from c")


def _pct(before: str, after: str) -> str:
    return f"cast(case when {before} > 0 then floor((1 - cast({after} as double) / {before}) * 100 + 0.5) else 0 end as bigint)"


_COMPRESSED = ("z", f"select c.capture_id, command, tool, 'logs' as strategy, filtered, {tokens('raw')} as raw_tokens, {tokens('filtered')} as filtered_tokens from c join tx using (capture_id)")


@register("compress", query("v_captures", _RAW, _RAW_LINES, *_log_text("src"), _COMPRESSED, final=(
    f"select capture_id, strategy, filtered, raw_tokens, filtered_tokens, {_pct('raw_tokens', 'filtered_tokens')} as savings_pct from z")))
def compress_captures(spark, sf_dir):
    return compress(build_captures(view(spark, sf_dir, "v_captures")))


@register("capture_savings", query("v_captures", _RAW, _RAW_LINES, *_log_text("src"), _COMPRESSED,
    ("l", "select tool, raw_tokens, filtered_tokens, greatest(0, raw_tokens - filtered_tokens) as tokens_saved from z"),
    final=f"select tool, count(*) as runs, cast(sum(raw_tokens) as bigint) as raw_tokens, cast(sum(filtered_tokens) as bigint) as filtered_tokens, "
          f"cast(sum(tokens_saved) as bigint) as tokens_saved, {share('sum(tokens_saved)', 'sum(raw_tokens)')} as pct from l group by tool"))
def savings(spark, sf_dir):
    """Measured savings per tool: compressed captures joined back to their rows."""
    rows = build_captures(view(spark, sf_dir, "v_captures"))
    usage = capture_savings(compress(rows), rows)
    return ledger_ops.savings_by(usage, "tool")


_EXPECTED = f"""case strategy when 'git-diff' then '' when 'git-simple' then 'ok' when 'build' then 'build ok' when 'ls' then '(empty)'
when 'docker' then '(no containers)' when 'json' then '  k: number'
when 'logs' then 'Log Summary' || chr(10) || '  [error] 0 errors (0 unique)' || chr(10) || '  [warn] 0 warnings (0 unique)' || chr(10) || '  [info] 0 info messages' || chr(10)
when 'grep' then '1 matches in 1F:' || chr(10) || chr(10) || '[file] ' || split_part(raw, ':', 1) || ' (1):' || chr(10) || '     ?: ' || {trimmed("split_part(raw, ':', 2)")}
else {trimmed('raw')} end"""


@register("compress_runs", query("v_command_runs", ("k", f"select capture_id, raw, {_CASE} as strategy from v_command_runs"),
    ("z", f"select capture_id, strategy, {_EXPECTED} as filtered, {tokens('raw')} as raw_tokens from k"),
    final=f"select *, {tokens('filtered')} as filtered_tokens, {_pct('raw_tokens', tokens('filtered'))} as savings_pct from z"))
def compress_runs(spark, sf_dir):
    """Every routed strategy in one job, on one-line outputs."""
    return compress(view(spark, sf_dir, "v_command_runs"))
