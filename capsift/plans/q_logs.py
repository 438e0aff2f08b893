"""Log queries."""

from pyspark.sql import functions as F

from capsift.operators import logs
from capsift.plans.catalog import register
from capsift.plans.sql import cut, query, ranked, severity, tally, template, trimmed
from capsift.plans.views import view
from capsift.streaming.logs import stream_log_templates as stream_templates
from capsift.streaming.run import read_stream, run_available

_SEVERE = ("s", f"select capture_id, line_no, ts, line, {severity('line')} as severity from v_log_lines "
                f"where {trimmed('line')} <> ''")
_GROUPED = ("g", f"select capture_id, severity, {template('line')} as template, count(*) as n, min(line_no) as line_no, "
                 "arg_min(line, line_no) as first_line from s where severity in ('error', 'warn') group by all")


@register("log_templates", query("v_log_lines", _SEVERE, _GROUPED, (
    "r", "select *, row_number() over (partition by capture_id, severity order by n desc, line_no, template) as r, "
         "sum(n) over (partition by capture_id, severity) as total, count(*) over (partition by capture_id, severity) as n_unique from g"),
    final=f"""select capture_id, severity, cast(r as bigint) as rank, template, cast(n as bigint) as n,
{cut('first_line', 100)} as exemplar, line_no as first_line_no, cast(total as bigint) as total, cast(n_unique as bigint) as n_unique
from r where r <= case severity when 'error' then 10 else 5 end"""))
def log_templates(spark, sf_dir):
    return logs.log_templates(view(spark, sf_dir, "v_log_lines"))


@register("log_totals", query("v_log_lines", _SEVERE, (
    "g", f"select capture_id, severity, case when severity <> 'info' then {template('line')} end as template, count(*) as n "
         "from s where severity is not null group by all"),
    final="select capture_id, " + ", ".join(
        f"cast(coalesce(sum({v}) filter (where severity = '{sev}'), 0) as bigint) as {name}"
        for sev, v, name in (("error", "n", "errors"), ("error", "1", "unique_errors"), ("warn", "n", "warnings"),
                             ("warn", "1", "unique_warnings"), ("info", "n", "infos"))) + " from g group by capture_id"))
def log_totals(spark, sf_dir):
    return logs.log_totals(view(spark, sf_dir, "v_log_lines"))


_FATAL, _CRASH = r"(?i)\bF/|FATAL", "(?i)AndroidRuntime|FATAL EXCEPTION|ANR in|Process:.*died"
_ERROR, _WARN = r"(?i)\bE/|ERROR", r"(?i)\bW/|WARN"


@register("logcat_summary", query("v_logcat_lines",
    ("sizes", "select capture_id, count(*) as n_lines from v_logcat_lines group by capture_id"),
    ("full_lines", f"select capture_id, line_no, {trimmed('line')} as line, regexp_matches(line, '{_FATAL}') as f, "
             f"regexp_matches(line, '{_CRASH}') as c, regexp_matches(line, '{_ERROR}') as e, regexp_matches(line, '{_WARN}') as w "
             f"from v_logcat_lines where {trimmed('line')} <> ''"),
    ("hits", "select capture_id, line_no, line, 'fatal' as section from full_lines where f or c "
             "union all select capture_id, line_no, line, 'error' from full_lines where e and not f "
             "union all select capture_id, line_no, line, 'warning' from full_lines where w and not e and not f"),
    ("t", tally("hits", "capture_id, section")),
    ("last_lines", "select *, row_number() over (partition by capture_id order by line_no desc) as r from full_lines"),
    ("first_lines", "select *, row_number() over (partition by capture_id order by line_no) as r from v_logcat_lines"),
    final="""select capture_id, section, r as rank, line, cast(total as bigint) as total, n_distinct
from t join sizes using (capture_id) where n_lines > 20 and r <= case section when 'warning' then 10 else 20 end
union all select capture_id, 'pass', r, line, n_lines, n_lines from first_lines join sizes using (capture_id) where n_lines <= 20
union all select capture_id, 'recent', r, line, 10, 10 from last_lines join sizes using (capture_id)
where n_lines > 20 and r <= 10 and capture_id not in (select capture_id from hits)"""))
def logcat_summary(spark, sf_dir):
    return logs.logcat_summary(view(spark, sf_dir, "v_logcat_lines"))


@register("log_totals_corpus", query("v_log_lines", _SEVERE,
    ("t", f"select severity, case when severity = 'info' then '' else {template('line')} end as template from s where severity is not null"),
    final="select severity, count(*) as n, count(distinct template) as n_unique, true as estimate_within from t group by severity"))
def log_totals_corpus(spark, sf_dir):
    """Lines and distinct templates of the whole corpus, and whether the daily sketches' estimate keeps its bound."""
    lines = view(spark, sf_dir, "v_log_lines")
    estimated = logs.log_totals_of(logs.log_sketches(lines)).withColumnRenamed("n_unique", "estimate")
    exact = logs.template_counts(lines, info=True).groupBy("severity", "template").agg(F.sum("n")).groupBy("severity").agg(
        F.count("*").alias("n_unique"))
    within = F.abs(F.col("estimate") - F.col("n_unique")) <= 0.02 * F.col("n_unique") + 1
    return estimated.join(exact, "severity").select("severity", "n", "n_unique", within.alias("estimate_within"))


@register("stream_log_templates", query("v_log_lines", _SEVERE, final=(
    f"select cast(date_trunc('hour', ts) as varchar) as window_start, severity, {template('line')} as template, "
    "count(*) as n from s where severity in ('error', 'warn') group by all")))
def stream_log_templates(spark, sf_dir):
    """The stream runs to the end of the input; complete mode holds every window."""
    events = read_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    # The same line text as the batch view, composed from streamed events.
    level = F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "DEBUG").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" req=0x"),
                    F.hex(F.col("event_id") + 4096), F.lit(" took "), (F.floor("value") % 9).cast("string"),
                    F.lit(" id "), (F.col("event_id") + 100000).cast("string"), F.lit(" at /srv/"), kind,
                    F.lit("/"), (F.col("event_id") % 7).cast("string"))
    lines = events.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("line_no"), "ts", line.alias("line"))
    # What is there forms one batch and the watermark moves between batches, so nothing in it is late.
    done = run_available(spark, stream_templates(lines, delay="2 days"), "log-templates", "complete")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
