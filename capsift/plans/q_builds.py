"""Build, test and diagnostic queries.

FIXED VALUES: the patterns and caps in the SQL below state the formats once more, on purpose, so that
a slip in ``rules`` shows as a difference.
"""

from pyspark.sql import functions as F

from capsift.operators import builds, diagnostics as diag, testruns
from capsift.plans.catalog import register
from capsift.plans.sql import query, ranked, tally, trimmed
from capsift.plans.views import view

_T = trimmed("line")


def _trim_step(view_name: str) -> tuple[str, str]:
    return ("b", f"select capture_id, line_no, {_T} as line from {view_name} where {_T} <> ''")


_ISSUE = "cast(r as bigint) as rank, line, line_no as first_line_no, cast(total as bigint) as total, cast(n_distinct as bigint) as n_distinct"


@register("build_issues", query("v_build_lines", _trim_step("v_build_lines"), ("c", r"""select *, case
when regexp_matches(line, '(?i)error(\[|:|\s)') and not starts_with(line, '0 error') then 'error'
when regexp_matches(line, '(?i)warning(\[|:|\s)') and not starts_with(line, '0 warning') then 'warning' end as section from b"""),
    ("d", "select * from c where section is not null"), ("t", tally("d", "capture_id, section")),
    final=f"select capture_id, section, {_ISSUE} from t where r <= case section when 'error' then 30 else 10 end"))
def build_issues(spark, sf_dir):
    return builds.build_issues(view(spark, sf_dir, "v_build_lines"))


@register("gradle_issues", query("v_build_lines", _trim_step("v_build_lines"),
    ("c", r"""select *, 'result' as section from b where regexp_matches(line, '^BUILD (SUCCESSFUL|FAILED)')
union all select *, 'time' from b where regexp_matches(line, '^Total time:|in\s+\d+[ms]')
union all select *, 'failed_task' from b where regexp_matches(line, '^> Task .*(FAILED)')
union all select *, 'error' from b where regexp_matches(line, '(?i)^e:|error:|FAILURE:|ERROR') and not starts_with(line, '0 error')
union all select *, 'warning' from b where regexp_matches(line, '(?i)^w:|warning:') and not starts_with(line, '0 warning')"""),
    ("t", tally("(select * from c where section in ('error', 'warning'))", "capture_id, section")),
    ("k", ranked("(select * from c where section = 'failed_task')", "capture_id, section")),
    ("l", ranked("(select * from c where section in ('result', 'time'))", "capture_id, section", "line_no desc")),
    final=f"""select capture_id, section, {_ISSUE} from t
where r <= case when section = 'error' then 30 when total <= 10 then 10 else 5 end
union all select capture_id, section, {_ISSUE.replace('n_distinct as bigint', 'total as bigint')} from k where r <= 10
union all select capture_id, section, {_ISSUE.replace('cast(n_distinct as bigint)', '1')} from l where r = 1"""))
def gradle_issues(spark, sf_dir):
    return builds.gradle_issues(view(spark, sf_dir, "v_build_lines"))


@register("next_issues", query("v_next_lines", _trim_step("v_next_lines"),
    ("k", r"""select *, regexp_matches(line, '✓|✔') and regexp_matches(lower(line), 'compiled|linted') as done from b
where not regexp_matches(line, '^\s*[▲◆○●]\s+') and not regexp_matches(line, '^(Compiling|Compiled|Creating|Building|Generating|Linting)\s')
and not regexp_matches(line, 'Route \(|Pages\s+\(|\s+Size\s+|\s+First Load')"""),
    ("c", """select *, 'success' as section from k where done union all
select *, 'error' from k where not done and regexp_matches(line, '(?i)error:') union all
select *, 'warning' from k where not done and regexp_matches(line, '(?i)warn:')"""),
    ("r", ranked("c", "capture_id, section")),
    final=f"select capture_id, section, {_ISSUE.replace('n_distinct as bigint', 'total as bigint')} from r "
          "where r <= case section when 'error' then 20 when 'warning' then 10 else 1 end"))
def next_issues(spark, sf_dir):
    return builds.next_issues(view(spark, sf_dir, "v_next_lines"))


# --- tests -----------------------------------------------------------------------

_P, _F = r"nullif(regexp_extract(line, '(\d+)\s+passed', 1), '')::bigint", r"nullif(regexp_extract(line, '(\d+)\s+failed', 1), '')::bigint"
_FLAGS = ("f", rf"""select *, {_P} as p, {_F} as f, nullif(regexp_extract(line, '(\d+)\s+total', 1), '')::bigint as tt,
regexp_matches(line, 'Tests:\s.*\d+\s+total') as jest, regexp_matches(line, 'test result:\s+\w+\.\s+\d+ passed;\s+\d+ failed') as cargo,
contains(line, '=====') as rule, regexp_matches(line, 'Tests\s+\d+ (failed|passed)') as vit,
contains(line, '"Action"') as isj, case when starts_with(line, '{{') and json_valid(line) then json_extract_string(line, '$.Action') end as act,
coalesce(case when starts_with(line, '{{') and json_valid(line) then json_extract_string(line, '$.Test') end, '') as tst
from v_test_lines""")


def _cnt(cond: str) -> str:
    return f"count(*) filter (where {cond})"


def _rx(pattern: str) -> str:
    return f"regexp_matches(line, '{pattern}')"


_AGG = ("a", f"""select capture_id,
arg_max_null(p, line_no) filter (where jest) as jp, arg_max_null(f, line_no) filter (where jest) as jf, arg_max_null(tt, line_no) filter (where jest) as jt,
arg_max(jest, line_no) filter (where jest or cargo) as jlast, {_cnt('cargo')} as cn,
coalesce(sum(p) filter (where cargo), 0) as cp, coalesce(sum(f) filter (where cargo), 0) as cf,
arg_min_null(p, line_no) filter (where not jest and not cargo and p is not null) as gp,
arg_min_null(f, line_no) filter (where not jest and not cargo and p is not null) as gf,
arg_max_null(p, line_no) filter (where rule and (p is not null or f is not null)) as pp,
arg_max_null(f, line_no) filter (where rule and (p is not null or f is not null)) as pf,
bool_or(isj) as anyj, {_cnt("act = 'pass' and tst <> ''")} as g1, {_cnt("act = 'fail' and tst <> ''")} as g2, {_cnt("act = 'fail' and tst = ''")} as g3,
{_cnt(_rx('^--- PASS:') + ' or ' + _rx('^ok' + chr(92) + 's'))} as h1, {_cnt(_rx('^--- FAIL:'))} as h2, {_cnt(_rx('^FAIL' + chr(92) + 's'))} as h3,
{_cnt('vit')} as vn, arg_max_null(p, line_no) filter (where vit) as vp, arg_max_null(f, line_no) filter (where vit) as vf,
{_cnt(_rx('✓|PASS'))} as v1, {_cnt(_rx('×|✗|FAIL'))} as v2,
{_cnt('regexp_matches(line, ' + chr(39) + chr(92) + 'd+ (passed|failed)' + chr(39) + ')')} as yn,
arg_max(p, line_no) filter (where p is not null) as yp, arg_max(f, line_no) filter (where f is not null) as yf,
{_cnt(_rx('✓|passed') + ' and ' + _rx('ms|s' + chr(92) + ')'))} as y1, {_cnt(_rx('✗|failed|FAILED'))} as y2
from f group by capture_id""")
_ROWS = ("o", """select capture_id, 'generic' as format, case when jlast then jp when cn > 0 then cp else gp end as passed,
  case when jlast then jf when cn > 0 then cf else gf end as failed, case when jlast then jt end as jt, 0 as failed_packages from a
union all select capture_id, 'cargo', cp, cf, null, 0 from a
union all select capture_id, 'pytest', pp, pf, null, 0 from a
union all select capture_id, 'go', case when anyj then g1 else h1 end, case when anyj then g2 else h2 end, null, case when anyj then g3 else h3 end from a
union all select capture_id, 'vitest', case when vn > 0 then vp else v1 end, case when vn > 0 then vf else v2 end, null, 0 from a
union all select capture_id, 'playwright', case when yn > 0 then yp else y1 end, case when yn > 0 then yf else y2 end, null, 0 from a""")


@register("test_outcomes", query("v_test_lines", _FLAGS, _AGG, _ROWS, final="""select capture_id, format,
cast(coalesce(passed, 0) as bigint) as passed, cast(coalesce(failed, 0) as bigint) as failed,
cast(coalesce(jt, coalesce(passed, 0) + coalesce(failed, 0)) as bigint) as total, cast(failed_packages as bigint) as failed_packages from o"""))
def test_outcomes(spark, sf_dir):
    return testruns.test_outcomes(view(spark, sf_dir, "v_test_lines"))


def _failure_rows(view_name: str) -> str:
    first120, first100 = f"substring({_T}, 1, 120)", f"substring({_T}, 1, 100)"
    return rf"""select capture_id, line_no, 'generic' as format, {_T} as text from m where {_rx('(?i)FAIL|FAILED|ERROR|panic|AssertionError|assert')} and not contains(line, 'test result:')
union all select capture_id, line_no, 'cargo', {_T} from m where regexp_matches({_T}, '^test .+ \.\.\. FAILED') or starts_with({_T}, 'FAILED') or regexp_matches({_T}, '^thread ''.+'' panicked')
union all select capture_id, line_no, 'pytest', case when starts_with(line, 'FAILED ') then {_T} else {first120} end from m
  where starts_with(line, 'FAILED ') or (coalesce(blk, false) and regexp_matches(line, 'AssertionError|assert |E\s+'))
union all select capture_id, line_no, 'go', case when starts_with(line, '--- FAIL:') then {_T} else 'FAIL ' || tst end from m where starts_with(line, '--- FAIL:') or (act = 'fail' and tst <> '')
union all select capture_id, line_no, 'vitest', case when {_rx('×|✗|FAIL')} then {_T} else {first120} end from m where {_rx('×|✗|FAIL')} or {_rx('AssertionError|Expected|Received')}
union all select capture_id, line_no, 'playwright', case when {_rx('✗|failed|FAILED')} then {_T} else '  ' || {first100} end from m
  where {_rx('✗|failed|FAILED')} or (ff is not null and {_rx('expect|Error:')})"""


def _failures_sql(view_name: str) -> str:
    return query(view_name,
        ("m", rf"""select *, case when starts_with(line, '{{') and json_valid(line) then json_extract_string(line, '$.Action') end as act,
coalesce(case when starts_with(line, '{{') and json_valid(line) then json_extract_string(line, '$.Test') end, '') as tst,
last_value(case when regexp_matches(line, '^_{{5,}} ') then true when regexp_matches(line, '^={{5,}}') then false end ignore nulls) over w as blk,
last_value(case when {_rx('✗|failed|FAILED')} then line_no end ignore nulls) over w as ff from {view_name}
window w as (partition by capture_id order by line_no rows between unbounded preceding and current row)"""),
        ("x", _failure_rows(view_name)), ("t", tally("x", "capture_id, format", "text")),
        final="select capture_id, format, r as rank, text as line, line_no as first_line_no, cast(total as bigint) as total, n_distinct from t where r <= 20")


@register("test_failures", _failures_sql("v_test_lines"))
def test_failures(spark, sf_dir):
    return testruns.test_failures(view(spark, sf_dir, "v_test_lines"))


@register("test_failures_pytest", _failures_sql("v_pytest_lines"))
def test_failures_pytest(spark, sf_dir):
    return testruns.test_failures(view(spark, sf_dir, "v_pytest_lines"))


# --- diagnostics ---------------------------------------------------------------------

_DIAG = ("d", r"""select capture_id, line_no, case when regexp_matches(line, '^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)') then 'tsc'
when regexp_matches(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$') then 'eslint'
when regexp_matches(line, '^(.+?) (\d+):(\d+) ━+\s+(.+)$') then 'biome'
when regexp_matches(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$') then 'ruff' end as tool, line from v_diag_lines"""), (
    "e", r"""select capture_id, line_no, tool, case tool
when 'tsc' then regexp_extract(line, '^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)', ['file', 'row', 'col', 'severity', 'rule', 'message'])
when 'eslint' then struct_pack(file := null::varchar, "row" := regexp_extract(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$', 1),
  col := regexp_extract(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$', 2), severity := regexp_extract(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$', 3),
  rule := regexp_extract(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$', 5), message := regexp_extract(line, '^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s+([\w/@\-]+)$', 4))
when 'biome' then struct_pack(file := regexp_extract(line, '^(.+?) (\d+):(\d+) ━+\s+(.+)$', 1), "row" := regexp_extract(line, '^(.+?) (\d+):(\d+) ━+\s+(.+)$', 2),
  col := regexp_extract(line, '^(.+?) (\d+):(\d+) ━+\s+(.+)$', 3), severity := 'error', rule := 'lint', message := regexp_extract(line, '^(.+?) (\d+):(\d+) ━+\s+(.+)$', 4))
when 'ruff' then struct_pack(file := regexp_extract(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$', 1), "row" := regexp_extract(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$', 2),
  col := regexp_extract(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$', 3), severity := 'error', rule := regexp_extract(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$', 4),
  message := regexp_extract(line, '^(.+?):(\d+):(\d+): ([A-Z]\d+) (.+)$', 5)) end as s from d where tool is not null"""), (
    "g", f"""select capture_id, line_no, tool, s.severity as severity, {trimmed('s.file')} as file, cast(s."row" as bigint) as "row",
cast(s.col as bigint) as col, s.rule as rule, {trimmed('s.message')} as message from e""")


@register("diagnostics", query("v_diag_lines", *_DIAG, final="select * from g"))
def diagnostics_query(spark, sf_dir):
    return diag.diagnostics(view(spark, sf_dir, "v_diag_lines"))


def _by_file(tool: str, source: str = "g", order: str = "line_no") -> tuple:
    first_pos = "min(pos) over w" if "pos" in order else "0::bigint"
    return (("r", f"select *, row_number() over (partition by capture_id, file order by {order}) as r, count(*) over w as n_in_file, "
                  f"min(line_no) over w as first_line_no, {first_pos} as first_pos, count(*) filter (where severity = 'error') over w as n_errors "
                  f"from {source} where tool = '{tool}' window w as (partition by capture_id, file)"),)


_BY_FILE = 'select capture_id, file, first_line_no, first_pos, r as rank, severity, "row", col, rule, message, n_in_file, n_errors from r where r <= 10'


@register("diag_by_file", query("v_diag_lines", *_DIAG, *_by_file("tsc"), final=_BY_FILE))
def diag_by_file(spark, sf_dir):
    return diag.diag_by_file(diag.diagnostics(view(spark, sf_dir, "v_diag_lines")), "tsc")


@register("diag_by_file_ruff", query("v_diag_lines", *_DIAG, *_by_file("ruff"), final=_BY_FILE))
def diag_by_file_ruff(spark, sf_dir):
    return diag.diag_by_file(diag.diagnostics(view(spark, sf_dir, "v_diag_lines")), "ruff")


@register("diag_by_rule", query("v_diag_lines", *_DIAG,
    ("t", tally("(select * from g where tool in ('eslint', 'biome'))", "capture_id, severity, rule", "message")),
    final="select capture_id, severity, rule, r as rank, message, n, first_line_no, cast(total as bigint) as total, n_distinct from t where r <= 5"))
def diag_by_rule(spark, sf_dir):
    return diag.diag_by_rule(diag.diagnostics(view(spark, sf_dir, "v_diag_lines")))


@register("diagnostic_totals", query("v_diag_lines", *_DIAG, final=(
    "select capture_id, tool, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, "
    "count(distinct file) as files from g group by capture_id, tool")))
def diagnostic_totals(spark, sf_dir):
    return diag.diagnostic_totals(diag.diagnostics(view(spark, sf_dir, "v_diag_lines")))


_JSON_DIAG = (("a", """select capture_id, line_no, case when starts_with(raw, '[') then 'ruff' else 'golangci' end as tool,
  case when starts_with(raw, '[') then raw::json else json_extract(raw, '$.Issues') end as items from v_json_diag"""),
    ("b", "select capture_id, line_no, tool, cast(generate_subscripts(l, 1) - 1 as bigint) as pos, unnest(l) as i "
          "from (select *, cast(items as json[]) as l from a)"),
    ("g", """select capture_id, line_no, tool, pos, 'error' as severity,
  case tool when 'ruff' then i->>'$.filename' else i->>'$.Pos.Filename' end as file,
  cast(case tool when 'ruff' then i->>'$.location.row' else i->>'$.Pos.Line' end as bigint) as "row",
  cast(case tool when 'ruff' then i->>'$.location.column' end as bigint) as col,
  case tool when 'ruff' then i->>'$.code' else i->>'$.FromLinter' end as rule,
  case tool when 'ruff' then i->>'$.message' else i->>'$.Text' end as message from b"""))


@register("json_diagnostics", query("v_json_diag", *_JSON_DIAG, final="select * from g"))
def json_diagnostics(spark, sf_dir):
    return diag.json_diagnostics(view(spark, sf_dir, "v_json_diag"))


@register("diag_by_file_ruff_json", query("v_json_diag", *_JSON_DIAG, *_by_file("ruff", "g", "line_no, pos"), final=_BY_FILE))
def diag_by_file_ruff_json(spark, sf_dir):
    return diag.diag_by_file(diag.json_diagnostics(view(spark, sf_dir, "v_json_diag")), "ruff")


@register("diag_by_linter", query("v_json_diag", *_JSON_DIAG,
    ("r", "select *, row_number() over (partition by capture_id, rule order by line_no, pos) as r, count(*) over w as total, "
          "min(line_no) over w as first_line_no, min(pos) over w as first_pos from g where tool = 'golangci' window w as (partition by capture_id, rule)"),
    final="""select capture_id, rule as linter, r as rank, coalesce(file || ':' || "row", '?') as place, message, total, first_line_no, first_pos from r where r <= 5"""))
def diag_by_linter(spark, sf_dir):
    return diag.diag_by_linter(diag.json_diagnostics(view(spark, sf_dir, "v_json_diag")))
