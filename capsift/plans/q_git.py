"""Version-control queries."""

from capsift.operators import gitops
from capsift.plans.catalog import register
from capsift.plans.sql import cut, query, trimmed
from capsift.plans.views import view

_T = trimmed("line")


@register("status_summary", query("v_status_lines",
    ("l", "select *, substring(line, 1, 1) as x, substring(line, 2, 1) as y, substring(line, 1, 2) as xy from v_status_lines "
          "where regexp_matches(line, '^(##|[MADRCU?!][ MADRCU?!] | [MADRCU?!] )')"),
    ("c", """select *, 'branch' as section from l where starts_with(line, '##') union all select *, 'untracked' from l where xy = '??'
union all select *, 'staged' from l where not starts_with(line, '##') and x in ('M', 'A', 'D', 'R', 'C')
union all select *, 'modified' from l where not starts_with(line, '##') and y in ('M', 'D')
union all select *, 'conflict' from l where xy in ('DD', 'AU', 'UD', 'UA', 'DU', 'AA', 'UU')"""),
    ("r", "select *, row_number() over (partition by capture_id, section order by line_no) as r, count(*) over (partition by capture_id, section) as total from c"),
    final="""select capture_id, section, r as rank, case section when 'branch' then trim(substring(line, 4)) when 'conflict' then '' else substring(line, 4) end as file, total
from r where r <= case section when 'staged' then 10 when 'modified' then 10 when 'untracked' then 5 else 1 end"""))
def status_summary(spark, sf_dir):
    return gitops.status_summary(view(spark, sf_dir, "v_status_lines"))


_H = trimmed("l[1]")


@register("commit_log", query("v_log_blocks",
    ("b", f"select *, string_split({trimmed('block')}, chr(10)) as l from v_log_blocks where {trimmed('block')} <> ''"),
    ("o", f"select capture_id, line_no, {_H} as h, list_filter(list_transform(l[2:], lambda x: {trimmed('x')}), "
          "lambda x: x <> '' and not starts_with(x, 'Signed-off-by:') and not starts_with(x, 'Co-authored-by:'))[1] as body from b"),
    final=f"select capture_id, line_no, {cut('h', 80)} as header, {cut('body', 80)} as body from o"))
def commit_log(spark, sf_dir):
    return gitops.commit_log(view(spark, sf_dir, "v_log_blocks"))


@register("commit_log_verbose", query("v_history_lines",
    ("m", r"select *, regexp_matches(line, '^commit\s+[a-f0-9]+') as c, regexp_matches(line, '^[a-f0-9]{7,}\s+.+') as o from v_history_lines"),
    ("w", "select *, sum(case when c or o then 1 else 0 end) over (partition by capture_id order by line_no rows between unbounded preceding and current row) as no from m"),
    ("g", rf"""select capture_id, min(line_no) as line_no, max(case when c then substring(regexp_extract(line, '^commit\s+([a-f0-9]+)', 1), 1, 7) end) as h,
max(case when o then substring(regexp_extract(line, '^([a-f0-9]{{7,}})\s+(.+)', 1), 1, 7) || ' ' || regexp_extract(line, '^([a-f0-9]{{7,}})\s+(.+)', 2) end) as one,
arg_min({_T}, line_no) filter (where not c and not o and starts_with(line, '    ') and {_T} <> '') as subject from w where no > 0 group by capture_id, no"""),
    ("t", "select capture_id, line_no, coalesce(one, concat_ws(' ', h, subject)) as t from g"),
    final=f"select capture_id, line_no, {cut('t', 80)} as commit from t"))
def commit_log_verbose(spark, sf_dir):
    return gitops.commit_log_verbose(view(spark, sf_dir, "v_history_lines"))


_RUN = "rows between unbounded preceding and current row"


def _diff_steps(source: str, plain: bool) -> tuple:
    name = "coalesce(nullif(split_part(line, ' b/', 2), ''), 'unknown')"
    start = "starts_with(line, 'diff --git')"
    if plain:
        # every header pair is two adjacent lines, the first of them no text
        base = (f"select *, lag(line) over w as prev, lead(line) over w as nxt from {source} window w as (partition by capture_id order by line_no)")
        start = "starts_with(line, '+++ ') and starts_with(prev, '--- ')"
        name = "regexp_replace(split_part(substring(line, 5), chr(9), 1), '^b/', '')"
        lines = ("b0", base), ("b", "select * from b0 where not (starts_with(line, '--- ') and coalesce(starts_with(nxt, '+++ '), false))")
    else:
        lines = (("b", f"select * from {source}"),)
    return (*lines,
        ("s", f"select *, {start} as hd, {name} as nm, starts_with(line, '@@') as hk from b"),
        ("f", f"select *, sum(case when hd then 1 else 0 end) over (partition by capture_id order by line_no {_RUN}) as file_no from s"),
        ("h", f"select *, sum(case when hk then 1 else 0 end) over (partition by capture_id, file_no order by line_no {_RUN}) as hunk_no, "
              "first_value(nm) over (partition by capture_id, file_no order by line_no) as file, first_value(line_no) over (partition by capture_id, file_no order by line_no) as file_at from f where file_no > 0"),
        ("a", "select *, case when hunk_no > 0 and starts_with(line, '+') then 1 else 0 end as ad, case when hunk_no > 0 and starts_with(line, '-') then 1 else 0 end as rm from h"))


_STAT = ("select capture_id, file_at, file, cast(sum(ad) as bigint) as added, cast(sum(rm) as bigint) as removed, "
         "count(*) filter (where hk) as hunks from a group by capture_id, file_at, file")


@register("diff_stat", query("v_diff_lines", *_diff_steps("v_diff_lines", False), final=_STAT))
def diff_stat(spark, sf_dir):
    return gitops.diff_stat(view(spark, sf_dir, "v_diff_lines"), plain=False)


@register("diff_stat_plain", query("v_plain_diff_lines", *_diff_steps("v_plain_diff_lines", True), final=_STAT))
def diff_stat_plain(spark, sf_dir):
    return gitops.diff_stat(view(spark, sf_dir, "v_plain_diff_lines"))


@register("diff_condense", query("v_diff_lines", *_diff_steps("v_diff_lines", False),
    ("a2", "select *, case when hunk_no = 0 then file_at else first_value(line_no) over (partition by capture_id, file_no, hunk_no order by line_no) end as hunk_at from a"),
    ("p", f"select *, max(ad + rm) over (partition by capture_id, file_no, hunk_no order by line_no {_RUN}) as prior from a2"),
    ("c", "select *, hunk_no > 0 and not hk and prior > 0 and not starts_with(line, chr(92)) as cand from p"),
    ("k", f"select *, sum(case when cand then 1 else 0 end) over (partition by capture_id, file_no, hunk_no order by line_no {_RUN}) as k, "
          "sum(case when cand then 1 else 0 end) over (partition by capture_id, file_no, hunk_no) as kk from c"),
    ("o", rf"""select capture_id, line_no, file, file_at, hunk_at, 'file' as kind, file as line, false as truncated from k where hd
union all select capture_id, line_no, file, file_at, hunk_at, 'hunk', {trimmed("split_part(line, '@@', 2)")}, false from k where hk
union all select capture_id, line_no, file, file_at, hunk_at, 'line', line, kk >= 30 from k where cand and k <= 30"""),
    ("r", "select *, row_number() over (partition by capture_id order by line_no) as r, count(*) over (partition by capture_id) as n_rows from o"),
    final="select capture_id, r as rank, line_no, file, file_at, hunk_at, kind, line, truncated, n_rows from r where r <= 200"))
def diff_condense(spark, sf_dir):
    return gitops.diff_condense(view(spark, sf_dir, "v_diff_lines"), plain=False)


_PART = "nullif(regexp_extract(line, '(\\d+) {}', 1), '')::bigint"


@register("git_outcome", query("v_outcome_lines",
    ("a", r"select *, regexp_extract(lower(command), '^git\s+(push|pull|commit|add)(\s|$)', 1) as action from v_outcome_lines"),
    ("s", f"""select *, case when action in ('push', 'pull') and (contains(line, 'up-to-date') or contains(line, 'Already up to date')) then 'up-to-date'
when action = 'commit' and contains(line, 'nothing to commit') then 'nothing-to-commit' when action = 'add' and {_T} = '' then 'nothing-to-add' else 'ok' end as status from a where action <> ''"""),
    ("c", "select *, status = 'ok' and action in ('pull', 'add') as counted, contains(line, 'file') and contains(line, 'changed') as ch from s"),
    final=rf"""select capture_id, action, status, case when status <> 'ok' then null when action = 'push' and contains(line, '->') then string_split_regex({_T}, '\s+')[-1]
when action = 'commit' then nullif(substring(regexp_extract(line, '\[[\w/.\-]+\s+([a-f0-9]+)\]', 1), 1, 7), '') when action = 'add' and contains(line, 'changed') then {_T} end as ref,
case when counted then coalesce(case when ch then {_PART.format('file')} end, 0) end as files, case when counted then coalesce(case when ch then {_PART.format('insertion')} end, 0) end as insertions,
case when counted then coalesce(case when ch then {_PART.format('deletion')} end, 0) end as deletions from c"""))
def git_outcome(spark, sf_dir):
    return gitops.git_outcome(view(spark, sf_dir, "v_outcome_lines"))


@register("install_outcome", query("v_outcome_lines", final=r"""select capture_id, case when contains(line, 'Success') then 'installed' when regexp_matches(line, 'Failure \[.+\]') then 'failed' else 'unknown' end as status,
case when not contains(line, 'Success') then nullif(regexp_extract(line, 'Failure \[(.+)\]', 1), '') end as detail from v_outcome_lines where starts_with(command, 'adb install')"""))
def install_outcome(spark, sf_dir):
    return gitops.install_outcome(view(spark, sf_dir, "v_outcome_lines"))
