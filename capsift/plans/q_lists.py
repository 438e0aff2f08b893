"""Matches, listings, tables and task lists."""

from pyspark.sql import functions as F

from capsift import rules as R
from capsift.operators import listing, matches, tables
from capsift.plans.catalog import register
from capsift.plans.sql import query, ranked, trimmed
from capsift.plans.views import view

_T = trimmed("line")
_CT = trimmed("content")
_GREP = r"^((?:[A-Za-z]:[\\/])?[^:]*):(?:(\d+):)?(.*)$"
_PARSED = (("g", f"""select capture_id, line_no, regexp_extract(line, '{_GREP}', 1) as file,
coalesce(nullif(regexp_extract(line, '{_GREP}', 2), '')::bigint, 0) as "row", regexp_extract(line, '{_GREP}', 3) as content
from v_grep_lines where {_T} <> '' and contains(line, ':')"""),
    ("f", "select *, row_number() over (partition by capture_id, file order by line_no) as fr, count(*) over (partition by capture_id, file) as n_in_file from g"),
    ("a", "select capture_id, count(*) as total, count(distinct file) as n_files from g group by capture_id"),
    ("r", "select *, row_number() over (partition by capture_id order by file, fr) as r from f where fr <= 5"),
    ("t", f"select *, {_CT} as t, instr(lower({_CT}), 'needle') - 1 as p, string_split(file, '/') as parts from r where r <= 50"),
    ("w", "select *, greatest(0, p - 40) as s0, least(length(t), greatest(0, p - 40) + 120) as e from t"),
    ("v", "select *, case when e = length(t) then greatest(0, e - 120) else s0 end as s from w"))


@register("matches_by_file", query("v_grep_lines", *_PARSED, final="""select capture_id, r as rank, file,
case when length(file) > 50 and len(parts) > 3 then parts[1] || '/.../' || array_to_string(parts[-2:], '/') else file end as file_display,
fr as file_rank, "row", case when length(t) <= 120 then t when p >= 0 then case when s > 0 then '...' else '' end || substring(t, s + 1, e - s) ||
case when s = 0 or e < length(t) then '...' else '' end else substring(t, 1, 117) || '...' end as content, n_in_file, n_files, total
from v join a using (capture_id)"""))
def matches_by_file(spark, sf_dir):
    return matches.matches_by_file(view(spark, sf_dir, "v_grep_lines"), "needle")


@register("paths_by_dir", query("v_listing", ("a", "select *, count(*) over (partition by capture_id) as total, count(*) over (partition by capture_id, dir) as n_dir, "
    "row_number() over (partition by capture_id order by line_no) as r, row_number() over (partition by capture_id, dir order by line_no) as rd, "
    "min(line_no) over (partition by capture_id, dir) as f from v_listing"),
    final="""select capture_id, 'short' as section, dir, r as rank, name, total as n, line_no as first_line_no from a where total <= 30
union all select capture_id, 'dir', dir, rd, name, n_dir, f from a where total > 30 and (n_dir <= 5 or rd <= 3)"""))
def paths_by_dir(spark, sf_dir):
    return matches.paths_by_dir(view(spark, sf_dir, "v_listing"))


def _size(x: str) -> str:
    return (f"case when {x} >= 1048576 then printf('%.1fM', floor({x} / 1048576.0 * 10 + 0.5) / 10) "
            f"when {x} >= 1024 then printf('%.1fK', floor({x} / 1024.0 * 10 + 0.5) / 10) else {x} || 'B' end")


_NOISE = ", ".join(f"'{n}'" for n in R.NOISE_DIRS)
_ENTRY_TAIL = (("n", f"select * from e where name not in ({_NOISE}, '.', '..', '')"),
    ("x", r"""select *, case when not is_dir then case when contains(name, '.') then regexp_extract(name, '(\.[^.]*)$', 1) else 'no ext' end end as ext from n"""))
_UNIX = (("e", r"""select capture_id, line_no, array_to_string(string_split_regex(line, '\s+')[9:], ' ') as name, starts_with(line, 'd') as is_dir,
cast(string_split_regex(line, '\s+')[5] as bigint) as size from v_ls_lines"""), *_ENTRY_TAIL)
_WIN = (("e", r"""select capture_id, line_no, contains(line, '<DIR>') as is_dir, case when contains(line, '<DIR>') then 0 else
cast(regexp_extract(line, '\s+([\d,]+)\s+([^\s].+)$', 1) as bigint) end as size,
case when contains(line, '<DIR>') then regexp_extract(line, '<DIR>\s+(.+)$', 1) else regexp_extract(line, '\s+([\d,]+)\s+([^\s].+)$', 2) end as name from v_win_lines"""), *_ENTRY_TAIL)
_ENTRIES = f"select capture_id, line_no, name, is_dir, size, ext, case when not is_dir then {_size('size')} end as size_text from x"


@register("listing_entries", query("v_ls_lines", *_UNIX, final=_ENTRIES))
def listing_entries(spark, sf_dir):
    return listing.listing_entries(view(spark, sf_dir, "v_ls_lines"))


@register("listing_entries_windows", query("v_win_lines", *_WIN, final=_ENTRIES))
def listing_entries_windows(spark, sf_dir):
    return listing.listing_entries(view(spark, sf_dir, "v_win_lines"))


@register("listing_summary", query("v_ls_lines", *_UNIX,
    ("g", "select capture_id, is_dir, ext, count(*) as n, min(line_no) as f, sum(size) as bytes from x group by all"),
    ("r", "select *, row_number() over (partition by capture_id order by is_dir, n desc, f) as r, "
          "sum(case when is_dir then 0 else n end) over (partition by capture_id) as n_files, sum(case when is_dir then n else 0 end) over (partition by capture_id) as n_dirs, "
          "sum(case when is_dir then 0 else 1 end) over (partition by capture_id) as n_ext from g"),
    final="select capture_id, r as rank, coalesce(ext, '(dirs)') as ext, n, cast(bytes as bigint) as bytes, cast(n_files as bigint) as n_files, "
          "cast(n_dirs as bigint) as n_dirs, cast(n_ext as bigint) as n_ext from r where r <= 5 and (not is_dir or r = 1)"))
def listing_summary(spark, sf_dir):
    return listing.listing_summary(listing.listing_entries(view(spark, sf_dir, "v_ls_lines")))


@register("tasks_by_group", query("v_task_lines",
    ("h", rf"""select *, last_value(case when line like '% tasks' and not starts_with(line, ' ') then regexp_replace(replace(line, ' tasks', ''), '^\s+|\s+$', '', 'g') end ignore nulls)
over (partition by capture_id order by line_no rows between unbounded preceding and current row) as grp from v_task_lines where {_T} <> ''"""),
    ("i", rf"select capture_id, line_no, coalesce(grp, 'other') as task_group, {_T} as task from h where regexp_matches(line, '^\w') and contains(line, ' - ')"),
    ("r", "select *, row_number() over (partition by capture_id, task_group order by line_no) as r, count(*) over (partition by capture_id, task_group) as total, "
          "min(line_no) over (partition by capture_id, task_group) as f from i"),
    final="select capture_id, task_group, f as first_line_no, r as rank, task, total from r where r <= 8"))
def tasks_by_group(spark, sf_dir):
    return listing.tasks_by_group(view(spark, sf_dir, "v_task_lines"))


_TABLE = (("s", rf"""select *, string_split_regex(line, '\s{{2,}}') as w, string_split_regex({_T}, '\s+') as k, string_split(line, chr(9)) as b
from v_table_lines where {_T} <> '' and not (line_no = 0 and kind in ('docker_ps', 'docker_images', 'kubectl'))"""),
    ("o", rf"""select capture_id, line_no, kind,
case when kind = 'docker_ps' and len(w) >= 5 then w[-1] when kind = 'kubectl' and len(k) >= 3 then k[1] when kind = 'gh' and len(b) >= 3 then b[1] when kind = 'adb_devices' and len(b) >= 2 then b[1] end as name,
case when kind = 'docker_ps' and len(w) >= 5 then case when w[5] <> '' then w[5] else w[4] end when kind = 'kubectl' and len(k) >= 3 then k[3] when kind = 'gh' and len(b) >= 3 then b[3] when kind = 'adb_devices' and len(b) >= 2 then b[2] end as status,
case when kind = 'docker_ps' and len(w) >= 5 then substring(w[1], 1, 12) || ' ' || w[2] || ' [' || case when w[5] <> '' then w[5] else w[4] end || '] ' || w[-1]
when kind = 'kubectl' and len(k) >= 3 then array_to_string(k[1:5], ' ') when kind = 'gh' and len(b) >= 3 then array_to_string(list_transform(b[1:4], lambda x: trim(x)), '  ')
when kind = 'adb_devices' and len(b) >= 2 then b[1] || ' [' || b[2] || ']' when kind = 'gh' then substring({_T}, 1, 120) else {_T} end as text from s"""))


@register("table_rows", query("v_table_lines", *_TABLE, final="select * from o"))
def table_rows(spark, sf_dir):
    return tables.table_rows(view(spark, sf_dir, "v_table_lines"))


@register("table_status_counts", query("v_table_lines", *_TABLE, final=(
    "select kind, status, count(*) as n, count(name) as n_parsed from o group by kind, status")))
def table_status_counts(spark, sf_dir):
    return tables.table_status_counts(tables.table_rows(view(spark, sf_dir, "v_table_lines")))
