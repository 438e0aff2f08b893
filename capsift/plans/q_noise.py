"""Noise filters and masking."""

from pyspark.sql import functions as F

from capsift import rules as R
from capsift.operators import noise
from capsift.plans.catalog import register
from capsift.plans.q_cuts import documents
from capsift.plans.sql import generic_steps, query, ranked, trimmed
from capsift.plans.views import view

_T = trimmed("line")
_NOISE = ", ".join(f"'{n}'" for n in R.NOISE_DIRS)


@register("drop_noise_dirs", query("v_listing", final=(
    f"select * from v_listing where name not in ({_NOISE}) and not list_has_any(string_split(dir, '/'), [{_NOISE}])")))
def drop_noise_dirs(spark, sf_dir):
    return noise.drop_noise_dirs(view(spark, sf_dir, "v_listing"), "dir", "name")


@register("filter_status_hints", query("v_verbose_lines",
    ("k", f"select capture_id, line_no, line, {_T} as t from v_verbose_lines where {_T} <> '' and not starts_with({_T}, '(use \"git') "
          f"and not starts_with({_T}, '(create/copy files') and not contains({_T}, 'use \"git add') and not contains({_T}, 'use \"git restore')"),
    ("s", "select capture_id, min(line_no) as stop from k where contains(t, 'nothing to commit') and contains(t, 'working tree clean') group by capture_id"),
    final="select capture_id, line_no, case when line_no = stop then t else line end as line from k left join s using (capture_id) "
          "where stop is null or line_no <= stop"))
def filter_status_hints(spark, sf_dir):
    return noise.filter_status_hints(view(spark, sf_dir, "v_verbose_lines"))


def _npm(view_name: str) -> str:
    return query(view_name,
        ("b", f"select capture_id, line_no, {_T} as line from {view_name} where {_T} <> ''"),
        ("c", """select *, case when regexp_matches(line, '(?i)npm ERR!') then 'error' when regexp_matches(line, 'added|removed|updated|audited|packages') then 'summary' end as section
from b where not (regexp_matches(line, '^(npm (warn|notice)|WARN|notice)') and not regexp_matches(line, '(?i)error')) and not regexp_matches(line, '^[⠀-⣿]')"""),
        ("m", "select * from c where section is not null"),
        ("r", ranked("m", "capture_id, section")),
        ("x", "select *, min(section) over (partition by capture_id) as best from r"),
        ("rest", f"select * from {view_name} where capture_id not in (select capture_id from m)"),
        *generic_steps("rest", "generic_"),
        final="select capture_id, section, r as rank, line, total from x where section = best and r <= case section when 'error' then 20 else 5 end "
              "union all select capture_id, section, rank, line, total from generic")


@register("drop_npm_noise", _npm("v_pkg_lines"))
def drop_npm_noise(spark, sf_dir):
    return noise.drop_npm_noise(view(spark, sf_dir, "v_pkg_lines"))


@register("drop_npm_noise_generic", _npm("v_build_lines"))
def drop_npm_noise_generic(spark, sf_dir):
    """Input without any npm line: every capture falls back to the generic cut."""
    return noise.drop_npm_noise(view(spark, sf_dir, "v_build_lines"))


@register("drop_pnpm_noise", query("v_pkg_lines",
    ("k", rf"""select capture_id, line_no, line, regexp_matches(line, '^\s+[\w@]') or regexp_matches(line, '^[└├─│]') as dep,
case when regexp_matches(line, 'packages?\s+\d') then line end as s from v_pkg_lines where {_T} <> '' and not regexp_matches({_T}, '^(Progress|Packages|WARN)')"""),
    ("n", "select capture_id, count(*) as n, count(*) filter (where dep) as total, arg_min(s, line_no) filter (where s is not null) as s from k group by capture_id"),
    ("p", "select *, row_number() over (partition by capture_id order by line_no) as r from k"),
    ("d", "select *, row_number() over (partition by capture_id order by line_no) as r from k where dep"),
    final="""select capture_id, 'pass' as section, r as rank, line, n as total from p join n using (capture_id) where n <= 30
union all select capture_id, 'summary', 1, coalesce(s, total || ' packages'), total from n where n > 30
union all select capture_id, 'dependency', r, line, total from d join n using (capture_id) where n > 30 and r <= 30"""))
def drop_pnpm_noise(spark, sf_dir):
    return noise.drop_pnpm_noise(view(spark, sf_dir, "v_pkg_lines"))


@register("drop_pip_noise", query("v_pkg_lines",
    ("k", f"select * from v_pkg_lines where {_T} <> '' and not regexp_matches({_T}, '^(WARNING|DEPRECATION|Requirement already)')"),
    ("r", ranked("k", "capture_id")),
    final="select capture_id, case when total <= 30 then 'pass' else 'head' end as section, r as rank, line, total from r where r <= case when total <= 30 then 30 else 20 end"))
def drop_pip_noise(spark, sf_dir):
    return noise.drop_pip_noise(view(spark, sf_dir, "v_pkg_lines"))


@register("drop_prisma_noise", query("v_pkg_lines",
    ("b", f"select capture_id, line_no, {_T} as line from v_pkg_lines where {_T} <> ''"),
    ("k", r"""select * from b where not regexp_matches(line, '^[┌┐└┘│├┤┬┴┼─═╔╗╚╝║╠╣╦╩╬▓░▌▐▄▀■]+$') and not regexp_matches(line, '^[*#=\-]{5,}$')
and regexp_matches(line, '(?i)error|warn|Migration|Generated|Prisma Client|model |Running')"""),
    ("rest", "select * from v_pkg_lines where capture_id not in (select capture_id from k)"),
    *generic_steps("rest", "generic_"),
    final="select capture_id, 'kept' as section, line_no as rank, line, null::bigint as total from k union all select capture_id, section, rank, line, total from generic"))
def drop_prisma_noise(spark, sf_dir):
    return noise.drop_prisma_noise(view(spark, sf_dir, "v_pkg_lines"))


@register("unformatted_files", query("v_pkg_lines",
    ("k", f"select * from v_pkg_lines where {_T} <> '' and not contains(line, 'Checking formatting') and not contains(line, 'All matched')"),
    ("r", ranked("k", "capture_id")),
    final="select capture_id, 'file' as section, r as rank, line, total from r where r <= 20"))
def unformatted_files(spark, sf_dir):
    return noise.unformatted_files(view(spark, sf_dir, "v_pkg_lines"))


_NAME, _VALUE = "substring(line, 1, instr(line, '=') - 1)", "substring(line, instr(line, '=') + 1)"


@register("mask_env", query("v_env_lines", final=f"""select capture_id, line_no, regexp_matches({_NAME}, '{R.SECRET_NAME}') as masked,
case when regexp_matches({_NAME}, '{R.SECRET_NAME}') then {_NAME} || '=***masked***'
when length({_VALUE}) > 80 then {_NAME} || '=' || substring({_VALUE}, 1, 77) || '...' else line end as line
from v_env_lines where contains(line, '=')"""))
def mask_env(spark, sf_dir):
    return noise.mask_env(view(spark, sf_dir, "v_env_lines"))


_INLINE = R.INLINE_SECRET.replace("'", "''")


@register("mask_text", f"""select doc_id as capture_id, regexp_replace(text, '{_INLINE}', '\\1***masked***', 'g') as masked,
cast(len(regexp_extract_all(text, '{_INLINE}')) as bigint) as n_masked from documents""")
def mask_text(spark, sf_dir):
    return noise.mask_text(documents(spark, sf_dir))
