"""Cuts over documents: lines, heads, tails, summaries, search."""

from pyspark.sql import functions as F

from capsift.functions.text import bigint, snippet, token_estimate, truncate_line
from capsift.operators import cut as ops
from capsift.operators import lines as base
from capsift.plans.catalog import register
from capsift.plans.sql import cut, generic_steps, query, ranked, tokens, trimmed
from capsift.plans.views import table, view
from capsift.sources.readers import captures as build_captures


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture_id"), F.col("text").alias("raw"))


def _report(filtered: str, steps=()) -> str:
    return query((), ("d", "select doc_id as capture_id, text as raw, string_split(text, chr(10)) as l from documents"), *steps,
                 ("o", f"select d.capture_id, raw, len(l) as n_lines, {filtered} as filtered from d"),
                 final=f"select capture_id, cast(n_lines as bigint) as n_lines, filtered, {tokens('raw')} as raw_tokens, "
                       f"{tokens('filtered')} as filtered_tokens from o")


@register("src_captures", query("v_captures", ("c", """select capture_id, tool, command, exit_code,
replace(stdout, chr(13), '') || case when replace(stderr, chr(13), '') <> '' then chr(10) || replace(stderr, chr(13), '') else '' end as raw
from v_captures"""), final=f"select *, {tokens('raw')} as raw_tokens from c"))
def src_captures(spark, sf_dir):
    return build_captures(view(spark, sf_dir, "v_captures")).withColumn("raw_tokens", token_estimate(F.col("raw")))


@register("explode_lines", query("v_doc_lines", final="select capture_id, line_no, line from v_doc_lines"))
def explode_lines(spark, sf_dir):
    return base.explode_lines(documents(spark, sf_dir))


_BLANK = "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''"
#: order-preserving distinct of the non-blank lines: keep a line where it occurs first
_UNIQ = ("u", """select capture_id, list(line order by line_no) as u from (
select capture_id, line, min(line_no) as line_no from (select doc_id as capture_id,
  generate_subscripts(string_split(text, chr(10)), 1) as line_no, unnest(string_split(text, chr(10))) as line from documents)
where regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' group by capture_id, line) group by capture_id""")
GENERIC_FILTERED = f"""case when len(l) <= 40 then {trimmed('raw')} when len(u) <= 40 then array_to_string(u, chr(10))
else array_to_string(u[1:20], chr(10)) || chr(10) || chr(10) || '... (' || (len(u) - 30) || ' lines omitted) ...' || chr(10) || chr(10) ||
array_to_string(u[-10:], chr(10)) end"""


@register("compress_generic", _report(GENERIC_FILTERED, [_UNIQ]).replace("from d)", "from d left join u using (capture_id))"))
def compress_generic(spark, sf_dir):
    return ops.compress_generic(documents(spark, sf_dir))


@register("compress_generic_lines", query("v_doc_lines", *generic_steps("v_doc_lines"),
                                          final="select capture_id, section, rank, line, total from generic"))
def compress_generic_lines(spark, sf_dir):
    return ops.generic_lines(view(spark, sf_dir, "v_doc_lines")).drop("line_no")


@register("summary_6", _report(f"""case when len(list_filter(l, {_BLANK})) <= 6 then array_to_string(list_filter(l, {_BLANK}), chr(10))
else array_to_string(list_filter(l, {_BLANK})[1:3], chr(10)) || chr(10) || '... (' || (len(list_filter(l, {_BLANK})) - 6) ||
' lines omitted) ...' || chr(10) || array_to_string(list_filter(l, {_BLANK})[-3:], chr(10)) end"""))
def summary_6(spark, sf_dir):
    return ops.summary_6(documents(spark, sf_dir))


@register("read_full", _report("""case when len(l) > 200 then d.capture_id || ' (' || len(l) || ' lines):' || chr(10) ||
array_to_string(l[1:80], chr(10)) || chr(10) || chr(10) || '... (' || (len(l) - 120) || ' lines omitted) ...' || chr(10) || chr(10) ||
array_to_string(l[-40:], chr(10)) else raw end"""))
def read_full(spark, sf_dir):
    return ops.read_full(documents(spark, sf_dir))


@register("read_head", _report("""array_to_string(l[1:50], chr(10)) ||
case when len(l) > 50 then chr(10) || '... (' || (len(l) - 50) || ' more lines)' else '' end"""))
def read_head(spark, sf_dir):
    return ops.read_head(documents(spark, sf_dir))


_TL = f"string_split({trimmed('raw')}, chr(10))"


@register("head_n", _report(f"array_to_string({_TL}[1:5], chr(10))"))
def head_n(spark, sf_dir):
    return ops.head_n(documents(spark, sf_dir), 5)


@register("tail_n", _report(f"array_to_string({_TL}[-3:], chr(10))"))
def tail_n(spark, sf_dir):
    return ops.tail_n(documents(spark, sf_dir), 3)


@register("capped_list", query("v_doc_lines", ("r", ranked("v_doc_lines", "capture_id")), final=(
    "select capture_id, line_no, line, r as rank, total, greatest(0, total - 20) as more from r where r <= 20")))
def capped_list(spark, sf_dir):
    return base.capped_list(view(spark, sf_dir, "v_doc_lines"), ["capture_id"], 20)


@register("tail_lines", query("v_logcat_lines", ("r", ranked("v_logcat_lines", "capture_id", "line_no desc")), final=(
    "select capture_id, line_no, line, r as from_end from r where r <= 10")))
def tail_lines(spark, sf_dir):
    return base.tail_lines(view(spark, sf_dir, "v_logcat_lines"), 10)


_SIG1 = r"^\s*(export\s+)?(async\s+)?(function|class|const\s+\w+\s*=|def |fn |pub fn |interface |type |struct |impl )"
_SIG2 = r"^\s*(public|private|protected)\s+(static\s+)?(async\s+)?[\w<>\[\]]+\s+\w+\s*\("


@register("signature_lines", query("v_source_lines",
    ("m", f"select *, regexp_matches(line, '{_SIG1}') or regexp_matches(line, '{_SIG2}') as hit from v_source_lines"),
    ("r", "select *, row_number() over (partition by capture_id order by line_no) as r, bool_or(hit) over (partition by capture_id) as any_hit from m"),
    final="select capture_id, line_no, line, case when hit then 'signature' else 'fallback' end as section from r where hit or (not any_hit and r <= 30)"))
def signature_lines(spark, sf_dir):
    return ops.signature_lines(view(spark, sf_dir, "v_source_lines"))


_PATTERN = "(?i)licen[sc]e|copyright|password"


@register("search", query("v_doc_lines", final=f"select capture_id, line_no, line from v_doc_lines where regexp_matches(line, '{_PATTERN}')"))
def search(spark, sf_dir):
    return ops.search(documents(spark, sf_dir), _PATTERN)


@register("search_pages", query((), ("p", "select page_id, string_split(html, chr(10)) as l from pages"),
    ("x", "select page_id as capture_id, cast(generate_subscripts(l, 1) - 1 as bigint) as line_no, unnest(l) as line from p"),
    final="select * from x where regexp_matches(line, '(?i)<a\\s+[^>]*href')"))
def search_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), F.col("html").alias("raw"))
    return ops.search(pages, r"(?i)<a\s+[^>]*href")


_T = trimmed("text")


@register("snippet", query((), ("t", f"select conv_id, turn, text, {_T} as t, instr(lower({_T}), 'the') - 1 as p from conversations"),
    ("w", "select *, greatest(0, p - 40) as s0, least(length(t), greatest(0, p - 40) + 120) as e from t"),
    ("v", "select *, case when e = length(t) then greatest(0, e - 120) else s0 end as s from w"),
    final=f"""select conv_id, turn, {cut('text', 80)} as truncated, case when length(t) <= 120 then t when p >= 0 then
case when s > 0 then '...' else '' end || substring(t, s + 1, e - s) || case when s = 0 or e < length(t) then '...' else '' end
else substring(t, 1, 117) || '...' end as snippet from v"""))
def snippet_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", truncate_line(F.col("text")).alias("truncated"),
        snippet(F.col("text"), "the").alias("snippet"))


@register("token_estimate", f"select role, cast(count(*) as bigint) as turns, cast(sum({tokens('text')}) as bigint) as tokens from conversations group by role")
def token_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("t", token_estimate(F.col("text")))
    return rows.groupBy("role").agg(bigint(F.count(F.lit(1))).alias("turns"), bigint(F.sum("t")).alias("tokens"))
