"""JSON queries."""

from pyspark.sql import functions as F

from capsift.operators import jsonops
from capsift.plans.catalog import register
from capsift.plans.sql import query, trimmed
from capsift.plans.views import table, view


def _type(x: str) -> str:
    return (f"case json_type({x}) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' "
            f"when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end")


def _length(x: str) -> str:
    return (f"cast(case json_type({x}) when 'VARCHAR' then length(json_extract_string({x}, '$')) when 'ARRAY' then json_array_length({x}) end as bigint)")


def _structure(source: str) -> tuple:
    """Three fixed levels: root, its members, members of nested objects."""
    return (("j", f"select capture_id, raw::json as v from {source} where json_valid(raw)"),
        ("k1", "select capture_id, '$.' || k as path, json_extract(v, '$.\"' || k || '\"') as v from (select *, unnest(json_keys(v)) as k from j)"),
        ("k2", "select capture_id, path || '.' || k as path, json_extract(v, '$.\"' || k || '\"') as v "
               "from (select *, unnest(json_keys(v)) as k from k1 where json_type(v) = 'OBJECT')"),
        ("st", f"select capture_id, path, {_type('v')} as type, {_length('v')} as length from "
               "(select capture_id, '$' as path, v from j union all select * from k1 union all select * from k2)"))


@register("json_structure", query("v_json", *_structure("v_json"), final="select * from st"))
def json_structure(spark, sf_dir):
    return jsonops.json_structure(view(spark, sf_dir, "v_json"))


@register("json_profile", query("v_json", *_structure("v_json"), final=(
    "select path, type, count(*) as n, min(length) as min_length, max(length) as max_length from st group by path, type")))
def json_profile(spark, sf_dir):
    return jsonops.json_profile(jsonops.json_structure(view(spark, sf_dir, "v_json")))


@register("json_profile_props", query((), ("src", "select event_id as capture_id, props as raw from events"), *_structure("src"), final=(
    "select path, type, count(*) as n, min(length) as min_length, max(length) as max_length from st group by path, type")))
def json_profile_props(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("capture_id"), F.col("props").alias("raw"))
    return jsonops.json_profile(jsonops.json_structure(events))


def _members(values: str, parent: str = "") -> str:
    """The merged schema of objects as text, members by name: whole numbers, texts, booleans, nulls, lists of numbers."""
    plain = "case json_type(v) when 'VARCHAR' then 'STRING' when 'BOOLEAN' then 'BOOLEAN' when 'NULL' then 'VOID' when 'ARRAY' then 'ARRAY<BIGINT>' else 'BIGINT' end"
    return f"select {parent}k, max({plain}) as t from (select {parent}unnest(json_keys(v)) as k, v as o from {values}) m, lateral (select json_extract(o, '$.\"' || k || '\"') as v) x where json_type(v) <> 'OBJECT' group by all"


@register("json_schema", query("v_json", ("j", "select case when capture_id % 2 = 0 then 'even' else 'odd' end as part, raw::json as v from v_json where json_valid(raw)"),
    ("u", "select part, json_extract(v, '$.user') as v from j"), ("a", _members("j", "part, ")), ("b", _members("u", "part, ")),
    ("i", "select part, 'OBJECT<' || string_agg(k || ': ' || t, ', ' order by k) || '>' as t from b group by part"),
    ("w", "select * from a union all select part, 'user', t from i"), ("n", "select part, count(*) as n from j group by part"),
    final="select part, 'OBJECT<' || string_agg(k || ': ' || t, ', ' order by k) || '>' as schema, max(n) as n from w join n using (part) group by part"))
def json_schema(spark, sf_dir):
    """One merged schema for the even and one for the odd captures."""
    rows = view(spark, sf_dir, "v_json").withColumn("part", F.when(F.col("capture_id") % 2 == 0, "even").otherwise("odd"))
    return jsonops.json_schema(rows, "part")


@register("json_or_text", query("v_json",
    ("b", "select capture_id, raw from v_json where capture_id >= 0 union all select -1 - page_id, 'HTTP/1.1 200 OK' || chr(10) || 'server: x' || chr(10) || chr(10) || html from pages"),
    ("body", "select capture_id, case when starts_with(raw, 'HTTP/') then regexp_replace(raw, '(?s)^HTTP/.*?\\r?\\n\\r?\\n', '') else raw end as raw from b"),
    *_structure("body"),
    ("tx", "select capture_id, raw, string_split(raw, chr(10)) as l from body where not json_valid(raw)"),
    ("uq", f"""select capture_id, list(line order by line_no) as u from (select capture_id, line, min(line_no) as line_no from
(select capture_id, generate_subscripts(l, 1) as line_no, unnest(l) as line from tx) where {trimmed('line')} <> '' group by capture_id, line) group by capture_id"""),
    final=f"""select *, null as filtered from st union all select capture_id, '$', 'text', length(raw), case when len(l) <= 40 then {trimmed('raw')} when len(u) <= 40 then array_to_string(u, chr(10))
else array_to_string(u[1:20], chr(10)) || chr(10) || chr(10) || '... (' || (len(u) - 30) || ' lines omitted) ...' || chr(10) || chr(10) || array_to_string(u[-10:], chr(10)) end
from tx left join uq using (capture_id)"""))
def json_or_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).alias("capture_id"),
        F.concat(F.lit("HTTP/1.1 200 OK\nserver: x\n\n"), "html").alias("raw"))
    return jsonops.json_or_text(view(spark, sf_dir, "v_json").unionByName(pages))
