"""Routing and audit queries."""

from pyspark.sql import functions as F

from capsift import rules as R
from capsift.operators import audit, route
from capsift.operators.ledger import blocked_rows
from capsift.plans.catalog import register
from capsift.plans.sql import query, trimmed
from capsift.plans.views import view
from capsift.sources.readers import captures as build_captures


def _q(text: str) -> str:
    return text.replace("'", "''")


def _ascii(pattern: str) -> str:
    return _q(pattern.replace(R.WB, r"\b").replace(R.WE, r"\b"))


_CMD = f"lower({trimmed('command')})"
_CASE = "case " + " ".join(f"when regexp_matches({_CMD}, '{_ascii(p)}') then '{label}'" for label, p in R.ROUTES) + (
    rf" when regexp_matches({_CMD}, '\bjson\b') and json_valid(raw) then 'json'"
    " when len(string_split(raw, chr(10))) > 40 then 'generic' else 'passthrough' end")


@register("route_strategy", query("v_command_runs", final=f"select capture_id, command, {_CASE} as strategy from v_command_runs"))
def route_strategy(spark, sf_dir):
    return route.route_strategy(view(spark, sf_dir, "v_command_runs")).drop("raw")


@register("route_captures", query("v_captures", ("c", "select *, stdout || case when stderr <> '' then chr(10) || stderr else '' end as raw from v_captures"),
    final=f"select {_CASE} as strategy, tool, cast(count(*) as bigint) as n from c group by all"))
def route_captures(spark, sf_dir):
    routed = route.route_strategy(build_captures(view(spark, sf_dir, "v_captures")))
    return routed.groupBy("strategy", "tool").agg(F.count(F.lit(1)).alias("n"))


def _handler_case(value) -> str:
    c = trimmed("command")
    return "case " + " ".join(f"when regexp_matches({c}, '{_q(p)}') then {value(label, p, cut)}" for label, p, cut in R.HANDLERS) + " end"


def _rest(label, pattern, cut) -> str:
    c = trimmed("command")
    if label == "grep":
        return f"regexp_extract({c}, '{_q(R.GREP_ARGS)}', 1)"
    left = f"regexp_replace({c}, '{_q(cut)}', '')" if cut else c
    return f"case when {left} = '' then '.' else {left} end" if label == "ls" else left


@register("route_tool", query("v_commands", ("t", f"select *, {_handler_case(lambda l, p, c: chr(39) + l + chr(39))} as tool, "
                                                  f"{_handler_case(_rest)} as rest from v_commands"),
    final=f"select *, case when tool = 'grep' then regexp_extract({trimmed('command')}, '{_q(R.GREP_ARGS)}', 2) end as path from t"))
def route_tool(spark, sf_dir):
    return route.route_tool(view(spark, sf_dir, "v_commands"))


@register("extract_search_pattern", query("v_commands", final=(
    f"select *, regexp_extract({_CMD}, '{_q(R.SEARCH_PATTERN)}', 1) as pattern from v_commands "
    rf"where regexp_matches({_CMD}, '^(grep|rg|ag)\b')")))
def extract_search_pattern(spark, sf_dir):
    return route.extract_search_pattern(view(spark, sf_dir, "v_commands"))


_PREFIX = f"regexp_extract({trimmed('command')}, '^(\\S+)', 1)"
_ALLOWED = f"{_PREFIX} in ({', '.join(repr(p) for p in R.ALLOWED_PREFIXES)})"


@register("audit_allowlist", query("v_commands", final=f"select *, {_PREFIX} as prefix, {_ALLOWED} as allowed from v_commands"))
def audit_allowlist(spark, sf_dir):
    return audit.audit_allowlist(view(spark, sf_dir, "v_commands"))


def _meta(text: str) -> dict[str, str]:
    span = _q(R.QUOTED_SPAN)
    token = f"regexp_extract(regexp_replace({text}, '{span}', chr(1), 'g'), '{R.SHELL_TOKEN}', 1)"

    def pick(i: int) -> str:
        return "case " + " ".join(f"when {token} = '{t}' then '{_q(e[i])}'" for t, e in R.SHELL_RULES.items()) + " end"

    inner = r"regexp_replace(s, '\\[\s\S]', '', 'g')"
    return {"safe": f"{token} = ''", "rule": pick(0), "reason": pick(1),
            "substitution_in_quotes": f"len(list_filter(regexp_extract_all({text}, '{span}'), lambda s: starts_with(s, '\"') and "
                                      f"(contains({inner}, '$(') or contains({inner}, chr(96))))) > 0",
            "bare_newline": f"contains(regexp_replace({text}, '{span}', chr(1), 'g'), chr(10))"}


@register("audit_metachars", query("v_commands", final="select *, " + ", ".join(
    f"{sql} as {name}" for name, sql in _meta("command").items()) + " from v_commands"))
def audit_metachars(spark, sf_dir):
    return audit.audit_metachars(view(spark, sf_dir, "v_commands"))


@register("audit_path", query("v_paths",
    ("d", "select *, case when contains(regexp_replace(path, '%[0-9A-Fa-f]{2}', '', 'g'), '%') then null "
          "else replace(url_decode(path), chr(92), '/') end as decoded from v_paths"),
    ("r", "select *, case when decoded is null then 'malformed' when contains(decoded, '../') or contains(decoded, '/..') then 'traversal' "
          "when contains(lower(path), '%2e%2e') then 'encoded_traversal' end as rule from d"),
    final="select *, rule is null as safe from r"))
def audit_path(spark, sf_dir):
    return audit.audit_path(view(spark, sf_dir, "v_paths"))


_ARGS = "case when instr(command, ' ') > 0 then substring(command, instr(command, ' ') + 1) else '' end"
_M = _meta("args")
_GATE = (("a", f"select *, {_ARGS} as args, {_PREFIX} as prefix, {_ALLOWED} as allowed from v_commands"),
         ("v", f"select command_id, user_id, command, prefix, allowed, allowed and {_M['safe']} as safe, "
               f"case when not allowed then 'allowlist' else {_M['rule']} end as rule, "
               f"case when not allowed then 'command not in allowlist: ''' || prefix || '''' else {_M['reason']} end as reason, "
               f"{_M['substitution_in_quotes']} as substitution_in_quotes, {_M['bare_newline']} as bare_newline from a"))


@register("audit_commands", query("v_commands", *_GATE, final="select * from v"))
def audit_commands(spark, sf_dir):
    return audit.audit_commands(view(spark, sf_dir, "v_commands"))


@register("audit_rule_counts", query("v_commands", *_GATE, final=(
    "select coalesce(rule, 'ok') as rule, cast(count(*) as bigint) as n, cast(count(distinct prefix) as bigint) as n_prefixes from v group by 1")))
def audit_rule_counts(spark, sf_dir):
    return audit.audit_rule_counts(audit.audit_commands(view(spark, sf_dir, "v_commands")))


@register("sink_blocked", query("v_commands", *_GATE, final=(
    "select command_id as id, command as raw_cmd, 'run' as tool, 0::bigint as raw_tokens, 0::bigint as filtered_tokens, "
    "0::bigint as tokens_saved, true as blocked, reason as block_reason from v where not safe")))
def sink_blocked(spark, sf_dir):
    return blocked_rows(audit.audit_commands(view(spark, sf_dir, "v_commands")))
