"""Line and record views derived from the given tables.

The tables hold no tool output, so operators that parse a tool's format read
text composed from table rows.  Each view is one SELECT that Spark and a plain
SQL engine evaluate alike; ``{TS}``, ``{K}``, ``{JOINED}`` and ``{DOC_LINES}`` mark the few
spots that need one spelling per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SPELLING = {
    "spark": {
        "{TS}": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')",
        "{JOINED}": "array_join(sort_array(collect_list(struct(line_no, line))).line, chr(10))",
        "{K}": "lateral view explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8)) ks as k",
        "{DOC_LINES}": "select doc_id as capture_id, cast(pos as bigint) as line_no, line\n"
                       "from documents lateral view posexplode(split(text, chr(10), -1)) t as pos, line",
    },
    "duckdb": {
        "{TS}": "strftime(ts, '%Y-%m-%d %H:%M:%S')",
        "{JOINED}": "string_agg(line, chr(10) order by line_no)",
        "{K}": ", unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) ks(k)",
        "{DOC_LINES}": "select doc_id as capture_id, cast(generate_subscripts(l, 1) - 1 as bigint) as line_no,\n"
                       "  unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)",
    },
}

VIEWS = {
    "v_doc_lines": "{DOC_LINES}",
    "v_log_lines": """select user_id as capture_id, event_id as line_no, ts,
  concat({TS}, ' ',
    case event_type when 'error' then 'ERROR' when 'purchase' then 'WARN' when 'signup' then 'DEBUG' else 'INFO' end,
    ' req=0x', hex(event_id + 4096), ' took ', cast(floor(value) as bigint) % 9, ' id ', 100000 + event_id,
    ' at /srv/', event_type, '/', event_id % 7) as line
from events""",
    "v_logcat_lines": """select user_id as capture_id, event_id as line_no,
  concat(case event_type when 'error' then 'E/' when 'purchase' then 'W/' when 'signup' then 'F/' else 'I/' end,
    case event_id % 5 when 0 then 'AndroidRuntime' when 1 then 'ActivityManager' else 'Net' end,
    '(', 1000 + event_id % 50, '): ', case event_id % 11 when 0 then 'ANR in app' else 'step done' end) as line
from events""",
    "v_diag_lines": """select o_custkey % 200 as capture_id, o_orderkey as line_no,
  case o_orderkey % 4
    when 0 then concat('src/m', o_custkey % 23, '.ts(', o_orderkey % 900 + 1, ',', o_custkey % 80 + 1, '): ',
      case when o_orderstatus = 'F' then 'error' else 'warning' end, ' TS', 2300 + o_custkey % 17, ': Bad type ', o_orderpriority)
    when 1 then concat('  ', o_orderkey % 900 + 1, ':', o_custkey % 80 + 1, '  ',
      case when o_orderstatus = 'F' then 'error' else 'warning' end, '  Unexpected ', o_orderstatus, ' value  no-rule-', o_custkey % 9)
    when 2 then concat('pkg/m', o_custkey % 19, '.py:', o_orderkey % 900 + 1, ':', o_custkey % 80 + 1, ': E', 500 + o_custkey % 12, ' line too long')
    else concat('noise ', o_orderkey) end as line
from orders""",
    "v_build_lines": """select o_custkey % 200 as capture_id, o_orderkey as line_no,
  case o_orderkey % 8
    when 0 then concat('error: module m', o_custkey % 13, ' missing')
    when 1 then concat('warning: unused m', o_custkey % 13)
    when 2 then '0 errors found'
    when 3 then concat('> Task :m', o_custkey % 7, ':compile ', case when o_orderstatus = 'F' then 'FAILED' else 'UP-TO-DATE' end)
    when 4 then case when o_orderstatus = 'F' then 'BUILD FAILED in 12s' else 'BUILD SUCCESSFUL in 9s' end
    when 5 then concat('w: deprecated call ', o_custkey % 5)
    when 6 then '   '
    else concat('Compiling m', o_orderkey) end as line
from orders""",
    "v_test_lines": """select o_custkey % 200 as capture_id, o_orderkey as line_no,
  case o_orderkey % 9
    when 0 then concat('test result: ', case when o_orderstatus = 'F' then 'FAILED' else 'ok' end, '. ', o_custkey % 50, ' passed; ', case when o_orderstatus = 'F' then 1 + o_custkey % 3 else 0 end, ' failed; 0 ignored')
    when 1 then concat('test mod::t', o_custkey % 40, ' ... ', case when o_orderstatus = 'F' then 'FAILED' else 'ok' end)
    when 2 then concat('===== ', 1 + o_custkey % 4, ' failed, ', o_custkey % 60, ' passed in 0.12s =====')
    when 3 then concat('FAILED tests/test_m', o_custkey % 12, '.py::test_x - AssertionError')
    when 4 then concat('--- FAIL: TestG', o_custkey % 15, ' (0.00s)')
    when 5 then concat('--- PASS: TestG', o_custkey % 15, ' (0.00s)')
    when 6 then concat('Tests: ', o_custkey % 3, ' failed, ', o_custkey % 30, ' passed, ', o_custkey % 3 + o_custkey % 30, ' total')
    when 7 then concat('{"Action":"', case when o_orderstatus = 'F' then 'fail' else 'pass' end, '","Package":"p","Test":"TestJ', o_custkey % 25, '"}')
    else concat('   Tests  ', 1 + o_custkey % 3, ' failed | ', o_custkey % 30, ' passed') end as line
from orders""",
    "v_diff_lines": """select o_custkey % 100 as capture_id, o_orderkey * 10 + k as line_no,
  case k
    when 0 then concat('diff --git a/src/f', o_orderkey % 37, '.py b/src/f', o_orderkey % 37, '.py')
    when 1 then concat('--- a/src/f', o_orderkey % 37, '.py')
    when 2 then concat('+++ b/src/f', o_orderkey % 37, '.py')
    when 3 then concat('@@ -', o_orderkey % 90 + 1, ',3 +', o_orderkey % 90 + 1, ',4 @@ def f')
    when 4 then ' context before'
    when 5 then concat('-old ', o_orderpriority)
    when 6 then case when o_orderstatus = 'F' then '--- sql comment removed' else ' context mid' end
    when 7 then concat('+new ', o_orderpriority)
    else case when o_orderstatus = 'P' then '+extra' else ' context after' end end as line
from orders {K}""",
    "v_status_lines": """select p_partkey % 20 as capture_id, p_partkey as line_no,
  case when p_partkey < 20 then concat('## main...origin/main [ahead ', p_size, ']')
    else concat(case p_partkey % 7 when 0 then 'M ' when 1 then ' M' when 2 then '??' when 3 then 'A ' when 4 then 'UU' when 5 then 'MM' else 'AA' end,
      ' src/', p_type, '/f', p_partkey, '.py') end as line
from part""",
    "v_log_blocks": """select o_custkey % 50 as capture_id, o_orderkey as line_no,
  concat(lower(hex(o_orderkey + 268435456)), ' ', case when o_orderkey % 6 = 0 then repeat('long subject ', 9) else concat('Fix ', o_orderpriority) end,
    chr(10), case o_orderkey % 3 when 0 then 'Signed-off-by: A <a@example.com>' when 1 then concat('Body for ', o_orderkey) else '' end,
    chr(10), case when o_orderkey % 2 = 0 then 'second body line' else '' end) as block
from orders""",
    "v_grep_lines": """select o_custkey % 100 as capture_id, o_orderkey as line_no,
  concat('src/area', o_custkey % 11, '/deep/er/path/that/is/rather/long/file', o_custkey % 31, '.py:',
    case when o_orderkey % 5 = 0 then '' else concat(o_orderkey % 700 + 1, ':') end,
    '   ', repeat('pad ', cast(o_orderkey % 60 as int)), 'needle ', o_orderpriority, repeat(' tail', cast(o_orderkey % 40 as int))) as line
from orders""",
    "v_listing": """select p_partkey % 35 as capture_id, p_partkey as line_no,
  concat('root/', case when p_partkey % 29 = 0 then 'node_modules' else lower(p_type) end, '/', replace(p_brand, '#', '')) as dir,
  concat(replace(p_name, ' ', '_'), p_partkey, case p_partkey % 6 when 0 then '.py' when 1 then '.ts' when 2 then '.json' when 3 then '' when 4 then '.md' else '.rs' end) as name,
  cast(p_size as bigint) * 51200 + p_partkey as size, p_partkey % 17 = 0 as is_dir
from part""",
    "v_ls_lines": """select p_partkey % 40 as capture_id, p_partkey as line_no,
  concat(case when p_partkey % 17 = 0 then 'drwxr-xr-x' else '-rw-r--r--' end, '  1 root root  ', cast(p_size as bigint) * 51200 + p_partkey,
    ' Jan  1 10:00 ', case when p_partkey % 34 = 0 then 'node_modules' else concat(replace(p_name, ' ', '_'), p_partkey, case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '' end) end) as line
from part""",
    "v_table_lines": """select p_partkey % 25 as capture_id, p_partkey as line_no,
  case p_partkey % 4
    when 0 then concat('c', lower(hex(p_partkey + 1048576)), 'abcdef  img:', p_size, '  "run x"  2 days ago  ', case when p_size % 2 = 0 then 'Up 2 days' else 'Exited (1)' end, '  80/tcp  name', p_partkey)
    when 1 then concat('pod-', p_partkey, '   1/1   ', case when p_size % 3 = 0 then 'CrashLoopBackOff' else 'Running' end, '   ', p_size, '   3d   10.0.0.1')
    when 2 then concat('#', p_partkey, chr(9), p_name, chr(9), case when p_size % 2 = 0 then 'OPEN' else 'MERGED' end, chr(9), p_brand, chr(9), 'x')
    else concat('serial', p_partkey, chr(9), case when p_size % 2 = 0 then 'device' else 'offline' end) end as line,
  case p_partkey % 4 when 0 then 'docker_ps' when 1 then 'kubectl' when 2 then 'gh' else 'adb_devices' end as kind
from part""",
    "v_env_lines": """select p_partkey % 7 as capture_id, p_partkey as line_no,
  concat(case p_partkey % 6 when 0 then 'API_KEY_' when 1 then 'PATH_' when 2 then 'DB_PASSWORD_' when 3 then 'monkey_' when 4 then 'HOME_' else 'no_equals ' end, p_partkey,
    case when p_partkey % 6 = 5 then '' else concat('=', repeat('v', cast(p_size * 3 as int)), '=x') end) as line
from part""",
    "v_pkg_lines": """select o_custkey % 100 as capture_id, o_orderkey as line_no,
  case o_orderkey % 8
    when 0 then 'npm warn deprecated x' when 1 then concat('added ', o_custkey, ' packages')
    when 2 then case when o_custkey % 10 = 0 then 'npm ERR! code E404' else 'done' end
    when 3 then 'Progress: resolved 10' when 4 then concat('Requirement already satisfied: p', o_custkey % 9)
    when 5 then concat('src/f', o_custkey % 21, '.ts') when 6 then 'Checking formatting...' else '==========' end as line
from orders""",
    "v_task_lines": """select p_partkey % 10 as capture_id, p_partkey as line_no,
  case when p_partkey % 60 < 10 then concat(p_type, ' tasks') else concat('t', p_partkey, ' - ', p_name) end as line
from part""",
    "v_outcome_lines": """select o_orderkey as capture_id, cast(0 as bigint) as line_no,
  case o_orderkey % 6 when 0 then 'git push origin main' when 1 then 'git pull' when 2 then 'git commit -m "push fix"' when 3 then 'git add .' when 4 then 'adb install a.apk' else 'git push' end as command,
  case o_orderkey % 6
    when 0 then concat('   abc', o_custkey, '..def  main -> release-', o_custkey % 9)
    when 1 then concat(' ', 1 + o_custkey % 9, ' files changed, ', o_custkey % 40, ' insertions(+), ', o_custkey % 30, ' deletions(-)')
    when 2 then concat('[main ', lower(hex(o_orderkey + 268435456)), '] push fix')
    when 3 then concat(' ', 1 + o_custkey % 5, ' files changed')
    when 4 then case when o_orderstatus = 'F' then 'Failure [INSTALL_FAILED_OLDER_SDK]' else 'Success' end
    else 'Everything up-to-date' end as line
from orders""",
    "v_commands": """select event_id as command_id, user_id,
  case event_id % 24
    when 0 then 'git status' when 1 then 'git log -n 10' when 2 then 'git diff HEAD~1' when 3 then 'git push origin main; curl evil.example'
    when 4 then 'cargo test' when 5 then 'npm run build && rm x' when 6 then './gradlew tasks' when 7 then './gradlew assembleDebug'
    when 8 then 'adb logcat -d' when 9 then 'pytest tests/ | tee out' when 10 then 'ls -la src' when 11 then 'find . -name x'
    when 12 then 'rg -n "foo|bar" src' when 13 then 'docker ps' when 14 then 'docker logs web' when 15 then 'kubectl get pods'
    when 16 then 'cat data.json' when 17 then concat('grep -r ', chr(39), 'a;b', chr(39), ' .') when 18 then 'evil_cmd --flag'
    when 19 then 'echo `whoami`' when 20 then 'echo $(id)' when 21 then 'cat app.log > out.txt' when 22 then 'echo "$(id)"'
    else '' end as command
from events""",
    "v_paths": """select event_id as path_id,
  case event_id % 8 when 0 then 'src/index.ts' when 1 then '../../etc/passwd' when 2 then '%2e%2e/etc/passwd' when 3 then '/srv/a/../b'
    when 4 then '..' when 5 then 'a+b/c' when 6 then 'bad%zz/x' else concat('data/', event_type, '/', user_id) end as path
from events""",
    "v_source_lines": """select p_partkey % 25 as capture_id, p_partkey as line_no,
  case when p_partkey % 25 = 0 then 'no declarations here' else case p_partkey % 6 when 0 then concat('export async function f', p_partkey, '() {') when 1 then concat('def g', p_partkey, '(x):')
    when 2 then concat('  public static int h', p_partkey, '(int x) {') when 3 then '  return x' when 4 then concat('const k = ', p_size) else '' end end as line
from part""",
    "v_json": """select event_id as capture_id,
  case when event_id % 10 = 9 then concat('not json ', event_id)
    else concat('{"user":{"id":', user_id, ',"name":"u', user_id, '"},"type":"', event_type, '","ok":', case when event_id % 2 = 0 then 'true' else 'false' end,
      ',"tags":[', event_id % 3, ',', event_id % 5, '],"none":null}') end as raw
from events""",
    "v_json_diag": """select user_id as capture_id, event_id as line_no,
  case when event_id % 2 = 0
    then concat('[{"filename":"p', event_id % 13, '.py","message":"msg ', event_type, '","code":"E', event_id % 30, '","location":{"row":', event_id % 400, ',"column":', event_id % 80, '}}]')
    else concat('{"Issues":[{"FromLinter":"l', event_id % 6, '","Text":"t ', event_type, '","Pos":{"Filename":"f', event_id % 9, '.go","Line":', event_id % 300, '}}]}') end as raw
from events""",
    "v_captures": """select doc_id as capture_id, source as tool, concat('cat ', source, '/', doc_id, '.log') as command,
  case when doc_id % 7 = 0 then 1 else 0 end as exit_code, text as stdout,
  case when doc_id % 5 = 0 then concat('warning: doc ', doc_id) else '' end as stderr
from documents""",
    "v_ledger": """select event_id as id, ts, concat('cmd ', event_type, ' ', user_id) as raw_cmd, concat('tool_', event_type) as tool,
  case when event_id % 50 = 0 then 0 else cast(floor(value * 10) as bigint) end as raw_tokens,
  case when event_id % 50 = 0 then 0 else cast(floor(value * 3) as bigint) + event_id % 20 end as filtered_tokens,
  greatest(cast(0 as bigint), case when event_id % 50 = 0 then 0 else cast(floor(value * 10) as bigint) - cast(floor(value * 3) as bigint) - event_id % 20 end) as tokens_saved,
  event_id % 50 = 0 as blocked
from events""",
    "v_verbose_lines": """select p_partkey % 9 as capture_id, p_partkey as line_no,
  case p_partkey % 5 when 0 then '  (use "git add <file>..." to update what will be committed)' when 1 then 'Changes not staged for commit:'
    when 2 then concat(chr(9), 'modified:   f', p_partkey, '.py') when 3 then case when p_partkey % 9 = 4 and p_partkey > 100 then 'nothing to commit, working tree clean' else '' end
    else '  (create/copy files and use "git add" to track)' end as line
from part""",
}

_COMMANDS = VIEWS["v_commands"]
#: commands with an output to route by: the event's JSON properties
VIEWS["v_command_runs"] = _COMMANDS.replace(
    "select event_id as command_id, user_id,", "select event_id as capture_id, props as raw,")
#: histories as plain text: hash line, author, blank line, indented subject
VIEWS["v_history_lines"] = """select o_custkey % 50 as capture_id, o_orderkey * 10 + k as line_no,
  case when o_orderkey % 5 = 0 then case when k = 0 then concat(lower(hex(o_orderkey + 268435456)), ' one line ', o_orderpriority) else '' end
    when k = 0 then concat('commit ', lower(hex(o_orderkey + 268435456)), 'abcdef')
    when k = 1 then 'Author: A <a@example.com>' when k = 3 then concat('    Fix ', o_orderpriority, ' in ', o_orderkey)
    when k = 5 then '    second line of the body' else '' end as line
from orders {K}"""
#: unified diffs made without git: file headers are the ---/+++ pair
VIEWS["v_plain_diff_lines"] = """select o_custkey % 100 as capture_id,
  o_orderkey * 10 + k as line_no,
  case k when 0 then concat('--- old/f', o_orderkey % 37, '.py') when 1 then concat('+++ new/f', o_orderkey % 37, '.py')
    when 2 then '@@ -1,3 +1,4 @@' when 3 then ' context' when 4 then concat('-old ', o_orderpriority)
    when 5 then case when o_orderstatus = 'F' then '--- sql comment removed' else ' mid' end
    when 6 then concat('+new ', o_orderpriority) when 7 then '+more' else ' end' end as line
from orders {K}"""
#: build steps of Next.js and pytest blocks, for the branches the other views leave out
VIEWS["v_next_lines"] = """select o_custkey % 200 as capture_id, o_orderkey as line_no,
  case o_orderkey % 7 when 0 then concat('Error: page m', o_custkey % 13, ' failed') when 1 then concat('warn: slow page ', o_custkey % 11)
    when 2 then 'Compiling pages' when 3 then 'Route (app)   Size   First Load JS' when 4 then '\u2713 Compiled successfully'
    when 5 then '\u25cb  (Static) error: not an issue' else concat('done ', o_orderkey) end as line
from orders"""
VIEWS["v_pytest_lines"] = """select o_custkey % 200 as capture_id, o_orderkey as line_no,
  case o_orderkey % 6 when 0 then concat('______ test_m', o_custkey % 12, ' ______') when 1 then concat('E   assert ', o_custkey % 40, ' == 2')
    when 2 then '    assert x' when 3 then case when o_orderstatus = 'F' then '======= short summary =======' else 'x = 1' end
    when 4 then concat('FAILED tests/test_m', o_custkey % 12, '.py::test_x') else concat('  expect(', o_custkey % 9, ') failed') end as line
from orders"""
VIEWS["v_win_lines"] = """select p_partkey % 40 as capture_id, p_partkey as line_no,
  case when p_partkey % 17 = 0 then concat('01/02/2024  10:00 AM    <DIR>          d', p_partkey)
    else concat('01/02/2024  10:00 AM         ', cast(p_size as bigint) * 1000 + p_partkey, ' f', p_partkey, case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '' end) end as line
from part"""

_BODY = re.compile(r"(?<=from )(" + "|".join(TABLES) + r")\b")


def _spell(name: str, engine: str) -> str:
    sql = VIEWS[name]
    for mark, text in _SPELLING[engine].items():
        sql = sql.replace(mark, text)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables in ``sf_dir``."""
    return spark.sql(_BODY.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", _spell(name, "spark")))


def with_views(*names: str) -> str:
    """``with v as (...)`` in plain SQL, ready for further common table expressions."""
    return "with " + ",\n".join(f"{name} as (\n{_spell(name, 'duckdb')})" for name in names)
