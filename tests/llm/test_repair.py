"""Structure repair against all edit sequences, long runs against the plain DP, and the defined cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from capsift.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def every_edit(rows):
    """Cost and audit of each edit sequence whose result has the shape; rows are (initial, fault)."""
    best = []
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]

    def go(i, cost, audit, roles):
        for added in inserts:
            c, a, r = cost + 3 * len(added), audit + "I" * len(added), roles + "".join(added)
            if i == len(rows):
                if SHAPE.match(r):
                    best.append((c, a, r))
                continue
            initial, fault = rows[i]
            go(i + 1, c + 4, a + "D", r)
            if fault not in "bd":
                late = 3 if fault == "t" else 0
                go(i + 1, c + late, a + "K", r + initial)
                for role in "ua":
                    go(i + 1, c + 3 + late, a + "R", r + role)

    go(0, 0, "", "")
    return min(best)


def code(initial, fault):
    return "sua".find(initial) % 4 * 4 + "nbdt".index(fault)


def runs_of(rows):
    return [(code(*k), len(list(g))) for k, g in itertools.groupby(rows)]


def test_audit_is_the_least_of_all_edit_sequences():
    rng = random.Random(5)
    for n in range(5):
        for _ in range(40 if n < 4 else 12):
            rows = [(rng.choice("suax"), rng.choice("nnnbdt")) for _ in range(n)]
            assert repair.audit_of(runs_of(rows)) == every_edit(rows)[:2], rows


def forward(rows):
    """Least (cost, audit) per state, row by row."""
    states = {"": (0, "")}
    then = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(found):
        for _ in range(2):
            for state, (cost, audit) in list(found.items()):
                to, way = then[state], (cost + 3, audit + "I")
                found[to] = min(found.get(to, way), way)
        return found

    for initial, fault in rows:
        found = {}
        for state, (cost, audit) in inserted(states).items():
            ways = [(state, cost + 4, "D")]
            if fault not in "bd":
                late = 3 if fault == "t" else 0
                if initial == then[state] or (initial == "s" and state == ""):
                    ways.append((initial, cost + late, "K"))
                ways.append((then[state], cost + 3 + late, "R"))
            for to, c, letter in ways:
                found[to] = min(found.get(to, (c, audit + letter)), (c, audit + letter))
        states = found
    states = inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


@pytest.mark.parametrize("unroll", [3, 4096])
def test_long_runs_equal_the_plain_dp(monkeypatch, unroll):
    monkeypatch.setattr(repair, "UNROLL", unroll)
    rng = random.Random(9)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 8)):
            rows += [(rng.choice("suax"), rng.choice("nnbdt"))] * rng.choice([1, 1, 2, 5, 33])
        assert repair.audit_of(runs_of(rows)) == forward(rows), rows


def test_a_run_of_millions_takes_powers_not_rows():
    cost, audit = repair.audit_of([(code("u", "n"), 1), (code("u", "d"), 3_000_000), (code("a", "n"), 1)])
    assert cost == 12_000_000 and len(audit) == 3_000_002 and audit[0] == audit[-1] == "K" and set(audit[1:-1]) == {"D"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        h = zlib.crc32(":".join(shown).encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def by_rule(rows):
    """The contract's columns per conversation, one row after the other."""
    result = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in after if r[0] == conv and type(r[0]) is type(conv)]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            shown = text.strip(" \t\n\v\f\r")
            faults.append("b" if not shown else "d" if (role, text) in seen else "n" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = forward(list(zip(initials, faults))) if mine else (0, "")
        lines, state, rest = [], "", iter(mine)
        then = {"": "user", "s": "user", "u": "assistant", "a": "user"}
        for letter in audit:
            _, role, text = (None, then[state], "") if letter == "I" else next(rest)
            if letter != "D":
                role = then[state] if letter == "R" else role
                lines.append(f"{role}:{text}")
                state = role[:1]
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                        illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return result


SCHEMA = "conv_id long, turn long, role string, text string"


def report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["conv_id"]: tuple(r)[1:] for r in repair.report(repair.damage(df)).collect()}


def test_report_equals_the_rules_on_odd_rows(spark):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", None, "", "uncle", "User"]
    texts = ["Yes.", "No", "", " \t", None, "what?", "x" * 70_000 + "!", "a\nb.", "Ünï.", "Yes.", " "]
    rows = [(c, rng.choice([t, t, t * 3, None]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "Hi.") for t in range(4)] + [(-7, None, None, None)] * 5
    rows += [r for r in rows[:40]]
    assert report(spark, rows) == by_rule(rows)


def test_one_hot_conversation_over_many_tasks(spark):
    rows = [(1, t, ("user", "assistant")[t % 2] if t % 11 else "user", f"line {t % 4000}." if t % 7 else "open") for t in range(25_000)]
    rows += [(2, 5, "user", "same.")] * 3_000 + [(3, 0, "system", "Be brief.")]
    assert report(spark, rows) == by_rule(rows)


def test_a_conversation_that_loses_all_rows_stays(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "Hello.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table_and_clashing_columns(spark):
    assert report(spark, []) == {}
    rows = [(1, 0, "user", "Hi.", "x", 9, "y"), (1, 1, "assistant", "Yes", "x", 9, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", digest string, copies int, audit string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(repair.damage(df)).collect()}
    assert got == by_rule([r[:4] for r in rows])


def test_repaired_rows_are_whole(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "C.")], SCHEMA + "")
    messages = df.selectExpr("*", "1 as copies")
    plan = repair.plans(messages)
    rows = [(r["place"], r["edit"], r["role"], r["text"]) for r in repair.repaired(messages, plan).orderBy("place").collect()]
    assert "".join(r[1] for r in rows) == plan.first()["audit"].replace("D", "")
    assert SHAPE.match("".join(r[2][0] for r in rows)) and [r[0] for r in rows] == list(range(len(rows)))
