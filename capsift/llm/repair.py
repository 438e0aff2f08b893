"""Conversation structure repair: a run-length min-plus DP over role and fault symbols.

A row of a conversation is one symbol: the initial of its role (``s``, ``u``, ``a`` or another) and
its first fault (blank, duplicate, truncated or none).  Equal consecutive symbols are one
run.  A symbol is a 4 x 4 matrix of edit costs over what is written so far (nothing, a
system row, an open user row, a closed pair), insertions before the row included.  A run of
``n`` equal symbols moves the costs by the binary powers of its matrix, which are cached, so
the DP costs ``log n`` products a run.  The audit is then unrolled from the front: at every
row the ASCII-least letter that lies on a cheapest way, so ties need no second search.

Edits: Keep 0; Rerole to user or assistant 3; Delete 4, required for blank and duplicate
rows; Insert an empty user or assistant row 3; a truncated row that stays costs 3 more.  The
result has the role initials ``(s?(ua)+)?``.

How it runs: symbols are narrow rows (no text).  Rows equal in conversation, turn, role and
text combine to a count before the shuffle, first occurrences come from an aggregate and a
join, and a range partitioning by conversation and place deals a conversation of any size over
tasks.  What meets per conversation is its runs, which are no longer than the audit that is
returned in one cell.  The repaired rows stream through one task per conversation, sorted by
the shuffle (which spills): SHA-256 can only be computed in order.  No task holds a conversation's texts.

Defined cases: null role or text is one space; null turns come first and are no gap; rows of
one turn go by the MD5 of role and text; a null ``conv_id`` is a conversation of its own; a role
is judged by its first character alone; a conversation of which no row is left has zeros, an
empty audit and the hash of the empty string; no row, no result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from capsift.llm.common import scratch, stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NONE, BLANK, DUPLICATE, CUT = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
START, OPENED, ASKED, CLOSED = range(4)  # nothing written, a system row, a user row to be answered, a whole pair
_THEN = (ASKED, ASKED, CLOSED, ASKED)  # the state after an inserted or rerolled row
_FAR = 1 << 40
#: Cost of the insertions that end a conversation from each state.
_END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Rows of one run whose costs are held at once while the audit is unrolled.
UNROLL = 4096

Costs = tuple[int, int, int, int]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: each row dropped (no copies), emptied, cut, repeated, reroled or left, by its place."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


@lru_cache(maxsize=None)
def moves(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """``letter, state after, cost`` of each way to treat a row of symbol ``code``; insertions apart."""
    role, fault = divmod(code, 4)
    out = [("D", state, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        if role == SYSTEM and state == START:
            out.append(("K", OPENED, extra))
        if (role == USER and state != ASKED) or (role == ASSISTANT and state == ASKED):
            out.append(("K", _THEN[state], extra))
        out.append(("R", _THEN[state], REROLE + extra))
    return tuple(out)


def _product(a: tuple[Costs, ...], b: tuple[Costs, ...]) -> tuple[Costs, ...]:
    return tuple(tuple(min(row[k] + b[k][j] for k in range(4)) for j in range(4)) for row in a)


@lru_cache(maxsize=None)
def power(code: int, exponent: int) -> tuple[Costs, ...]:
    """The min-plus matrix of ``2 ** exponent`` rows of a symbol, insertions before each of them included."""
    if exponent:
        half = power(code, exponent - 1)
        return _product(half, half)
    row = [[_FAR] * 4 for _ in range(4)]
    insert = [[0 if i == j else _FAR for j in range(4)] for i in range(4)]
    for state in range(4):
        insert[state][_THEN[state]] = INSERT
        for _, after, cost in moves(code, state):
            row[state][after] = min(row[state][after], cost)
    twice = _product(insert, insert)  # a third insertion in one place only repeats a pair
    return _product(twice, row)


def before(code: int, length: int, after: Costs) -> Costs:
    """Costs to the end before a run, from the costs after it."""
    exponent = 0
    while length:
        if length & 1:
            matrix = power(code, exponent)
            after = tuple(min(row[k] + after[k] for k in range(4)) for row in matrix)
        length, exponent = length >> 1, exponent + 1
    return after


@lru_cache(maxsize=1 << 16)
def _row(code: int, state: int, after: Costs) -> tuple[str, int]:
    """Letters of one row, insertions before it included, and the state after it; ``after`` counts from its least cost."""
    letters, here = "", before(code, 1, after)
    while True:
        ways = [(letter, to, cost + after[to], True) for letter, to, cost in moves(code, state)]
        ways.append(("I", _THEN[state], INSERT + here[_THEN[state]], False))
        letter, to, _, done = min(way for way in ways if way[2] == here[state])
        letters, state = letters + letter, to
        if done:
            return letters, state


def _level(costs: Costs) -> Costs:
    least = min(costs)
    return tuple(c - least for c in costs)


def audit_of(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """Least cost and ASCII-least cheapest edits of runs ``(symbol, length)``."""
    if not runs:
        return 0, ""
    ends = [_END]
    for code, length in reversed(runs):
        ends.append(before(code, length, ends[-1]))
    cost, ends = ends[-1][START], ends[-2::-1]
    state, letters = START, []
    for (code, length), end in zip(runs, ends):
        while length:
            size = min(length, UNROLL)
            length -= size
            after = [_level(before(code, length, end))]  # costs after each row of this piece, last row first
            for _ in range(size - 1):
                after.append(_level(before(code, 1, after[-1])))
                if after[-1] == after[-2]:  # settled: all rows before this one see the same costs
                    break
            settled, after = size - len(after), after[::-1]
            while settled:
                row, to = _row(code, state, after[0])
                repeat = settled if to == state else 1
                letters.append(row * repeat)
                state, settled = to, settled - repeat
            for costs in after:
                row, state = _row(code, state, costs)
                letters.append(row)
    while _END[state]:
        letters.append("I")
        state = _THEN[state]
    return cost, "".join(letters)


@lru_cache(maxsize=1 << 14)
def _short(codes: bytes, lengths: tuple[int, ...]) -> tuple[int, str]:
    return audit_of(list(zip(codes, lengths)))


def faults(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last visible character ends no sentence."""
    shown = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return shown == "", ~F.right(shown, F.lit(1)).isin(".", "!", "?")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def symbols(messages: DataFrame) -> DataFrame:
    """One narrow row per distinct (conversation, turn, role, text): its digest, role, faults and number of copies."""
    blank, cut = faults(F.col("text"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return (messages.select("conv_id", F.col("turn").cast("long").alias("turn"), _digest().alias("digest"), role.alias("role"),
                            F.when(blank, BLANK).when(cut, CUT).otherwise(NONE).alias("fault"), F.col("copies").cast("long").alias("copies"))
            .groupBy("conv_id", "turn", "digest", "role", "fault").agg(F.sum("copies").alias("copies")))


def _encode(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Codes, lengths and owners (rows of the batch) of the runs, two at most for each row: its first copy and the others."""
    role, fault, copies, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("role", "fault", "copies", "first"))
    blank = fault == BLANK
    lead = np.where(blank, BLANK, np.where(first.astype(bool), fault, DUPLICATE))
    rest = np.where(blank, BLANK, DUPLICATE)
    codes = np.stack([role * 4 + lead, role * 4 + rest], 1).ravel()
    lengths = np.stack([np.minimum(copies, 1), np.maximum(copies - 1, 0)], 1).ravel()
    owners = np.repeat(np.arange(len(role)), 2)
    held = lengths > 0
    return codes[held].astype(np.uint8), lengths[held].astype(np.int64), owners[held]


def _pieces(schema: pa.Schema):
    """Sorted symbols -> runs of each conversation, one row per conversation and batch."""
    def collapse(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            heads = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
            codes, lengths, owners = _encode(batch)
            new = np.ones(len(codes), bool)
            new[1:] = (np.diff(codes.astype(np.int16)) != 0) | (np.diff(conv[owners]) != 0)
            at = np.flatnonzero(new)
            codes, lengths, owners = codes[at], np.add.reduceat(lengths, at) if len(at) else lengths, owners[at]
            cuts = np.searchsorted(owners, np.append(heads, batch.num_rows))
            turns = batch.column("turn")
            named = turns.is_valid().to_numpy(zero_copy_only=False) & (batch.column("copies").to_numpy(zero_copy_only=False) > 0)
            values = turns.fill_null(0).to_numpy(zero_copy_only=False)
            bounds = [(a, b) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows])]
            seen = [np.unique(values[a:b][named[a:b]]) for a, b in bounds]
            rows = {
                "conv_id": batch.column("conv_id").take(pa.array(heads)),
                "part": [part] * len(heads), "number": list(range(number, number + len(heads))),
                "codes": [codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
                "lengths": [lengths[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
                "lo": [int(s[0]) if len(s) else None for s in seen], "hi": [int(s[-1]) if len(s) else None for s in seen],
                "turns": [len(s) for s in seen]}
            number += len(heads)
            yield pa.RecordBatch.from_arrays([rows[f.name] if f.name == "conv_id" else pa.array(rows[f.name], f.type) for f in schema], schema=schema)
    return collapse


def _solved(pieces: list[dict]) -> tuple:
    """The result columns of one conversation from its pieces in order."""
    codes, lengths = b"".join(p["codes"] for p in pieces), np.concatenate([np.frombuffer(p["lengths"], np.int64) for p in pieces])
    count = {fault: 0 for fault in range(4)}
    illegal, last, runs = 0, None, []
    for code, length in zip(codes, lengths.tolist()):
        role, fault = divmod(code, 4)
        count[fault] += length
        illegal += length - 1 + (last is not None and (last, role) not in _LEGAL)
        last = role
        if runs and runs[-1][0] == code:  # a run that goes on in the next piece
            runs[-1] = (code, runs[-1][1] + length)
        else:
            runs.append((code, length))
    if len(runs) <= 32:
        cost, audit = _short(bytes(c for c, _ in runs), tuple(n for _, n in runs))
    else:
        cost, audit = audit_of(runs)
    dated = [p for p in pieces if p["turns"]]
    gaps = 0
    if dated:
        distinct = sum(p["turns"] for p in dated) - sum(a["hi"] == b["lo"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["hi"] - dated[0]["lo"] + 1 - distinct
    return gaps, count[BLANK], count[DUPLICATE], count[CUT], illegal, cost, audit


_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _solve(schema: pa.Schema):
    def solve(batches):
        for batch in batches:
            rows = list(zip(*map(_solved, batch.column("pieces").to_pylist()))) or [()] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, f.type) for c, f in zip(rows, list(schema)[1:])]], schema=schema)
    return solve


def plans(messages: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of ``conv_id, turn, role, text, copies``."""
    folder = scratch(messages.sparkSession)
    rows = stored(symbols(messages), folder, "symbols")
    order = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    firsts = rows.filter("copies > 0").groupBy("conv_id", "digest").agg(F.min(order)["turn"].alias("first_turn"))
    firsts = firsts.withColumnsRenamed({"conv_id": "first_conv", "digest": "first_digest"})
    same = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("digest") == F.col("first_digest"))
    first = F.col("turn").eqNullSafe(F.col("first_turn")).alias("first")
    placed = rows.join(firsts, same, "left").select("conv_id", "turn", "digest", "role", "fault", "copies", first)
    place = ("conv_id", "turn", "digest")
    ordered = placed.repartitionByRange(*place).sortWithinPartitions(*place)
    key = messages.select("conv_id").schema
    parts = messages.sparkSession.createDataFrame([], key).select(
        "conv_id", *[F.lit(0).cast(t).alias(n) for n, t in (("part", "int"), ("number", "long"))],
        *[F.lit(b"").alias(n) for n in ("codes", "lengths")], *[F.lit(0).cast("long").alias(n) for n in ("lo", "hi", "turns")]).schema
    for field in parts:
        field.nullable = True
    runs = stored(ordered.mapInArrow(_pieces(to_arrow_schema(parts)), parts), folder, "runs")
    whole = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in runs.columns if c != "conv_id"]))).alias("pieces"))
    out = whole.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _RESULT[:-1]], F.lit("").alias("audit")).schema
    return stored(whole.mapInArrow(_solve(to_arrow_schema(out)), out), folder, "plans")


def _edited(schema: pa.Schema):
    """Plans and messages in order -> the rows that are left, as ``conv_id, place, edit, role, text``."""
    def edit(batches):
        audit, at, state, place = "", 0, START, 0
        conv = None
        out: list[tuple] = []

        def insert():
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                out.append((conv, place, "I", "assistant" if state == ASKED else "user", ""))
                at, state, place = at + 1, _THEN[state], place + 1

        def batch_of():
            columns = list(zip(*out)) or [()] * len(schema)
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return done

        for batch in batches:
            for key, found, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies"))):
                if found is not None:  # a plan: its conversation begins
                    conv, audit, at, state, place = key, found, 0, START, 0
                    insert()
                for _ in range(copies):
                    letter, at = audit[at], at + 1
                    if letter != "D":
                        if letter == "R":
                            role = "assistant" if state == ASKED else "user"
                        state = OPENED if letter == "K" and role[:1] == "s" else _THEN[state]
                        out.append((key, place, letter, role, text))
                        place += 1
                    insert()
            yield batch_of()
    return edit


def repaired(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired rows ``conv_id, place, edit, role, text``; one conversation's rows lie in one task, in order."""
    begin = plan.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"),
                        "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    rows = messages.filter("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), _digest().alias("digest"),
        F.lit(None).cast("string").alias("audit"), "role", "text", F.col("copies").cast("int").alias("copies"))
    ordered = begin.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "digest")
    out = plan.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")).schema
    return ordered.mapInArrow(_edited(to_arrow_schema(out)), out)


def _hashed(schema: pa.Schema):
    """Rows as ``repaired`` gives them -> ``conv_id, repaired_sha256``."""
    def digest(batches):
        nothing = object()
        conv, sha = nothing, None
        for batch in batches:
            done = []
            for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if conv is not nothing:
                        done.append((conv, sha.hexdigest()))
                    conv, sha = key, hashlib.sha256()
                sha.update(f"{role}:{text}".encode() if place == 0 else f"\n{role}:{text}".encode())
            columns = list(zip(*done)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        if conv is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([conv], schema.field(0).type), pa.array([sha.hexdigest()])], schema=schema)
    return digest


def report(messages: DataFrame) -> DataFrame:
    """The contract's columns, from the plans and the repaired rows."""
    plan = plans(messages)
    out = plan.select("conv_id", F.lit("").alias("repaired_sha256")).schema
    hashes = repaired(messages, plan).mapInArrow(_hashed(to_arrow_schema(out)), out).withColumnRenamed("conv_id", "hashed")
    sha = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return plan.join(hashes, F.col("conv_id").eqNullSafe(F.col("hashed")), "left").select("conv_id", *_RESULT, sha)


_FAR_SQL = 1000000


def _sql_insert(frm: str, role: str) -> str:
    return f"{{c: {frm}.c + 3, a: {frm}.a || 'I', r: {frm}.r || chr(10) || '{role}:'}}"


def _sql_inserted(states: str) -> str:
    """The four states after one insertion or none."""
    e, s, u, a = (f"{states}[{i}]" for i in range(1, 5))
    asked = ", ".join([u, *[_sql_insert(x, "user") for x in (e, s, a)]])
    return f"[{e}, {s}, list_min([{asked}]), list_min([{a}, {_sql_insert(u, 'assistant')}])]"


def _sql_bound(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def _sql_row(states: str, row: str) -> str:
    """The four states after one row: ``row`` is [(must go, initial, text), (penalty, role, '')]."""
    e, s, u, a = (f"{states}[{i}]" for i in range(1, 5))
    gone = lambda x: f"{{c: {x}.c + 4, a: {x}.a || 'D', r: {x}.r}}"
    bar = lambda ok: f"case when {row}[1].c = 0 and {ok} then 0 else {_FAR_SQL} end"
    kept = lambda x, initial: f"{{c: {x}.c + {row}[2].c + {bar(f'{row}[1].a = {initial!r}')}, a: {x}.a || 'K', r: {x}.r || chr(10) || {row}[2].a || ':' || {row}[1].r}}"
    named = lambda x, role: f"{{c: {x}.c + 3 + {row}[2].c + {bar('true')}, a: {x}.a || 'R', r: {x}.r || chr(10) || '{role}:' || {row}[1].r}}"
    asked = ", ".join([gone(u), *[kept(x, "u") for x in (e, s, a)], *[named(x, "user") for x in (e, s, a)]])
    closed = ", ".join([gone(a), kept(u, "a"), named(u, "assistant")])
    return f"[{gone(e)}, list_min([{gone(s)}, {kept(e, 's')}]), list_min([{asked}]), list_min([{closed}])]"


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda ch: ascii(ch)::bigint)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))))"""
_FIRST = ", ".join(f"{{c: {c}, a: '', r: ''}}" for c in (0, *[_FAR_SQL] * 3))
_STEP = _sql_bound(_sql_inserted("acc"), "once", _sql_bound(_sql_inserted("once"), "twice", _sql_row("twice", "el")))
_FINAL = _sql_bound(_sql_inserted("z"), "once", _sql_bound(_sql_inserted("once"), "twice", "list_min([twice[1], twice[4]])"))

ORACLE = f"""
with k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
h as (select *, {_CRC} % 20 as h from k),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case h when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
o as (select *, left(role, 1) as x, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as cut,
    row_number() over (partition by conv_id order by turn nulls first, md5(cast(length(role) as varchar) || ':' || role || text), copy) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen from d),
f as (select *, case when blank then 'b' when seen > 1 then 'd' when cut then 't' else '' end as fault, lag(x) over (partition by conv_id order by i) as w from o),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (w is not null and (w || x) not in ('su', 'ua', 'au')) as illegal,
    list([{{c: cast(fault in ('b', 'd') as int), a: x, r: text}}, {{c: case fault when 't' then 3 else 0 end, a: role, r: ''}}] order by i) as els
  from f group by conv_id),
z as (select *, list_reduce(els, lambda acc, el: {_STEP}, [{_FIRST}]) as z from g),
b as (select *, {_FINAL} as best from z),
c as (select distinct conv_id from conversations)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(substr(best.r, 2), '')) as repaired_sha256
from c left join b on c.conv_id is not distinct from b.conv_id
"""
