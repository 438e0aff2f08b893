"""Hot captures: chunked operators against brute force, whatever the layout."""

import random
import re

import pytest
from pyspark.sql import functions as F

from capsift.operators import builds, cut, gitops, lines as base, logs, noise, render
from conftest import dicts


@pytest.fixture(scope="module")
def hot(spark):
    """One capture with most of the rows, a few small ones, shuffled."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["a", "b", "c"]), rng.randint(0, 60)) for i in range(3000)]
    rows += [(cid, i, rng.choice(["a", "b"]), rng.randint(0, 5)) for cid in range(2, 8) for i in range(cid)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "capture_id long, line_no long, k string, v long").repartition(7).cache()


@pytest.mark.parametrize("size", [5, 64, 10**6, None])
def test_capped_equals_brute_force(hot, size):
    rows, df = hot
    got = base.capped(df, ["capture_id", "k"], [F.col("line_no")], 4, {
        "total": ("sum", F.lit(1)), "v_sum": ("sum", F.col("v")), "first": ("min", F.col("line_no")),
        "v_max": ("max", F.col("v"))}, split=base.chunk_of(size=size or 1), limit_first=size is None)
    want = set()
    groups = {}
    for cid, no, k, v in rows:
        groups.setdefault((cid, k), []).append((no, v))
    for (cid, k), items in groups.items():
        items.sort()
        for rank, (no, v) in enumerate(items[:4], 1):
            want.add((cid, no, k, v, len(items), sum(x for _, x in items), items[0][0], max(x for _, x in items), rank))
    assert {tuple(r) for r in got.select("capture_id", "line_no", "k", "v", "total", "v_sum", "first", "v_max", "rank").collect()} == want


@pytest.mark.parametrize("size", [1, 7, 100, None])
def test_carry_equals_brute_force(hot, size):
    rows, df = hot
    got = base.carry(df, {"last": F.when(F.col("k") == "a", F.col("v")), "never": F.lit(None).cast("long")}, size)
    want, state = {}, {}
    for cid, no, k, v in sorted(rows):
        if k == "a":
            state[cid] = v
        want[cid, no] = state.get(cid)
    found = {(r.capture_id, r.line_no): r["last"] for r in got.collect()}
    assert found == want


def test_no_chunk_is_larger_than_its_size(hot):
    _, df = hot
    biggest = df.groupBy("capture_id", base.chunk_of(size=50)).count().agg(F.max("count")).first()[0]
    assert biggest <= 50


def test_generic_lines_equal_generic_text(spark):
    """The line-table cut and the cell cut keep the same lines."""
    rng = random.Random(5)
    texts = {i: "\n".join(rng.choice(["", "  ", "x", f"l{rng.randint(0, 90)}"]) for _ in range(n))
             for i, n in enumerate([3, 40, 41, 60, 300])}
    captures = spark.createDataFrame(list(texts.items()), "capture_id long, raw string")
    whole = {r.capture_id: r.filtered for r in cut.compress_generic(captures).collect()}
    parts = {}
    for r in dicts(cut.generic_lines(base.explode_lines(captures))):
        parts.setdefault(r["capture_id"], []).append(r)
    order = {"pass": 0, "distinct": 0, "head": 0, "tail": 1}
    for cid, rows in parts.items():
        rows.sort(key=lambda r: (order[r["section"]], r["rank"]))
        kept = [r["line"] for r in rows]
        assert [s for s in whole[cid].split("\n") if s.strip() and "lines omitted" not in s] == [s for s in kept if s.strip()] or \
            rows[0]["section"] == "pass"


def cut_by_hand(lines, whole=40, front=20, end=10):
    """A sequential reading of the generic cut: ``(section, rank, line, total)``."""
    if len(lines) <= whole:
        return {("pass", i, line, len(lines)) for i, line in enumerate(lines, 1)}
    distinct = list(dict.fromkeys(line for line in lines if line.strip()))
    n = len(distinct)
    if n <= whole:
        return {("distinct", i, line, n) for i, line in enumerate(distinct, 1)}
    found = list(enumerate(distinct, 1))
    return {("head", i, line, n) for i, line in found[:front]} | {("tail", i, line, n) for i, line in found[n - end:]}


@pytest.fixture(scope="module")
def texts():
    """Captures of all lengths; some repeat few lines, some hold blank lines only."""
    rng = random.Random(7)
    kinds = {cid: ([rng.choice(["", " ", "x", f"l{rng.randint(0, wide)}"]) for _ in range(n)])
             for cid, (n, wide) in enumerate((n, wide) for n in (1, 39, 40, 41, 90, 400) for wide in (3, 45, 900))}
    return {**kinds, 90: [" "] * 60, 91: [""] * 3, 92: [f"u{i}" for i in range(3000)]}


def spread(spark, texts, gap=1):
    rows = [(cid, i * gap, line) for cid, lines in texts.items() for i, line in enumerate(lines)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "capture_id long, line_no long, line string").repartition(6)


def by_capture(rows):
    found = {}
    for cid, *rest in rows:
        found.setdefault(cid, set()).add(tuple(rest))
    return found


@pytest.mark.parametrize("gap", [1, 70_001])
def test_generic_lines_equal_sequential_reading(spark, texts, gap):
    got = cut.generic_lines(spread(spark, texts, gap)).select("capture_id", "section", "rank", "line", "total").collect()
    assert by_capture(got) == {cid: cut_by_hand(lines) for cid, lines in texts.items() if cut_by_hand(lines)}
    few = cut.generic_lines(spread(spark, texts, gap), whole=5, front=30, end=40).select("capture_id", "section", "rank", "line", "total").collect()
    wide = {cid: cut_by_hand(lines, 5, 30, 40) for cid, lines in texts.items() if len(set(lines)) > 90}
    assert {cid: rows for cid, rows in by_capture(few).items() if cid in wide} == wide  # head and tail share lines or not


def test_captures_with_hits_have_no_generic_cut(spark, texts):
    """npm and prisma: one line that counts, wherever it stands, decides for its capture."""
    rng = random.Random(8)
    rows, hit = dict(texts), set()
    for cid in list(texts)[::2]:
        lines = list(texts[cid])
        lines.insert(rng.randint(0, len(lines)), "  added 3 packages ")
        rows[cid], hit = lines, hit | {cid}
    got = by_capture(noise.drop_npm_noise(spread(spark, rows)).collect())
    for cid, lines in rows.items():
        if cid in hit:
            assert got[cid] == {("summary", 1, "added 3 packages", 1)}
        else:
            assert got.get(cid, set()) == {("generic_" + s, *rest) for s, *rest in cut_by_hand(lines)}
    marked = {cid: ["Generated Prisma Client"] + lines if cid in hit else lines for cid, lines in texts.items()}
    got = by_capture(noise.drop_prisma_noise(spread(spark, marked)).collect())
    for cid, lines in marked.items():
        if cid in hit:
            assert got[cid] == {("kept", 0, "Generated Prisma Client", None)}
        else:
            assert got.get(cid, set()) == {("generic_" + s, *rest) for s, *rest in cut_by_hand(lines)}


def test_pnpm_branches_equal_sequential_reading(spark):
    rng = random.Random(9)
    kinds = ["Progress: x", "", "└ dep", "  @a/b 1.0", "+ 12 packages 3", "plain"]
    texts = {cid: [rng.choice(kinds) + ("" if i % 3 else f" {i}") for i in range(n)] for cid, n in enumerate([0, 5, 30, 38, 45, 200, 200])}
    texts[6] = [f"word{i}" for i in range(50)]  # neither a dependency nor a summary
    want = {}
    for cid, lines in texts.items():
        kept = [line for line in lines if line.strip() and not line.strip().startswith(("Progress", "Packages", "WARN"))]
        deps = [line for line in kept if line[0] == "└" or line[0] == " " and line.strip()[0] in "@0123456789"]
        if len(kept) <= 30:
            want[cid] = {("pass", i, line, len(kept)) for i, line in enumerate(kept, 1)}
        else:
            said = next((line for line in kept if "packages " in line), f"{len(deps)} packages")
            want[cid] = {("summary", 1, said, len(deps))} | {("dependency", i, line, len(deps)) for i, line in enumerate(deps[:30], 1)}
    assert by_capture(noise.drop_pnpm_noise(spread(spark, texts)).collect()) == {cid: rows for cid, rows in want.items() if rows}


def test_logcat_branches_equal_sequential_reading(spark):
    rng = random.Random(10)
    quiet = ["I/a: one", "D/b: two", "", " I/c: three "]
    texts = {cid: [rng.choice(quiet) + ("" if i % 4 else str(i)) for i in range(n)] for cid, n in enumerate([1, 20, 21, 80, 20, 60])}
    texts[4][7], texts[5][59] = "E/x: bad", "E/x: bad"
    want = {cid: {("pass", i, line, len(lines), len(lines)) for i, line in enumerate(lines, 1)} for cid, lines in texts.items() if len(lines) <= 20}
    for cid in (2, 3):
        last = [line.strip() for line in texts[cid] if line.strip()][::-1][:10]
        want[cid] = {("recent", i, line, 10, 10) for i, line in enumerate(last, 1)}
    want[5] = {("error", 1, "E/x: bad", 1, 1)}
    assert by_capture(logs.logcat_summary(spread(spark, texts)).select("capture_id", "section", "rank", "line", "total", "n_distinct").collect()) == want


def test_gradle_keeps_the_last_result_and_first_issues(spark):
    lines = (["BUILD FAILED in 1s", "> Task :a FAILED", "error: x", "error: x", "warning: w0"] + [f"warning: w{i}" for i in range(12)]
             + ["> Task :a FAILED", "BUILD SUCCESSFUL in 9s"])
    got = by_capture(builds.gradle_issues(spread(spark, {1: lines})).collect())[1]
    found = {(section, rank): tuple(rest) for section, rank, *rest in got}
    assert found["result", 1][1:] == (18, 2, 1) and ("result", 2) not in found
    assert found["error", 1] == ("error: x", 2, 2, 1)
    assert [found["warning", i][1:] for i in (1, 5)] == [(4, 13, 12), (9, 13, 12)] and ("warning", 6) not in found
    assert found["failed_task", 1][1:] == (1, 2, 2) and found["failed_task", 2][1:] == (17, 2, 2)


def test_signatures_or_first_lines(spark, texts):
    rows = {cid: lines + ["def f():"] if cid % 2 else lines for cid, lines in texts.items()}
    got = by_capture(cut.signature_lines(spread(spark, rows)).select("capture_id", "section", "line_no", "line").collect())
    assert got == {cid: {("signature", len(lines) - 1, "def f():")} if cid % 2 else {("fallback", i, line) for i, line in enumerate(lines[:30])}
                   for cid, lines in rows.items()}


#: Reads of the lines in the plan before it runs; a second one where distinct lines or counts must meet as well.
SCANS = [(cut.signature_lines, 1), (cut.generic_lines, 2), (noise.drop_npm_noise, 2), (noise.drop_prisma_noise, 3), (noise.drop_pnpm_noise, 2),
         (noise.drop_pip_noise, 2), (noise.filter_status_hints, 2), (logs.logcat_summary, 2), (builds.gradle_issues, 1), (builds.build_issues, 1)]


@pytest.mark.parametrize("fn, scans", SCANS, ids=lambda v: getattr(v, "__name__", v))
def test_lines_are_read_once_or_twice(spark, tmp_path, fn, scans):
    spark.createDataFrame([(1, 0, "x")], "capture_id long, line_no long, line string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    assert fn(df)._jdf.queryExecution().executedPlan().toString().count("FileScan") == scans


def test_null_and_missing_lines(spark):
    """A null line is blank; no line, no row; captures without an id are a group too."""
    schema = "capture_id long, line_no long, line string"
    nulls = spark.createDataFrame([(1, i, None if i % 2 else f"a{i}") for i in range(100)] + [(None, i, "b") for i in range(3)], schema)
    for fn, _ in SCANS:
        assert fn(spark.createDataFrame([], schema)).count() == 0
        fn(nulls).collect()
    rows = cut.generic_lines(nulls).collect()
    assert {r.total for r in rows if r.capture_id == 1} == {50} and sum(r.capture_id is None for r in rows) == 3


def test_large_pages_are_joined_run_by_run(spark, monkeypatch):
    monkeypatch.setattr(render, "CHUNK", 4)
    rng = random.Random(13)
    rows = [(cid, o1, o2, o3, rng.choice([f"t{o2}.{o3}", "", None])) for cid, n in ((1, 300), (2, 3)) for o1 in (-1, 0, 1)
            for o2 in [*rng.sample(range(-50, 2 * n), n), render.LAST] for o3 in range(rng.randint(1, 3))]
    rows += [(3, 0, 0, 0, None), (4, 0, 9, 0, None), (4, 0, 1, 0, "only"), (None, 0, 0, 0, "unnamed")]
    want = {cid: "\n".join(text for *_, text in sorted((r[1:] for r in rows if r[0] == cid), key=lambda r: r[:3]) if text is not None)
            for cid in (1, 2, 3, 4, None)}
    rng.shuffle(rows)
    pages = render.page_text(spark.createDataFrame(rows, "capture_id long, o1 long, o2 long, o3 long, text string").repartition(5))
    assert {r.capture_id: r.filtered for r in pages.collect()} == want


def test_results_do_not_depend_on_layout(spark, make_lines):
    text = "\n".join(f"2024-01-01 00:00:0{i % 10} ERROR job {i % 7} failed {1000 + i}" for i in range(400))
    lines = make_lines({1: text, 2: "WARN a\nwarn a\ninfo"})
    runs = [sorted(map(tuple, logs.log_templates(lines.repartition(n)).collect())) for n in (1, 3, 16)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 9


def brute_diff(lines):
    """A sequential reading of the same rules."""
    name = mark = None
    hunk, changed, stats = False, False, {}
    for no, line in enumerate(lines):
        if line.startswith("diff --git"):
            name, hunk, changed = (no, line.split(" b/")[1]), False, False
            stats[name] = [0, 0]
        elif line.startswith("@@"):
            hunk, changed = True, False
        elif name and hunk and line[:1] in "+-" and line:
            stats[name][line[0] == "-"] += 1
    return {(at, n): tuple(v) for (at, n), v in stats.items()}


@pytest.mark.parametrize("chunk", [3, 16, None])
def test_diffs_equal_sequential_reading(spark, chunk):
    rng = random.Random(11)
    parts = ["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1 +1 @@", "+a", "-b", " c", "--- c", "+++ d", "\\ No newline"]
    texts = {cid: [rng.choice(parts) for _ in range(rng.randint(1, 60))] for cid in range(40)}
    rows = [(cid, i, line) for cid, lines in texts.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id long, line_no long, line string").repartition(5)
    got = {}
    for r in gitops.diff_stat(df, plain=False, chunk=chunk).collect():
        got.setdefault(r.capture_id, {})[r.file_at, r.file] = (r.added, r.removed)
    assert got == {cid: brute_diff(lines) for cid, lines in texts.items() if brute_diff(lines)}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_plain_diffs_do_not_depend_on_chunks(spark, chunk):
    """Headers of diffs made without git at every place of a chunk, borders too."""
    rng = random.Random(12)
    parts = ["--- a/x", "+++ b/x", "--- a/y\tt", "+++ b/y\tt", "@@ -1 +1 @@", "+a", "-b", " c", "--- c"]
    texts = {cid: [rng.choice(parts + (["diff --git a/z b/z"] if cid % 3 == 0 else [])) for _ in range(rng.randint(1, 40))] for cid in range(60)}
    rows = [(cid, i, line) for cid, lines in texts.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id long, line_no long, line string").repartition(3)
    for fn in (gitops.diff_stat, gitops.diff_condense):
        assert sorted(map(tuple, fn(df, chunk=chunk).collect())) == sorted(map(tuple, fn(df, chunk=None).collect()))


def test_diffs_read_their_lines_twice(spark, tmp_path):
    spark.createDataFrame([(1, 0, "x")], "capture_id long, line_no long, line string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    for fn in (gitops.diff_stat, gitops.diff_condense):
        for plain in (True, False):
            assert fn(df, plain)._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2


def test_carried_lines_are_no_side_of_a_join(spark, tmp_path):
    """A short file may hold many lines: taken by its size, they would be sent to the driver whole."""
    spark.range(10).write.parquet(str(tmp_path / "d"))
    text = F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("@@ "), k.cast("string"))))
    df = spark.read.parquet(str(tmp_path / "d")).select(F.lit(1).cast("long").alias("capture_id"), F.col("id").alias("line_no"), text.alias("line"))
    made = [fn(df, plain) for fn in (gitops.diff_stat, gitops.diff_condense) for plain in (True, False)] + [gitops.commit_log_verbose(df)]
    for rows in made:
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_last_headers_are_found_once_per_chunk(spark):
    """Headers of a chunk are matched before they are searched, not again at every header."""
    df = spark.createDataFrame([(1, i, ("--- a/x", "+++ b/x", "@@ -1 +1 @@", "+a")[i % 4]) for i in range(400)], "capture_id long, line_no long, line string")
    rows = gitops.diff_stat(df, chunk=64)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_intersect(") == 1
    assert sorted(map(tuple, rows.collect())) == [(1, i + 1, "x", 1, 0, 1) for i in range(0, 400, 4)]


def page_of(rows, hunk_cap, cap):
    """A sequential reading of one capture: what is shown, its first rows, the number of all."""
    name = mark = None
    hunk, changed, shown, in_group = False, False, [], {}
    for no, line in sorted(rows):
        kind = None
        if line.startswith("diff --git"):
            name, mark, hunk, changed, kind = (no, line.split(" b/")[1]), no, False, False, "file"
        elif line.startswith("@@"):
            mark, hunk, changed, kind = no, True, False, "hunk" if name else None
        elif name and hunk:
            changed = changed or line[:1] in "+-"
            kind = "line" if changed and not line.startswith("\\") else None
        if kind:
            in_group[mark, kind] = in_group.get((mark, kind), 0) + 1
            if in_group[mark, kind] <= hunk_cap:
                text = name[1] if kind == "file" else line.split("@@")[1].strip() if kind == "hunk" else line
                shown.append((no, name[1], name[0], mark, kind, text))
    return [(rank, *row, row[4] == "line" and in_group[row[3], "line"] >= hunk_cap, len(shown))
            for rank, row in enumerate(shown[:cap], 1)]


@pytest.mark.parametrize("chunk", [1, 5, 16, None])
@pytest.mark.parametrize("hunk_cap,cap", [(2, 5), (3, 12)])
def test_pages_of_diffs_equal_sequential_reading(spark, chunk, hunk_cap, cap):
    """Hunks over several chunks, chunks beyond the page, captures without a header, lines that come more than once."""
    rng = random.Random(13)
    head, body = ["diff --git a/x b/x", "@@ -1 +1 @@ f"], ["+a", "-b", " c", "--- c", "+++ d", "\\ No newline"]
    rows = []
    for cid in range(60):
        often = rng.choice([0.02, 0.2, 0.6])
        lines = [rng.choice(head if rng.random() < often else body) for _ in range(rng.randint(1, 90))]
        rows += [(cid or None, i, line) for i, line in enumerate(lines) for _ in range(1 + (cid % 4 == 1) + 5 * (cid % 8 == 1 and i % 7 == 0))]
    texts = {}
    for cid, no, line in rows:
        texts.setdefault(cid, []).append((no, line))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "capture_id long, line_no long, line string").repartition(5)
    want = [(cid, *row) for cid, lines in texts.items() for row in page_of(lines, hunk_cap, cap)]
    got = gitops.diff_condense(df, False, hunk_cap, cap, chunk).select(
        "capture_id", "rank", "line_no", "file", "file_at", "hunk_at", "kind", "line", "truncated", "n_rows")
    order = lambda row: (row[0] or 0, row[1])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pages_of_diffs_shuffle_lines_once(spark):
    """By chunk; then what is left by capture.  The borders of chunks are two small ones."""
    df = spark.range(10).selectExpr("id % 2 as capture_id", "id as line_no", "'@@' as line")
    assert exchanges(gitops.diff_condense(df, False)) <= 4


def test_chunks_beyond_the_page_pass_on_their_last_hunk(spark):
    """Two headers a chunk of ten lines: five chunks fill a page of ten rows, the others tell their number of rows."""
    text = ["diff --git a/x b/x", "@@ -1 +1 @@", "+a", "@@ -2 +2 @@", "+b", "+c", "@@ -3 +3 @@", "+d", "+e", " f"]
    df = spark.createDataFrame([(1, i, text[i % 10]) for i in range(4000)], "capture_id long, line_no long, line string")
    rows = gitops.diff_condense(df, False, 30, 10, 10)
    assert [r.n_rows for r in rows.collect()] == [4000] * 10
    shown = gitops._diff_state(df, False, 10, True, 30).withColumn("kind", F.when(F.col("is_header"), "file").when(F.col("is_hunk"), "hunk").otherwise("line"))
    kept = gitops._page_rows(shown, 30, 10, 10).groupBy((F.col("line_no") / 10).cast("long").alias("c")).agg(F.count("*").alias("n"), F.sum("rest").alias("rest")).collect()
    assert {(r.n, r.rest) for r in kept if r.c > 5} == {(4, 6)} and sum(r.n + r.rest for r in kept) == 4000


def history_of(rows):
    """A sequential reading of one capture's history: number of a commit's line and its text, cut to 80."""
    found = []
    for no, line in sorted(rows):
        full, short = re.match(r"commit\s+([a-f0-9]+)", line), re.match(r"([a-f0-9]{7,})\s+(.+)", line)
        if (full or short) and not (found and found[-1][0] == no):
            found.append([no, full and full[1][:7], short and f"{short[1][:7]} {short[2]}", None])
        elif found and line.startswith("    ") and line.strip(" \t\n\r\f\v") and not found[-1][3]:
            found[-1][3] = line.strip(" \t\n\r\f\v")
    texts = [(no, short or " ".join(x for x in (full, subject) if x)) for no, full, short, subject in found]
    return [(no, x if len(x) <= 80 else x[:77] + "...") for no, x in texts]


@pytest.mark.parametrize("chunk", [1, 4, 64, None])
def test_histories_equal_sequential_reading(spark, chunk):
    """Subjects behind a border of chunks, blank and overlong ones, lines without text, rows that come twice, no capture."""
    rng = random.Random(14)
    parts = ["commit 0123456789abcdef", "commit \t fee", "commit xyz", "commit", "abcdef01 one line", "abcdef01 " + "é" * 73, "abcdef01 " + "é" * 72,
             "abcdef01 ", "abc short", "    subject", "    " + "s" * 72, "    " + "s" * 73, "  two", "    ", "     \t ", "      ", "    commit abc", "Author: A", "", None]
    rows = []
    for cid in range(60):
        lines = [rng.choice(parts) for _ in range(rng.randint(1, 60))]
        rows += [(cid or None, i, line) for i, line in enumerate(lines) for _ in range(1 + (cid % 3 == 1))]
    texts = {}
    for cid, no, line in rows:
        texts.setdefault(cid, []).extend([(no, line)] if line is not None else [])
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (1, None, "commit abc")], "capture_id long, line_no long, line string").repartition(3)
    got = sorted(map(tuple, gitops.commit_log_verbose(df, chunk).collect()), key=lambda row: (row[0] or 0, row[1]))
    want = [(cid, *row) for cid, lines in texts.items() for row in history_of(lines)]
    assert got == sorted(want, key=lambda row: (row[0] or 0, row[1]))


def test_histories_shuffle_what_is_shown(spark):
    """Neither lines that tell nothing of a commit nor whole lines come to the first shuffle."""
    df = spark.range(10).selectExpr("id as capture_id", "id as line_no", "string(id) as line")
    text = gitops.commit_log_verbose(df)._jdf.queryExecution().optimizedPlan().toString()
    lines = text[text.index("Union"):].split("\n")
    assert "text#" in lines[1] and " line#" not in lines[1] and "RLIKE" in text
