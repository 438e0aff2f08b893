"""Caps are keywords: none, the default, and more than the default give the rows they promise."""

import pytest
from pyspark.sql import functions as F

from capsift.operators import builds, cut, gitops, jsonops, logs, matches, noise, tables
from capsift.plans.compress import compress_with
from capsift.plans.views import view
from conftest import SF_DIR, dicts


def sizes(df):
    out = {}
    for r in df.collect():
        out[r["section"]] = out.get(r["section"], 0) + 1
    return out


@pytest.mark.parametrize("fn,word,default", [
    (builds.build_issues, "error", 30), (builds.gradle_issues, "error", 30), (builds.next_issues, "error", 20), (logs.logcat_summary, "error", 20)])
def test_sections_by_cap(make_lines, fn, word, default):
    text = {builds.gradle_issues: "error: number {}", logs.logcat_summary: "E/x: error {}", builds.next_issues: "error: {}"}.get(fn, "error: number {}")
    lines = make_lines({1: "\n".join(text.format(i) for i in range(60))})
    assert sizes(fn(lines))[word] == default
    assert sizes(fn(lines, caps={word: None}))[word] == 60
    assert sizes(fn(lines, caps={word: 45}))[word] == 45
    assert {r["total"] for r in fn(lines, caps={word: 3}).collect() if r["section"] == word} == {60}
    with pytest.raises(ValueError):
        fn(lines, caps={"nothing": 1})


def test_noise_filters_by_cap(make_lines):
    npm = make_lines({1: "\n".join(f"npm ERR! {i}" for i in range(50)), 2: "\n".join(f"added {i} packages" for i in range(50))})
    assert sizes(noise.drop_npm_noise(npm)) == {"error": 20, "summary": 5}
    assert sizes(noise.drop_npm_noise(npm, errors=None, summaries=None)) == {"error": 50, "summary": 50}
    pip = make_lines({1: "\n".join(f"p{i}" for i in range(50)), 2: "one"})
    assert sizes(noise.drop_pip_noise(pip)) == {"head": 20, "pass": 1}
    assert sizes(noise.drop_pip_noise(pip, head=None)) == {"head": 50, "pass": 1}
    assert sizes(noise.drop_pip_noise(pip, whole=50)) == {"pass": 51}
    pnpm = make_lines({1: "packages: 3\n" + "\n".join(f"  dep{i}" for i in range(50))})
    assert sizes(noise.drop_pnpm_noise(pnpm)) == {"summary": 1, "dependency": 30}
    assert sizes(noise.drop_pnpm_noise(pnpm, dependencies=None)) == {"summary": 1, "dependency": 50}
    files = make_lines({1: "\n".join(f"f{i}.ts" for i in range(30))})
    assert noise.unformatted_files(files).count() == 20 and noise.unformatted_files(files, None).count() == 30


def test_cuts_paths_and_json_by_cap(spark, make_lines, make_captures):
    plain = make_lines({1: "\n".join(f"line {i}" for i in range(100))})
    assert cut.signature_lines(plain).count() == 30 and cut.signature_lines(plain, None).count() == 100
    assert sizes(cut.generic_lines(plain)) == {"head": 20, "tail": 10} and sizes(cut.generic_lines(plain, whole=100)) == {"pass": 100}
    assert sizes(cut.generic_lines(plain, front=3, end=60)) == {"head": 3, "tail": 60}
    paths = matches.split_path(make_lines({1: "\n".join(f"a/f{i}" for i in range(50))}))
    assert sizes(matches.paths_by_dir(paths)) == {"dir": 3} and sizes(matches.paths_by_dir(paths, head=None)) == {"dir": 50}
    assert sizes(matches.paths_by_dir(paths, whole=None)) == {"dir": 50} and sizes(matches.paths_by_dir(paths, short=50)) == {"short": 50}
    deep = make_captures((1, "c", '{"a":{"b":{"c":{"d":1}}}}'))
    assert {r.path for r in jsonops.json_structure(deep).collect()} == {"$", "$.a", "$.a.b"}
    assert "$.a.b.c.d" in {r.path for r in jsonops.json_structure(deep, levels=8).collect()}


def test_conflicting_files_are_listed_on_demand(make_lines):
    lines = make_lines({1: "## main\nUU a\nAA b\nDU c\n" + "\n".join(f"?? u{i}" for i in range(9))})
    assert [(r["file"], r["total"]) for r in dicts(gitops.status_summary(lines).where("section = 'conflict'"))] == [("", 3)]
    found = dicts(gitops.status_summary(lines, caps={"conflict": None, "untracked": None}), "section", "rank")
    assert [r["file"] for r in found if r["section"] == "conflict"] == ["a", "b", "c"]
    assert sum(r["section"] == "untracked" for r in found) == 9


HEADED = {"kubectl": "NAME      READY   STATUS    RESTARTS   AGE\nweb-1     1/1     Running   0          3d",
          "docker_ps": 'CONTAINER ID  IMAGE  COMMAND  CREATED  STATUS  PORTS  NAMES\nabc  nginx  "x"  2 days ago  Up 2 days  80/tcp  web',
          "docker_images": "REPOSITORY   TAG   IMAGE ID   CREATED   SIZE\nnginx   latest   abc   2 days ago   100MB"}


@pytest.mark.parametrize("kind", sorted(HEADED))
@pytest.mark.parametrize("before", ["", "\n", "  \n\n"])
def test_headers_behind_blank_lines(make_lines, kind, before):
    rows = tables.table_rows(make_lines({1: before + HEADED[kind] + "\n\n" + HEADED[kind]}, kind=kind)).collect()
    assert len(rows) == 2 and not any("NAME" in (r["text"] or "") or "REPOSITORY" in r["text"] for r in rows)


def test_logs_of_containers_are_logs(make_captures):
    raw = "2024-01-01 ERROR one two three four five six\nINFO ok"
    for reader, command in (("kubectl", "kubectl logs web"), ("kubectl", "kubectl -n prod logs web"), ("docker", "docker logs web")):
        text = compress_with(make_captures((1, command, raw)), reader).first().filtered
        assert text.startswith("Log Summary") and "four five six" in text
    pods = compress_with(make_captures((1, "kubectl get pods -l app=logs", HEADED["kubectl"])), "kubectl").first().filtered
    assert pods.startswith("1 resource(s)")


def test_corpus_totals_come_from_daily_sketches(spark, tmp_path):
    lines = view(spark, SF_DIR, "v_log_lines").withColumn("line", F.concat("line", F.lit(" user u"), (F.col("line_no") % 5000 + 0).cast("string"), F.lit("x")))
    logs.log_sketches(lines).write.partitionBy("date").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    got = {r.severity: r for r in logs.log_totals_of(stored).collect()}
    exact = {r.severity: r for r in logs.with_severity(lines).withColumn("t", F.when(F.col("severity") == "info", "").otherwise(
        logs.normalize_log_line(F.col("line")))).groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("t").alias("u")).collect()}
    assert set(got) == set(exact) and len(got) == 3
    for name, row in exact.items():
        assert got[name].n == row.n and abs(got[name].n_unique - row.u) <= 0.02 * row.u + 1
    days = logs.log_totals_of(stored.where("date < '2024-01-10'"), "date")
    assert days.agg(F.sum("n")).first()[0] < sum(r.n for r in exact.values())
