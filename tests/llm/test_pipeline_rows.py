"""The last three stages and the whole run against brute force; empty tables, clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from .test_small import DE, DOCS, EN

WORDS = [f"word{i}" for i in range(300)]


def texts(seed):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=55))
    short = " ".join(rng.choices(WORDS, k=20))
    out = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(25)]
    out += [" ".join(rng.choices(WORDS, k=30)) + f" {passage} " + " ".join(rng.choices(WORDS, k=9)) for _ in range(4)]
    return out + [f"{short} {i}" for i in range(5)] + [passage, "", passage + " " + passage, "x" * 40_000]


def test_repeated_passages_go_byte_by_byte(spark):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts(1))] + [(90, None, None, None, None)]
    seen = Counter(t[i:i + pipeline.REPEAT_BYTES] for _, t, *_ in rows if t for i in range(len(t) - pipeline.REPEAT_BYTES + 1))
    want = Counter()
    for doc_id, t, *rest in rows:
        keep = bytearray(b"\1") * len(t or "")
        for i in range(len(keep) - pipeline.REPEAT_BYTES + 1):
            if seen[t[i:i + pipeline.REPEAT_BYTES]] > 1:
                keep[i:i + pipeline.REPEAT_BYTES] = bytes(pipeline.REPEAT_BYTES)
        if all(keep):
            want[doc_id, t, rest[-1]] += 1
        elif any(keep):
            left = "".join(c for c, k in zip(t, keep) if k)
            want[doc_id, left, len(left)] += 1
    got = pipeline.drop_repeated_text(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == want and len(want) < len(rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents in two languages, near copies, repeats, leaks, and a benchmark with a nameless item."""
    at = tmp_path_factory.mktemp("sf")
    rng = random.Random(7)
    rows = []
    for i in range(240):
        base = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(rng.choices(base, k=40)) + f" {i}", "en" if i % 2 else "de", f"s{i % 3}", 1))
    leak, nameless = " ".join(rng.choices(EN.split(), k=12)), " ".join(rng.choices(EN.split(), k=13))
    rows += [(300, "the dog " + leak + " went", "en", "s0", 1), (301, "their friends " + nameless, "en", "s1", 1), (302, rows[1][1], "en", "s1", 1), (303, None, None, None, None), (304, "12 !!", "en", "s2", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, leak), (None, nameless), (2, None), (3, "no such thing at all")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows, (leak, nameless)


def test_leaks_go_with_and_without_an_id(spark, folder):
    at, rows, leaks = folder
    got = {r.doc_id for r in pipeline.drop_contaminated(spark, spark.createDataFrame(rows, DOCS), at).collect()}
    grams = {tuple(t.split()[i:i + 10]) for t in leaks for i in range(len(t.split()) - 9)} | {("no", "such", "thing", "at", "all")}
    holds = lambda t: any(tuple(t.split()[i:i + n]) in grams for n in (5, 10) for i in range(len(t.split()) - n + 1))
    assert got == {i for i, t, *_ in rows if not holds(t or "")} and not {300, 301} & got


def test_run_applies_the_stages_in_turn(spark, folder):
    at, rows, _ = folder
    kept = {r.doc_id: r for r in pipeline.run(spark, at).collect()}
    assert not {300, 301, 303, 304} & set(kept) and len({1, 302} & set(kept)) <= 1
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), stage(spark, docs, at).schema)
    assert {r.doc_id: r.taken for r in docs.collect()} == {i: r.taken for i, r in kept.items()}
    assert len(kept) > 100


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    at, rows, _ = folder
    none = spark.createDataFrame([], DOCS)
    wide = spark.createDataFrame(rows[:40], DOCS)
    for name in ("size", "score", "spans", "items", "text_key", "root", "component_id", "near", "kept", "doc"):
        wide = wide.selectExpr("*", f"'theirs' as {name}")
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, at).collect() == [], name
        out = stage(spark, wide, at)
        if name != "mixing":
            assert out.columns == wide.columns and all(r["spans"] == "theirs" and r["doc"] == "theirs" for r in out.collect()), name
        else:
            assert out.count() > 0
