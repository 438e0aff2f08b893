"""Rollups: deletes, batches that come again, compaction at every point of failure."""

import random
from collections import defaultdict

import pytest

from capsift.llm import tokens
from capsift.llm.common import scratch

SCHEMA = "op string, source string, lang string, tokenizer string, n_old long, n_new long"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def history(seed, n):
    """Changes of documents that come, change and go, and what is left after each of them."""
    rng, alive, out = random.Random(seed), {}, []
    for i in range(n):
        kind = rng.choice(["insert", "insert", "delete", "revise"]) if alive else "insert"
        if kind == "insert":
            key, new = (rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"])), rng.randint(0, 50)
            alive[i] = key, new
            out.append(("insert", *key, None, new))
        else:
            doc = rng.choice(sorted(alive))
            key, old = alive.pop(doc)
            new = rng.randint(0, 50) if kind == "revise" else None
            if kind == "revise":
                alive[doc] = key, new
            out.append((kind, *key, old, new))
    left = defaultdict(lambda: (0, 0))
    for key, count in alive.values():
        left[key] = left[key][0] + 1, left[key][1] + count
    return out, dict(left)


def test_totals_equal_a_recount_after_deletes_and_compaction(spark):
    rows, left = history(4, 300)
    rollup = tokens.Rollup(spark, scratch(spark))
    for i in range(0, 300, 60):
        assert rollup.commit(f"b{i}", changes(spark, rows[i:i + 60]))
        if i in (120, 180):
            rollup.compact()
            assert not rollup.commit("b0", changes(spark, rows[:60]))  # names outlive the compaction
    assert totals(rollup) == left
    rollup.compact()
    assert totals(rollup) == left and rollup.batches() == ["b0", "b120", "b180", "b240", "b60"]


def test_a_batch_that_comes_again_is_compared(spark):
    rollup = tokens.Rollup(spark, scratch(spark))
    rows, left = history(5, 40)
    rollup.commit("x", changes(spark, rows))
    assert not rollup.commit("x", changes(spark, rows[::-1]), verify=True)
    with pytest.raises(ValueError):
        rollup.commit("x", changes(spark, rows[:-1] + [("insert", "q", "q", "q", None, 1)]), verify=True)
    assert totals(rollup) == left


def test_a_compaction_that_dies_changes_no_total(spark, monkeypatch):
    rollup = tokens.Rollup(spark, scratch(spark))
    rows, left = history(6, 60)
    rollup.commit("x", changes(spark, rows[:30]))
    rollup.commit("y", changes(spark, rows[30:]))
    kept = tokens.Rollup._whole
    calls = []

    def dies(self, kind):
        calls.append(kind)
        if calls.count("base") > 3:  # the base is written, the batches are still there
            raise RuntimeError("lost")
        return kept(self, kind)

    monkeypatch.setattr(tokens.Rollup, "_whole", dies)
    try:
        rollup.compact()
    except RuntimeError:
        pass
    monkeypatch.setattr(tokens.Rollup, "_whole", kept)
    assert totals(rollup) == left
    rollup.compact()
    assert totals(rollup) == left and rollup.batches() == ["x", "y"]


def test_clashing_columns_in_changes(spark):
    rollup = tokens.Rollup(spark, scratch(spark))
    df = changes(spark, [("insert", "a", "en", "t", None, 3)]).selectExpr("*", "9L as n_docs", "9L as n_tokens", "'z' as batch")
    rollup.commit("x", df)
    assert totals(rollup) == {("a", "en", "t"): (1, 3)}
