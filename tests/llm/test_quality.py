"""Passages against a plain count, slopes against finite differences, held-out accuracy and the defined cases."""

import random
import re
import zlib

import numpy as np
import pytest

from capsift.llm import quality


def columns(*texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)


def passages_of(*texts):
    found = [(f, texts_ + a) for a, b, f, texts_ in quality.bags(*columns(*texts))]
    return np.concatenate([f for f, _ in found]), np.concatenate([t for _, t in found])


def plain(text):
    """The features of one text, a passage after the other."""
    data = text.encode()
    starts = quality.passage_starts(np.frombuffer(data, np.uint8), 0, len(data))
    runs, rows = set(), []
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for start, stop in zip(starts, [*starts[1:], len(data)]):
        pairs, lengths, seen, again, repeated = np.zeros((quality._KINDS,) * 2), np.zeros(len(quality._LENGTHS) + 1), set(), 0, 0
        for x, y in zip(data[start:stop], data[start + 1:stop]):
            pairs[quality._CLASS[x], quality._CLASS[y]] += 1
        for i, (at, word) in enumerate(words):
            if start <= at < stop:
                lengths[sum(len(word) > n for n in quality._LENGTHS)] += 1
                again += word in seen
                seen.add(word)
                run = tuple(w for _, w in words[i - 2:i + 1]) if i >= 2 else None
                repeated += run in runs
                if run:
                    runs.add(run)
        n = max(1, lengths.sum())
        rows.append(np.sqrt(np.concatenate([pairs.ravel() / max(1, pairs.sum()), lengths / n, [again / n, repeated / n]])))
    return np.array(rows)


def invented(rng, n):
    return " ".join("".join(rng.choices("abcdeéß|%XYZ.1", k=rng.randint(1, 24))) + rng.choice(["", "", "\n", "  "]) for _ in range(n))


def test_features_equal_a_plain_count(monkeypatch):
    rng = random.Random(2)
    texts = [invented(rng, n) for n in (1, 3, 80, 400, 2000)] + ["", "   ", "x" * 5000, "a b c " * 700, "no", "é"]
    features, owner = passages_of(*texts)
    for i, text in enumerate(texts):
        assert np.allclose(features[owner == i], plain(text), atol=1e-6), i
    assert np.bincount(owner).max() <= quality.PASSAGES
    monkeypatch.setattr(quality, "PIECE", 1 << 30)
    assert np.allclose(features, passages_of(*texts)[0])


def test_pieces_of_a_long_text_cover_it_whole(monkeypatch):
    text = invented(random.Random(3), 3000)
    whole, _ = passages_of(text)
    monkeypatch.setattr(quality, "PIECE", 1000)
    cut, _ = passages_of(text)
    lengths = slice(quality._KINDS ** 2, quality.FEATURES - 2)
    assert np.allclose(whole[:, lengths], cut[:, lengths], atol=1e-6)  # word counts don't depend on pieces


def small_model(rng):
    parts = {"encode": rng.normal(0, .1, (quality.FEATURES, quality.HIDDEN)), "encode_bias": rng.normal(0, .1, quality.HIDDEN),
             "show": rng.normal(0, .4, (quality.HIDDEN, quality.GATE)), "gate": rng.normal(0, .4, (quality.HIDDEN, quality.GATE)),
             "attend": rng.normal(0, 1, quality.GATE), "score": rng.normal(0, 1, quality.HIDDEN), "bias": np.array([.3])}
    return quality.Model(parts, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))


def test_slopes_equal_finite_differences():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    x, starts = rng.normal(0, 1, (14, quality.FEATURES)), np.array([0, 1, 5, 12])
    labels, weights = np.array([1, 0, 0, 1]), np.array([.5, 2., 1., 1.])
    _, slopes = model.gradients(x, starts, labels, weights)
    for name, value in model.parts.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            kept, h, ends = value[at], 1e-5, []
            for step in (h, -h):
                value[at] = kept + step
                ends.append(model.gradients(x, starts, labels, weights)[0])
            value[at] = kept
            assert abs((ends[0] - ends[1]) / (2 * h) - slopes[name][at]) < 1e-7, name


def test_attention_is_a_softmax_over_each_bag():
    rng = np.random.default_rng(2)
    model = small_model(rng)
    x, starts = rng.normal(0, 1, (9, quality.FEATURES)), np.array([0, 4, 5])
    f = model.forward(x, starts)
    for a, b in ((0, 4), (4, 5), (5, 9)):
        h = np.tanh(x[a:b] @ model.parts["encode"] + model.parts["encode_bias"])
        raw = (np.tanh(h @ model.parts["show"]) / (1 + np.exp(-h @ model.parts["gate"]))) @ model.parts["attend"]
        share = np.exp(raw) / np.exp(raw).sum()
        assert np.allclose(f["weight"][a:b], share)
        assert np.allclose(f["out"][[0, 4, 5].index(a)], share @ h @ model.parts["score"] + .3)


def test_attention_finds_the_one_bad_passage():
    rng = np.random.default_rng(4)
    bags, labels = [], []
    for i in range(400):
        bag = np.abs(rng.normal(0, .2, (rng.integers(2, 20), quality.FEATURES)))
        if i % 4 == 0:
            bag[rng.integers(0, len(bag)), :5] += 2
        bags.append(bag.astype(np.float32))
        labels.append(int(i % 4 != 0))
    model = quality.train(bags, np.array(labels), .75)
    fresh = np.abs(rng.normal(0, .2, (12, quality.FEATURES)))
    clean = quality._sigmoid(model.forward(model.standard(fresh), np.array([0]))["out"])[0]
    fresh[7, :5] += 2
    found = model.forward(model.standard(fresh), np.array([0]))
    assert clean > .7 and quality._sigmoid(found["out"])[0] < .3 and found["weight"].argmax() == 7


def test_held_out_rows_are_told_apart(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(quality.held_out(labels["doc_id"])).collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean(np.subtract.outer(good, bad) > 0) > .97 and np.mean(np.array(good) >= quality.THRESHOLD) > .97


def test_held_out_labels_and_clashing_columns_change_nothing(spark):
    rng = random.Random(6)
    docs = [(i, invented(rng, 30) if i % 3 else "clean words only here " * rng.randint(1, 9)) for i in range(150)]
    marks = [(i, int(i % 3 == 0)) for i in range(150)]
    held = {i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0}
    plain_docs = spark.createDataFrame(docs, "doc_id long, text string")
    odd = spark.createDataFrame([(i, t, "z", 1, .5, 3) for i, t in docs], "doc_id long, text string, label string, text_key int, score double, predicted int")
    flipped = [(i, 1 - q if i in held else q) for i, q in marks] + [(None, 0), (3, None), (77777, 1)]
    scores = []
    for d, m in ((plain_docs, marks), (odd, flipped)):
        model = quality.fit(d, spark.createDataFrame(m, "doc_id long, quality int"))
        out = quality.score(d, model)
        assert len(out.columns) == len(set(out.columns))
        scores.append({r["doc_id"]: r["score"] for r in out.collect()})
    assert scores[0] == scores[1]


def test_null_empty_repeated_and_very_long_texts(spark):
    docs = [(1, None), (2, ""), (None, "Some words."), (3, "good text. " * 200_000), (3, "good text. " * 200_000), (4, "bad|||%%%" * 40)]
    marks = [(i, i % 2) for i in range(10, 60)]
    docs += [(i, ("nice words here. " if i % 2 else "## %% || ") * (i % 7 + 1)) for i in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = quality.score(df, quality.fit(df, spark.createDataFrame(marks + [(4, 0), (4, 1)], "doc_id long, quality int"))).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= .3) for r in out)
    by_id = [r["score"] for r in out if r["doc_id"] in (1, 2)]
    assert by_id[0] == by_id[1] and len({r["score"] for r in out if r["doc_id"] == 3}) == 1


@pytest.mark.parametrize("marks,share", [([], 0.0), ([(1, 1), (3, 1)], 1.0), ([(2, 0)], 0.0)])
def test_without_both_labels(spark, marks, share):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    free = [(i, q) for i, q in marks if zlib.crc32(str(i).encode()) % 5]
    out = quality.score(df, quality.fit(df, spark.createDataFrame(marks, "doc_id long, quality int"))).collect()
    assert {r["score"] for r in out} == {share if free else 0.0}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(df, quality.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).collect() == []
