"""Stages of the pipeline on small tables, their rows compared with what brute force keeps."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from .test_small import DOCS, plain_fingerprint

WORDS = [f"w{i}" for i in range(400)]


def text_of(number: int) -> str:
    return " ".join(WORDS[(number * 37 + i * (number + 3)) % 400] for i in range(60))


def one_of_each(rows):
    """Of each group of chained near fingerprints the row with the smallest id, nulls last; of the groups without ids how many."""
    prints = {r[1]: plain_fingerprint(r[1]) for r in rows}
    label = {f: f for f in prints.values()}
    for _ in label:
        label = {f: min(label[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
    groups = {}
    for r in rows:
        groups.setdefault(label[prints[r[1]]], []).append(r)
    return [min((r for r in group), key=lambda r: (r[0] is None, r[0] or 0)) for group in groups.values()], groups


def test_near_duplicates_keep_one_document_of_each_group(spark):
    rows = [(None, text_of(i), "en", "a", 0) for i in range(5)]  # unrelated, without ids
    rows += [(None, text_of(0), "en", "a", 0), (None, None, "en", "a", 0), (None, "", "en", "a", 0)]
    rows += [(1, text_of(10), "en", "a", 0), (7, text_of(10), "en", "a", 0), (1, text_of(11), "en", "a", 0), (8, text_of(11), "en", "a", 0)]  # one id, two groups
    rows += [(2, text_of(12), "en", "a", 0), (2, text_of(12), "en", "a", 0), (None, text_of(12), "en", "a", 0), (3, text_of(13), "en", "a", 0)]
    want, groups = one_of_each(rows)
    assert len(groups) == 10
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == Counter((r[0], r[1] or "") for r in want)


@pytest.mark.parametrize("k", [2, 4, 10])
def test_language_id_rejects_what_no_language_comes_near(spark, k):
    rng = np.random.default_rng(k)
    vocabularies = []
    for _ in range(k):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyzäéíñöüçß"), 14, replace=False)
        vocabularies.append(["".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(120)])
    clean = lambda v, n: " ".join(rng.choice(v, n))
    rows = [(1000 * i + j, clean(v, int(rng.integers(15, 200))), f"l{i}", "a", 0) for i, v in enumerate(vocabularies) for j in range(60)]
    rows += [(100_000 + i, clean(v, 40_000), None, "long", 0) for i, v in enumerate(vocabularies)]
    rows += [(None, clean(vocabularies[0], 30), None, "short", 0), (None, clean(vocabularies[0], 60) + " " + clean(vocabularies[1], 60), None, "mixed", 0)]
    kept = len(rows)
    unknown = ["Η γάτα και ο σκύλος πήγαν στο σπίτι κοντά στο ποτάμι", "Кошка и собака пошли в дом у реки со своими друзьями", "แมวและสุนัขไปที่บ้านใกล้แม่น้ำกับเพื่อน",
               "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 200_000)), "猫と犬は川の近くの家に行きました", "12 34 !!", "", None]
    unknown += [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(n)) for n in (20, 500, 20_000)]
    rows += [(200_000 + i, text, None, "unknown", 0) for i, text in enumerate(unknown)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOCS).repartition(4), "").collect()
    assert Counter(tuple(r) for r in got) == Counter(rows[:kept])
