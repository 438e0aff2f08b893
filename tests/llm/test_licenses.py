"""License bands: what shares none is not counted, no match is lost, and the defined cases."""

import random

from pyspark.sql import functions as F

from capsift.llm import licenses


def shingles(spark, templates):
    return licenses.template_table(spark, templates)[0]


def by_rule(rows, templates, bound=0.8):
    sets = {}
    for name, template in templates.items():
        w = words(template)
        sets[name] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    stride = max(len(words(t)) for t in templates.values())
    out = {}
    for doc_id, text in set(rows):
        w = words(text or "")
        for at in range(0, max(1, len(w)), stride):
            here = {i: tuple(w[i:i + 5]) for i in range(at, min(at + 2 * stride, len(w) - 4))}
            for name, whole in sets.items():
                got = whole & set(here.values())
                if whole and len(got) / len(whole) >= bound:
                    key = (doc_id, text, name)
                    if key not in out or len(got) > out[key][0]:
                        out[key] = (len(got), min(i for i, s in here.items() if s in whole))
    return sorted(((d, n, *v) for (d, _, n), v in out.items()), key=str)


def words(text):
    import re
    return re.findall("[a-z0-9]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_scan_equals_counting_every_window(spark):
    rng = random.Random(3)
    templates = {f"t{n}": " ".join(f"w{rng.randint(0, 30)}" for _ in range(n)) for n in (5, 6, 9, 14, 30, 44)} | {"short": "one two"}
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = words(rng.choice(list(templates.values())))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "x"
            parts += w + [f"n{rng.randint(0, 9)}"] * rng.randint(0, 50)
        rows.append((i if i % 10 else None, " ".join(parts)))
    rows += [(1, None), (2, ""), (3, "?!"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.license, r.n_matched, r.first_word) for r in licenses.scan(df, templates).collect()), key=str)
    assert got == by_rule(rows, templates) and len(got) > 60


def test_bands_bound_the_chance_of_a_miss(spark):
    known = licenses.classes(shingles(spark, licenses.TEMPLATES), 46, 0.8).collect()
    assert {r.license for r in known} == set(licenses.TEMPLATES)
    for r in known:
        n, need = len(r.whole), max(1, -(-len(r.whole) * 8 // 10))
        universe = len({s for k in known if k.cls == r.cls for s in k.whole})
        j = min(1, need / (n + min(universe, 46) - need))
        assert (1 - j) ** r.bands <= licenses.MISS and 1 <= r.bands < 100


def test_pairs_that_share_no_band_are_not_counted(spark):
    long = " ".join(f"w{i}" for i in range(68))
    known = licenses.classes(shingles(spark, {"long": long, "other": long.replace("w", "v")}), 132, 0.8)
    table = shingles(spark, {"long": long})
    rows = [(1, 10, 0, i, r.shingle) for i, r in enumerate(table.collect())]
    windows = spark.createDataFrame(rows + [(2, 20, 0, 0, 12345)], "doc_id long, text_key long, window long, pos int, shingle long")
    found = licenses.retrieve(windows, known)
    assert [(r.doc_id, r.license) for r in found.collect()] == [(1, "long")]  # "other" shares no shingle, document 2 none at all
    assert licenses.count(windows, found.limit(0), table).count() == 0
    assert [r.n_matched for r in licenses.count(windows, found, table).collect()] == [64]
    few = spark.createDataFrame([(k, k, 0, 0, r.shingle) for k, r in enumerate(table.collect())], windows.schema)
    assert licenses.retrieve(few, known).count() < 64  # one shingle of 64 is mostly not enough


def test_many_templates_are_joined(spark, monkeypatch):
    monkeypatch.setattr(licenses, "LITERALS", 3)
    df = spark.createDataFrame([(1, "x " + licenses.TEMPLATES["mit"]), (2, "nothing here")], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.first_word) for r in licenses.scan(df).collect()] == [(1, "mit", 1)]


def test_no_templates_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, licenses.TEMPLATES["mit"], 1, 2, "x")], "doc_id long, text string, window int, pos int, license string")
    assert licenses.scan(df, {}).collect() == [] and licenses.scan(df, {"t": "too few words"}).collect() == []
    assert [(r.doc_id, r.license) for r in licenses.scan(df.withColumn("shingle", F.lit(1))).collect()] == [(1, "mit")]
