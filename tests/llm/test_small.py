"""Small tables with nulls, empty and long texts, ties, repeats, no rows, and clashing names."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from capsift.llm import (
    bwt, chat, decontaminate, langid, licenses, links, mixing, repeats, simhash, tokens, topk, toxicity)
from capsift.llm.common import scratch
from capsift.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat and the dog went to the house near the river with their friends"
DE = "der hund und die katze gingen zu dem haus an dem fluss mit ihren freunden"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, EN, "en", "a", 9), (2, DE, "de", "b", 9), (3, None, None, None, None), (4, "", "en", "a", 0),
            (5, "12 34 !!", "de", None, 8), (6, LONG, "en", "b", 1), (6, LONG, "en", "b", 1), (None, EN + " x", "en", "a", 3)]
    rows += [(100 + i, f"{EN} {i}", "en", "a", 1) for i in range(20)] + [(200 + i, f"{DE} {i}", "de", "c", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("size", "score", "doc", "spans", "fp", "key", "kind"):
        frame = frame.withColumn(name, F.lit("theirs"))
    return frame


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- language ID -----------------------------------------------------------------
def test_languages(docs, none):
    rows = langid.identify(docs).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not r.text or r.text.startswith("12"))
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id and r.doc_id >= 100)
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_presence_is_the_set_of_grams():
    text = "Ab, c".encode()
    bits = langid.presence(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    folded = b"ab  c"
    grams = {folded[i:i + n] for n in range(1, 5) for i in range(len(folded) - n + 1)}
    assert bits.sum() == len(grams)


# --- license scan -------------------------------------------------------------------
def test_licenses(spark, none):
    mit = licenses.TEMPLATES["mit-text"]
    near = mit.replace("associated", "related")
    rows = [(1, f"x y z {mit} tail", None, None, 0), (2, near, None, None, 0), (3, None, None, None, 0), (4, "released under the mit", None, None, 0),
            (5, "a " * 3000 + "Released UNDER the MIT license", None, None, 0), (1, f"x y z {mit} tail", None, None, 0)]
    found = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[1, "mit-text"].containment == 1 and found[1, "mit-text"].first_word == 3
    assert (5, "mit") in found and not any(d in (3, 4) for d, _ in found)
    words = near.lower().replace(",", "").split()
    assert ((2, "mit-text") in found) == (1 - 5 / (len(words) - 4) >= 0.8)
    assert licenses.scan(none).count() == 0


def test_short_license_beside_every_long_one_at_every_offset(spark):
    mit, rows = licenses.TEMPLATES["mit"], []
    for name, long in sorted(licenses.TEMPLATES.items()):
        for offset in range(60):
            rows += [(len(rows) + side, "x " * offset + pair, name, None, 0) for side, pair in enumerate((f"{mit} {long}", f"{long} {mit}"))]
    found = {(r.doc_id, r.license): r for r in licenses.scan(spark.createDataFrame(rows, DOCS).repartition(8)).collect()}
    assert all(found[i, "mit"].containment == 1 and found[i, name].containment == 1 for i, _, name, _, _ in rows)


def test_license_sketches_reach_every_match(spark):
    template = " ".join(f"w{i}" for i in range(44))  # 40 shingles, of which a match may lack 8
    rows = [(i, " ".join(f"w{j}" for j in range(i, 36 + i)), None, None, 0) for i in range(9)] + [(9, " ".join(f"w{j}" for j in range(35)), None, None, 0)]
    found = licenses.scan(spark.createDataFrame(rows, DOCS), {"long": template}).collect()
    assert {r.doc_id: r.n_matched for r in found} == dict.fromkeys(range(9), 32)


# --- SimHash --------------------------------------------------------------------------
def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs, none):
    rows = simhash.report(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in texts]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in rows) == Counter(prints)
    label = {f: f for _, f in prints}
    for _ in label:
        label = {f: min(label[g] for g in label if (f ^ g).bit_count() <= 3) for f in label}
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[label[f]] = min(i, smallest.get(label[f], i))
    assert all(r.component_id == smallest.get(label[int(r.fingerprint, 16)]) for r in rows)
    assert simhash.report(none).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    near = base[rng.integers(0, 300, 2500)] ^ (np.uint64(1) << rng.integers(0, 64, 2500).astype(np.uint64))
    points = np.unique(np.concatenate([base, near]))
    tree = simhash.Tree(points, 128, 3)
    assert tree.shards > 3
    forest = simhash.Forest(len(points))
    for _, index in tree.assign(points):
        index = np.sort(index)
        root = simhash.link(points[index], 3)
        forest.join(index, index[root])
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    whole = simhash.Forest(len(points))
    whole.join(i, j)
    assert (forest.root == whole.root).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    found = dict(links.components(spark.createDataFrame(edges, "u long, v long"), scratch(spark)).collect())
    assert all(found[i] == 0 for i in range(61)) and all(found[200 + i] == 100 for i in range(50)) and found[100] == 100


# --- chat ------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\n", "a\\", "\\<|", "<\\|x|>", "", None, "\\\\n", "ü\n\n"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate(zip(["user", "assistant"] * 4, odd))]
    rows += [(None, 0, None, "x"), (2, 0, "a\\n\nb<|", "y"), (2, 0, "a\\n\nb<|", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.text_parts(frame))).collect()}
    for conv in (1, None, 2):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        loss = "".join(t for r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(chat.text_parts(frame.limit(0)))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "s3://i", 2.0), ("audio", None, None, 1.5), ("video", None, "v", 9.0), (None, "t", None, None)]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_chats(frame).first()
    assert "see <\\|<|image:0.1|><|audio:0.2|><|file:0.3|>t" in row.formatted
    assert [(a.slot, a.ref, a.tokens) for a in row.attachments] == [("<|image:0.1|>", "s3://i", 512), ("<|audio:0.2|>", "", 38), ("<|file:0.3|>", "v", 0)]
    assert row.n_tokens == 2 + 512 + 38 + 0 + 1


# --- mixing ------------------------------------------------------------------------------
def test_mix(docs, none):
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(r[0].target for r in by.values()) == pytest.approx(sum(r.size for r in rows))
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size and own[0].target <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mix(docs.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    assert mixing.mix(none).count() == 0


# --- decontamination -------------------------------------------------------------------
def test_decontamination_in_parts(spark, docs, none):
    items = [(1, " ".join(EN.split()[:11])), (2, "river with"), (3, None), (4, "!!"), (None, EN), (5, "river WITH"), (1, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    once, parts = (decontaminate.report(docs, bench, max_windows=m).collect() for m in (500_000, 2))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, once)) == sorted(map(key, parts))
    first = next(r for r in once if r.doc_id == 1)
    assert (first.n_words, first.n_hit, first.n_items) == (15, 13, 3)
    assert first.items_sha256 == hashlib.sha256(b"1,2,5").hexdigest() and first.contaminated
    assert decontaminate.report(none, bench).count() == 0
    assert not decontaminate.report(docs, bench.limit(0)).filter("contaminated").count()
    left = decontaminate.drop_spans(docs.filter("doc_id = 1"), bench).first().text
    assert left == "near the " + "their friends" or "river with" not in left
    assert decontaminate.drop_documents(docs, bench).filter("doc_id = 1").count() == 0


# --- long repeats ---------------------------------------------------------------------------
def plain_repeats(texts, m):
    count = Counter(t[i:i + m] for t in texts for i in range(len(t) - m + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - m + 1):
            if count[t[i:i + m]] > 1:
                gone[i:i + m] = True
        yield len(t), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), hashlib.sha256(
            np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("group", [256, 1])
def test_repeats(spark, none, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(c) for c in rng.choice([97, 98, 99, 32, 233, 8364], n))
    passage = word(520)
    texts = [word(300) + passage + word(200) for _ in range(6)] + [passage[:300], passage[:200] + "x" + passage[200:], "é" * 900, "ab" * 700, None, ""]
    texts += [texts[0], texts[0], word(1500)] * 2
    rows = [(i if i != 3 else None, t, None, None, 0) for i, t in enumerate(texts)] + [(0, texts[0], None, None, 0)]
    got = repeats.report(spark.createDataFrame(rows, DOCS)).collect()
    want = plain_repeats([(r[1] or "").encode() for r in rows], 400)
    assert Counter(tuple(r) for r in got) == Counter((row[0], *w) for row, w in zip(rows, want))
    assert repeats.report(none).count() == 0


def test_reach_of_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 3)
    random = np.random.default_rng(5)
    letters = lambda n: "".join(chr(97 + x) for x in random.integers(0, 26, n))
    passage, short, ends = letters(460), letters(380), [letters(90) for _ in range(3)]
    rows = [(i, letters(int(random.integers(300, 700))) + ends[i % 3][:int(random.integers(0, 90))] + (short if i % 4 == 0 else passage)
             + ends[i % 2][:int(random.integers(0, 90))] + letters(int(random.integers(0, 300))), None, None, 0) for i in range(90)]
    got = repeats.report(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    want = plain_repeats([r[1].encode() for r in rows], 400)
    assert sorted((r.doc_id, *r[1:]) for r in got) == sorted((r[0], *w) for r, w in zip(rows, want))


@pytest.mark.parametrize("group", [256, 2])
def test_passages_of_fifty_words_are_told_beside_the_contract(spark, monkeypatch, tmp_path, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(chr(c) for c in rng.choice([97, 98, 99, 100, 233], 4)) for _ in range(n))
    short, long = words(51), words(120)
    assert 250 < len(short.encode()) < 400
    texts = [f"{words(40)} {p} {words(30)}" for p in (short, short, short, long, long[:420], long + short, words(80), words(80))]
    texts += [short, long, long + " " + long, texts[3], texts[3], short[:120] + "x" + short[121:], None, "", "é" * 450]
    rows = [(i if i != 3 else None, t, None, None, 0) for i, t in enumerate(texts)] + [(4, texts[4], None, None, 0)] * 2
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op7_repeated_text"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "n_repeated"]
    raw = [(r[1] or "").encode() for r in rows]
    want = [(row[0], *w, w[0] - w[1], p[1]) for row, w, p in zip(rows, plain_repeats(raw, 400), plain_repeats(raw, 250))]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert all(w[2] == 0 < w[6] for w in want[:3]) and want[6][6] == want[7][6] == 0


def test_shared_prefixes():
    assert repeats.shared_prefixes([b"", b"ab", b"abc", b"abd", b"abd", b"b\0", b"b"]).tolist() == [0, 2, 2, 3, 0, 1]


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for trial in range(20):
        m = int(rng.integers(1, 30))
        texts = [rng.integers(97, 100, rng.integers(0, 120)).astype(np.uint8) for _ in range(4)]
        count = Counter(bytes(t[i:i + m]) for t in texts for i in range(len(t) - m + 1))
        for t, got in zip(texts, bwt.repeated_starts(texts, m)):
            assert got.tolist() == [count[bytes(t[i:i + m])] > 1 for i in range(len(t) - m + 1)]


# --- token counts -----------------------------------------------------------------------------
def test_token_rollups(spark, docs, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    exact.encode_special_tokens = True
    want = Counter()
    for r in docs.collect():
        want[r.source, r.lang] += len(exact.encode(r.text or "", add_special_tokens=False).ids)
    got = {(r.source, r.lang): r.n_tokens for r in tokens.recount(docs).collect()}
    assert got == dict(want)
    assert tokens.recount(none).count() == 0


def test_rollup_commits_once(spark):
    rollup = tokens.Rollup(spark, scratch(spark))
    schema = "op string, source string, lang string, tokenizer string, n_old long, n_new long"
    change = lambda *rows: spark.createDataFrame(list(rows), schema)
    load = change(("insert", "a", None, "t", None, 5), ("insert", "b", "x", "t", None, 7))
    assert rollup.commit("1", load) and not rollup.commit("1", load)
    rollup.commit("2", change(("revise", "a", None, "t", 5, 3), ("delete", "b", "x", "t", 7, None)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", None, "t", 1, 3)]
    with pytest.raises(Exception, match="no such change"):
        rollup.commit("3", change(("insert", "a", None, "t", None, None)))
    assert rollup.batches() == ["1", "2"] and rollup.totals().count() == 1


# --- top-k ------------------------------------------------------------------------------------
def test_topk_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50, [1.0, 0.0]), (0, [0.5, 0.5])] + [(i, [1.0, 0.1 * (i % 2)]) for i in range(1, 40)]
    rows += [(60, None), (61, [nan, 1.0]), (62, [inf, 1.0]), (63, [None, 1.0]), (64, []), (100, [1.0, 1.0, 1.0])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = topk.search(vectors.filter("vec_id % 50 = 0"), vectors).collect()
    q = {i: [int(np.floor(256 * np.float32(x))) for x in v] for i, v in rows if v and None not in v and all(np.isfinite(v))}
    for query in (0, 50):
        scores = sorted(((-sum(a * b for a, b in zip(q[query], q[i])), i) for i in q if i != query and len(q[i]) == 2))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == query] == [
            (k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert {r.query_id for r in got} == {0, 50}
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


# --- toxicity --------------------------------------------------------------------------------
def test_toxicity_learns_from_positives_only(spark, none):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 40)) + (" vile scum" if i % 6 == 0 else ""), None, None, 0) for i in range(900)]
    rows += [(None, "vile", None, None, 0), (5000, None, None, None, 0), (5001, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 2)] + [(0, 0), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted != int(r.doc_id % 6 == 0) for r in held) <= 5
    assert all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got if not r.text)
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(none, None).count() == 0


def test_word_bins_match_whole_and_in_pieces(monkeypatch):
    text = ("Some words, gröse WORDS " * 50).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = next(toxicity.distinct_bins(data, offsets))[2]
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 16)
    assert np.array_equal(whole, next(toxicity.distinct_bins(data, offsets))[2])


def test_the_fit_takes_all_bins_of_a_text(spark):
    texts = [" ".join(f"{i:x}q" for i in range(n)) for n in (5, 3_000, 60_000)] + [""]
    got = toxicity._bins_of(spark.createDataFrame(list(enumerate(texts)), "text_key long, text string"))
    assert len(got) == len(texts)
    for text, bins in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        assert np.array_equal(bins, np.unique(toxicity.word_bins(data, np.array([0, len(data)]))[1]))
    assert max(map(len, got)) > 16_384
