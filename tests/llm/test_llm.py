"""The training-data operators against brute force, and on rows that are null, empty, repeated, long or oddly named."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from backuplake.llm import ann, bpe, language, license_scan, near_dedup, packing, quality, token_files, topk, warc, words
from backuplake.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, score double, _n int, _row string, band string, key string"
ODD = [
    None, "", " ", "a", "a ", "\n\nfoo", "foo\n bar", "foo \nbar", "foo   bar  \n", "don't I'll <|endoftext|>x", "a\tb\r\nc",
    "\x1ca\x1fb", "İstanbul ΣΑΣ ß é", "中文字符 123 ４５", "x" * 5000 + " yy", "ab" * 3000, "\xa0x y", "a\x00b", "!!!" * 2000, "the end. " * 3000,
]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", len(t or ""), [1], 0.5, 1, "r", "b", "k") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Odd texts, a repeated row and a row without an id."""
    return frame(spark, ODD + ["twice over", "twice over", "no id"], [*range(len(ODD)), 500, 500, None])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, rank int")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "iota", "kappa", "mu"]) + rng.choice("abcdefgh") for _ in range(n))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_give_the_librarys_ids(path):
    coder, texts = Encoder(path, bpe.Tree), [t or "" for t in ODD]
    for text, data in zip(texts, coder.encode(texts)):
        want = coder.whole.encode(text, add_special_tokens=False).ids
        assert coder.ids(data).tolist() == want
        assert coder.decode(coder.ids(data)) == coder.whole.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_with_marks_and_letters_beyond_ascii(path, monkeypatch):
    """Words with a mark, of every kind of letter, with tables that are always full."""
    rng, coder = random.Random(8), Encoder(path, bpe.Tree)
    monkeypatch.setattr("backuplake.llm.tokens.KNOWN_BYTES", 2000)
    letters = ["ab", "Cd", "ä", "ß", "É", "İ", "ı", "ŉ", "ª", "ǰ", "e\u0301", "中", "Σ", "x" * 300, "7", "'", "-", "’"]
    for _ in range(400):
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) + rng.choice(["", ".", ",", "!", "?", ";", ":", "..", "\""]) for _ in range(12)]
        text = "".join(w + rng.choice([" ", " ", "\n", "  "]) for w in words)
        (data,) = coder.encode([text])
        assert coder.ids(data).tolist() == coder.whole.encode(text, add_special_tokens=False).ids


def test_joined_halves_are_the_encoding():
    rng, coder = random.Random(3), Encoder(WORD, bpe.Tree)
    coder.long.longest = 8
    for _ in range(200):
        piece = "".join(rng.choice(["the", "a", "b", "in", "er", "zz", "q"]) for _ in range(rng.randint(1, 200)))
        assert coder.long.encode(piece) == coder.bare.encode(piece).ids


def test_bpe_long_texts_in_parts(spark):
    docs, coder = odd(spark), Encoder(WORD)
    got = sorted((tuple(r) for r in bpe.round_trip(docs, WORD, part=500).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = coder.whole.encode(r["text"] or "", add_special_tokens=False).ids
        text = coder.whole.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = bpe.encode(docs, WORD, part=500)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORD).collect()}
    assert texts[3] == "a</w>" and texts[0] == ""
    assert bpe.round_trip(docs.limit(0), WORD).count() == 0


def test_packing_places_every_id_once(spark):
    docs, coder = odd(spark), Encoder(WORD)
    rows = packing.pack(docs, WORD, end_id=1, block=16).collect()
    ids = {i: coder.whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(ODD)}
    for i, want in ids.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) == len(want) == own[0]["doc_tokens"]
        for r in own:
            part = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    assert sum(r["length"] for r in rows if r["doc_id"] == 500) == 2 * 3
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    whole = packing.sequences(docs, WORD, end_id=1, block=16).collect()
    assert all(len(s["ids"]) == 2048 or s["used"] == len(s["ids"]) & -len(s["ids"]) for s in whole)
    assert sum(s["used"] for s in whole) == sum(r["length"] for r in rows)
    assert packing.pack(docs.limit(0), WORD).count() == 0


def test_differencing_evens_out():
    rng = random.Random(1)
    sizes = [rng.randint(1, 2047) for _ in range(200)] + [rng.randint(1, 64) for _ in range(400)]
    groups = packing.windows_of(sizes, 2048)
    sums = [sum(sizes[i] for i in g) for g in groups]
    assert sorted(i for g in groups for i in g) == list(range(600)) and max(sums) <= 2048
    assert sum(sums) / (2048 * len(groups)) > 0.97
    assert packing.windows_of([], 8) == [] and sorted(map(sorted, packing.windows_of([8, 8], 8))) == [[0], [1]]


def test_token_files(spark):
    docs, coder = odd(spark), Encoder(BYTE)
    folder = token_files.new_folder(spark)
    manifest = token_files.write(docs, BYTE, folder, end_id=0, length=16)
    got = sorted(token_files.read(manifest, folder).collect(), key=lambda r: (r["start"]))
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    for r, want in zip(got, order):
        ids = np.array(coder.whole.encode(want["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (want["doc_id"], at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(ids.tobytes())
        at += len(ids)
    file = manifest.first()["file"]
    reader = token_files.Reader(folder, file)
    used = sum(r["n_tokens"] for r in manifest.filter(F.col("file") == file).collect())
    ids, mask = reader.sequence((used - 1) // 16)
    assert len(ids) == 16 and mask.sum() == (used - 1) % 16 + 1
    assert token_files.write(docs.limit(0), BYTE, folder).count() == 0


def test_warc(spark):
    rows = [(5, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (9, None, None), (3, "u", ""), (None, "n", "x"), (7, "s", "solo"), (7, "s", "solo")]
    pages = spark.createDataFrame([(*r, "p", "d") for r in rows], "page_id long, url string, html string, payload string, digest string")
    got = warc.round_trip(pages).collect()
    facts = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert facts == {(2, "response", None), (5, "revisit", 2), (None, "revisit", 2), (3, "response", None), (9, "revisit", 3), (7, "response", None)}
    assert len(got) == len(rows)
    for r in got:
        body = {5: b"x", 2: b"x", None: b"x", 9: b"", 3: b"", 7: b"solo"}[r["page_id"]]
        assert bytes(r["payload"]) == body and r["payload_bytes"] == len(body)
        assert r["payload_digest"] == r["stated_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest == (body if n else b"") + b"\r\n\r\n" and b"\nEvil" not in head
    assert warc.round_trip(pages.limit(0)).count() == 0


def _bag(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_words_are_the_same_beside_a_mark():
    for run in ["İstanbul", "plain", "ÉTÉ", "x_y"]:
        own = words.words()(run).tolist()
        assert own == words.words()(run + ",").tolist() == words.words()("(" + run).tolist()


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(11)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(60):  # edited copies whose similarities lie on both sides of the threshold
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = prose(rng, 1)
        texts.append(" ".join(own))
    texts += [prose(rng, 80) for _ in range(20)] + ["One two", "one TWO!", "", None, "...", "!!!", "?!", "!!!", "loop " * 50, "loop " * 55, texts[3]]
    ids = [*range(len(texts)), None, 3]
    docs = frame(spark, texts + ["lost", texts[3]], ids)
    bags = [_bag(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            common = sum((a & b).values())
            bare = not a and not b and (texts[i] or "") == (texts[j] or "")
            if bare or (common and common >= 0.8 * (sum(a.values()) + sum(b.values()) - common)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted({(False, find(i)) for i in got} | {(True, 0)})
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 62, 1000).astype(np.uint64)])
    marks = near_dedup.signatures(np.concatenate([a, b]), np.array([4000, 4000]), 2048)
    assert abs((marks[0] == marks[1]).mean() - 3000 / 5000) < 0.05
    assert (marks[1] == near_dedup._complete(b, 2048)).all()


def test_license_scan_against_all_windows(spark):
    rng, names = random.Random(2), sorted(license_scan.TEMPLATES)
    texts = [prose(rng, rng.randint(0, 90)) + " " + license_scan.TEMPLATES[rng.choice(names)] + " " + prose(rng, 30) for _ in range(40)]
    gpl = [license_scan.TEMPLATES[n] for n in ("GPL-2.0", "GPL-3.0")]
    texts += [gpl[0], gpl[1], " ".join(gpl), gpl[1] + " " + prose(rng, 60) + " " + gpl[0], gpl[0].replace("version 2", "version 4")]
    docs = frame(spark, texts + ODD + ["plain words only here and nothing else at all"])
    sets = {n: set(_bag(t)) for n, t in license_scan.TEMPLATES.items() if len(re.findall(r"\w+", t)) >= 5}
    rivals = {n: [m for m, t in sets.items() if m != n and s & t and s - t and t - s] for n, s in sets.items()}
    assert "GPL-3.0" in rivals["GPL-2.0"]
    want = set()
    for i, text in enumerate(texts):
        w = re.findall(r"\w+", text.lower())
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        matches = []
        for n, s in sets.items():
            size = license_scan.window_size(len(s))
            for k in range(0, max(1, len(runs)), size // 2):
                share = len(set(runs[k : k + size]) & s) / len(s)
                if share >= 0.8:
                    matches.append((n, share, k, {p for p in range(k, min(k + size, len(runs))) if runs[p] in s}))
        for n in sets:
            # A place counts if no rival's match over it is stronger.
            counts = [
                (-share, k)
                for m, share, k, at in matches
                if m == n and any(all(p not in there or other <= share for r, other, _, there in matches if r in rivals[n]) for p in at)
            ]
            if counts:
                want.add((i, n, -min(counts)[0], min(counts)[1]))
    found = {(i, n) for i, n, *_ in want if i >= 40}
    assert found >= {(40, "GPL-2.0"), (41, "GPL-3.0"), (42, "GPL-2.0"), (42, "GPL-3.0"), (43, "GPL-2.0"), (43, "GPL-3.0")}
    assert not found & {(40, "GPL-3.0"), (41, "GPL-2.0")}
    assert {tuple(r) for r in license_scan.scan(docs).collect()} == want
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((600, 6)) * np.exp(rng.standard_normal(600) * 1.5)[:, None]
    v[100:140] = v[100]  # ties
    v[200] = 0
    rows = [(i, [float(x) for x in r], "v", 1) for i, r in enumerate(v)]
    bad = [(700, None, "v", 1), (750, [1.0, None] * 3, "v", 1), (800, [float("nan")] * 6, "v", 1), (None, [1.0] * 6, "v", 1), (850, [1.0] * 3, "v", 1), (0, rows[0][1], "v", 1)]
    got = topk.search(vectors(spark, rows + bad), F.col("vec_id") % 50 == 0).collect()
    whole = np.floor(256 * v).astype(np.int64)
    want = set()
    for q in range(0, 600, 50):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:5]
        want |= {(q, r, int(i), int(scores[i])) for r, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.search(vectors(spark, rows[:3]), F.col("vec_id") % 50 == 0).count() == 2
    assert topk.search(vectors(spark, bad[:2]), F.col("vec_id") % 50 == 0).count() == 0


def test_coordinates_exclude_only_what_cannot_reach_the_cosine():
    rng = np.random.default_rng(9)
    v = rng.integers(-200, 200, (3000, 4))
    bucket = topk.Bucket(np.arange(3000), v)
    for q in rng.integers(-200, 200, (20, 4)):
        cosine = (bucket.v @ q) / (bucket.length * np.sqrt((q**2).sum()))
        left = bucket.steep(q, 0.9)
        assert set(np.flatnonzero(cosine >= 0.9)) <= set(left) and len(left) < 3000


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((1500, 24))
    v[60] = v[50] * 2
    rows = [(i, [float(x) for x in r], "v", 1) for i, r in enumerate(v)]
    bad = [(2000, None, "v", 1), (2050, [0.0] * 24, "v", 1), (2100, [float("inf")] * 24, "v", 1), (0, rows[0][1], "v", 1)]
    got = ann.search(vectors(spark, rows + bad), F.col("vec_id") % 50 == 0).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 1500, 50):
        scores = unit @ unit[q]
        scores[q] = -2
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in own)
        hits += len({r["vec_id"] for r in own} & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.9 * len(got) and len(got) == 150
    assert ann.search(vectors(spark, bad[:2]), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_neighbours_of_any_length(spark):
    rng = np.random.default_rng(12)
    v = rng.standard_normal((60, 8))
    lengths = np.array([1.0, 1e200, 1e-200])[np.arange(60) % 3]
    got = ann.search(vectors(spark, [(i, [float(x) for x in r], "v", 1) for i, r in enumerate(v * lengths[:, None])]), F.col("vec_id") % 50 == 0).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert len(got) == 10 and all(abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12 for r in got)


def test_language(spark):
    rng = random.Random(6)
    en, de = "the and with this that where should".split(), "der und nicht schön über können straße".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, "123 !!", "de"), (None, "the with", "en"), (3, rows[3][1], "en"), (903, "und nicht " * 90_000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(docs, language.fold(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0 <= got[i][1] <= 1 for i in range(200))
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "de" and got[None][0] == "en"
    # Stretches of a long text add up to the plain sum over its bytes.
    text = language.prepared(rows[0][1] * 3)
    language.STRETCH, saved = 64, language.STRETCH
    try:
        parts = model.lengths([text, text[:3], text])
    finally:
        language.STRETCH = saved
    assert np.allclose(parts[0], model.lengths([text])[0]) and np.allclose(parts[2], parts[0]) and not parts[1].any()
    # Probabilities after a context never add up to more than one over all 256 bytes, and to one after the empty one.
    unseen = 256 - (model.width - 1)
    total = (2.0 ** -model.bits.astype(float))[:, :-1].sum(axis=1) + unseen * (2.0 ** -model.bits.astype(float))[:, -1]
    assert (total < 1.001).all() and (total[0] > 0.99).all()
    kept = language.keep_known(docs, F.lit(True))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, prose(rng, 60)) for i in range(150)]
    bad = [(i, "%%% ".join(prose(rng, 40).split()) if i % 2 else " ".join(w for w in prose(rng, 9).split() for _ in range(8))) for i in range(150, 300)]
    extra = [(900, None), (901, ""), (None, "x y"), (3, good[3][1]), (902, "!" * 300_000)]
    docs = spark.createDataFrame([(*r, "q") for r in good + bad + extra], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (5, 7, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    learnable = language.fold(F.col("doc_id"), 3) != 1
    model = quality.fit(docs, labels, learnable)
    got = quality.score(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 60 and all(r["predicted"] == int(r["doc_id"] < 150) for r in held)
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    kept = quality.keep_good(docs, labels, F.lit(True))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(150))
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_pipeline_stages_follow_their_operators(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns
        if name == "quality":
            model = quality.fit(before, labels, F.lit(True))
            want = {r["doc_id"] for r in quality.score(before, model).collect() if r["predicted"]}
            assert {r["doc_id"] for r in docs.collect()} == want and len(want) < before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def test_registered_queries(spark):
    from backuplake.llm.queries import load

    assert [n.split("_")[0] for n in sorted(load()[0], key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]


def test_license_scan_tells_versions_apart(spark):
    two, three, words = license_scan.TEMPLATES["GPL-2.0"], license_scan.TEMPLATES["GPL-3.0"], "lorem ipsum dolor sit amet " * 4
    # Moved by a word each, so that windows also end inside the notice.
    lead = [" ".join(f"w{i}" for i in range(k)) for k in range(17)]
    texts = [f"{x} {n} {words}" for n in (two, three) for x in lead] + [f"{x} {three} and {two}" for x in lead]
    texts += [f"{x} {three} {three}" for x in lead] + [f"{two[5:]} {words} {three}", three.replace("3", "4")]
    want = [{("GPL-2.0", 1.0)}] * 17 + [{("GPL-3.0", 1.0)}] * 17 + [{("GPL-2.0", 1.0), ("GPL-3.0", 1.0)}] * 17 + [{("GPL-3.0", 1.0)}] * 17
    # A damaged notice of its own beside a whole one, and one that is as close to both.
    want += [{("GPL-2.0", 0.875), ("GPL-3.0", 1.0)}, {("GPL-2.0", 0.875), ("GPL-3.0", 0.875)}]
    got = [set() for _ in texts]
    for r in license_scan.scan(frame(spark, texts)).collect():
        got[r["doc_id"]].add((r["license"], r["containment"]))
    assert got == want


def test_quality_collects_copies_once(spark, monkeypatch):
    texts = [(i, f"good plain words {i} stand here" if i % 2 else f"buy now {i} cheap cheap") for i in range(20)]
    docs = spark.createDataFrame(texts + [texts[3]] * 400, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    kind, counts = type(docs), []
    collect = kind.collect
    once = quality.fit(docs.distinct(), labels, F.lit(True))

    def counted(self):
        out = collect(self)
        counts.append(len(out))
        return out

    monkeypatch.setattr(kind, "collect", counted)
    model = quality.fit(docs, labels, F.lit(True))
    assert max(counts) <= 20
    assert np.array_equal(model.weight, once.weight) and model.bias == once.bias


def test_warc_urls_with_brackets_and_line_separators(spark):
    urls = {1: "http://x/?a>b", 2: "<http://y/>", 3: "u\u2028WARC-Refers-To: <urn:page:7>", 4: "u\u0085WARC-Type: revisit", 5: "u\u2029v"}
    pages = spark.createDataFrame([(i, u, f"html {i}") for i, u in urls.items()], "page_id long, url string, html string")
    got = {r["page_id"]: (r["url"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {i: (u, "response", None) for i, u in urls.items()}
